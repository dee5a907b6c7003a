"""Accessibility profiles of places: made from map tags, and merged with what people have verified on site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfree.functions.tags import BLOCKING, KERB_METRES, first_tag, normalized, parse_metres

SCHEMA_VERSION = "accessibility-profile.v1"
#: Tags that count as evidence.
EVIDENCE = (
    "access", "amenity", "automatic_door", "barrier", "changing_table", "check_date", "crossing", "door:width", "entrance", "footway", "grab_bar", "highway", "image", "incline", "kerb",
    "kerb:height", "lit", "mapillary", "ramp", "sloped_curb", "smoothness", "surface", "tactile_paving", "toilets:door:width", "toilets:grab_bar", "toilets:wheelchair", "wheelchair", "width",
    "wikimedia_commons",
)
#: What a kind of place should have, and the tags that tell it.
PEDESTRIAN_GAPS = {
    "surface": ("surface", "sidewalk:surface"), "smoothness": ("smoothness", "sidewalk:smoothness"), "width_metres": ("width", "sidewalk:width", "est_width"),
    "kerb": ("kerb", "kerb:height", "sidewalk:kerb", "sloped_curb"), "tactile_paving": ("tactile_paving", "sidewalk:tactile_paving"), "incline_percent": ("incline", "ramp:incline"),
}
ENTRANCE_GAPS = {"entrance": ("entrance",), "door_width_metres": ("door:width", "entrance:width"), "wheelchair_access": ("wheelchair",)}
RESTROOM_GAPS = {
    "toilets_wheelchair_access": ("toilets:wheelchair", "wheelchair"), "toilets_door_width_metres": ("toilets:door:width", "door:width"),
    "toilets_grab_bars": ("toilets:grab_bar", "toilets:grab_rails", "grab_bar"), "changing_table": ("changing_table", "toilets:changing_table"),
}

PATH = {
    "surface": "string", "smoothness": "string", "width_metres": "double", "kerb_height_metres": "double", "incline_percent": "double", "incline_text": "string", "has_tactile_paving": "boolean",
    "has_curb_ramp": "boolean", "has_step_free_access": "boolean", "has_stairs": "boolean", "has_barrier": "boolean", "wheelchair_access": "string", "lighting": "string", "crossing_type": "string",
    "access": "string",
}
ENTRANCE = {"name": "string", "entrance_type": "string", "step_free": "boolean", "has_ramp": "boolean", "door_width_metres": "double", "automatic_door": "boolean", "step_height_metres": "double"}
RESTROOM = {
    "wheelchair_accessible": "boolean", "has_grab_bars": "boolean", "door_width_metres": "double", "turning_space_metres": "double", "has_changing_table": "boolean", "requires_key": "boolean",
    "gender_access": "string",
}
PHOTO = {"source": "string", "url": "string", "caption": "string", "taken_at": "timestamp", "verification_status": "string"}

DAY = 86400


def type_of(fields: dict[str, str]) -> str:
    return f"struct<{','.join(f'{k}:{v}' for k, v in fields.items())}>"


def made(fields: dict[str, str], values: dict[str, Column]) -> Column:
    """A struct with all of ``fields`` in their order; those without a value are null."""
    return F.struct(*[values.get(k, F.lit(None)).cast(v).alias(k) for k, v in fields.items()])


def flag(word: Column) -> Column:
    """Yes-words true, no-words false, anything else unknown."""
    return F.when(word.isin("yes", "true", "1", "designated", "permissive"), True).when(word.isin("no", "false", "0", "none"), False)


def day(text: Column) -> Column:
    """Time of a day, a month or a year (its start), else of any time that Spark reads; null if none."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy")], text.try_cast("timestamp"))


def half_even_3(x: Column) -> Column:
    """To three places, halves to even. Counted in whole millionths, where a half is exact whatever the sum's last bits are."""
    millionths = F.round(x * 1e6).cast("long")
    down, rest = F.floor(millionths / 1000), F.pmod(millionths, F.lit(1000))
    return (down + F.when((rest > 500) | ((rest == 500) & (down % 2 == 1)), 1).otherwise(0)) / 1000.0


def tag_confidence(known: Column, age_days: Column, photos: Column, n_tags: Column) -> Column:
    """0.10 + 0.65 * known share + freshness + photos + tags, between 0.05 and 0.99."""
    fresh = F.when(age_days <= 365, 0.20).when(age_days <= 1095, 0.10).when(age_days.isNotNull(), 0.04).otherwise(0.0)
    total = 0.10 + 0.65 * known + fresh + F.when(photos > 0, 0.10).otherwise(0.0) + F.least(F.lit(0.10), n_tags / 100.0)
    return half_even_3(F.greatest(F.lit(0.05), F.least(F.lit(0.99), total)))


def tag_status(confidence: Column, age_days: Column) -> Column:
    """Stale beyond 1095 days; verified needs a date and 0.75; partial from 0.40 on."""
    return F.when(age_days > 1095, "stale").when(age_days.isNotNull() & (confidence >= 0.75), "verified").when(confidence >= 0.40, "partial").otherwise("unverified")


def _kerb(t: Column) -> Column:
    """Metres: a measured height, else by the kerb's word, else that of a kerb barrier; null if nothing tells it."""
    measured = parse_metres(first_tag(t, "kerb:height", "sidewalk:kerb:height", "sidewalk:left:kerb:height", "sidewalk:right:kerb:height", "sloped_curb:height"))
    word = F.lower(first_tag(t, "kerb", "sidewalk:kerb", "sidewalk:left:kerb", "sidewalk:right:kerb"))
    by_word = F.when(F.lower(t["barrier"]) == "kerb", 0.10)
    for name, metres in KERB_METRES.items():
        by_word = F.when(word == name, metres).otherwise(by_word)
    return F.coalesce(measured, by_word)


def _curb_ramp(t: Column, kerb: Column) -> Column:
    word = F.lower(first_tag(t, "kerb", "sidewalk:kerb", "sidewalk:left:kerb", "sidewalk:right:kerb"))
    by_word = F.when(word.isin("flush", "lowered", "rolled", "no"), True).when(word == "raised", False).when(kerb > 0.03, False)
    return F.coalesce(flag(F.lower(first_tag(t, "sloped_curb", "sidewalk:sloped_curb"))), by_word)


def _percent(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("%"), F.lit(""))).try_cast("double")


def _photos(t: Column, verified: Column) -> Column:
    caption, status = first_tag(t, "description", "note"), F.when(verified.isNotNull(), "osm-tagged").otherwise("unverified")

    def photo(source: str, url: Column) -> Column:
        return F.when(url.isNotNull(), made(PHOTO, {"source": F.lit(source), "url": url, "caption": caption, "taken_at": verified, "verification_status": status}))

    key = first_tag(t, "mapillary", "mapillary:image")
    coded = F.url_encode(key)
    for ours, theirs in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(ours), F.lit(theirs))
    link = F.when(F.lower(key).startswith("http"), key).otherwise(F.concat(F.lit("https://www.mapillary.com/app/?pKey="), coded))
    found = (photo("osm-image", first_tag(t, "image")), photo("wikimedia-commons", first_tag(t, "wikimedia_commons")), photo("mapillary", link))
    return F.array_compact(F.array(*found))


def with_profile(places: DataFrame, generated_at: Column, source_system: str = "osm") -> DataFrame:
    """``places`` (tags, asset_type, observed_at, ...) with ``profile``: path, entrances, restrooms, photos, missing fields, evidence, confidence, state.

    Tag names count in any case, blank tags not at all. The last verification is that of the date tags, else ``observed_at``; both may be null.
    A null map of tags or a null type counts as empty.
    """
    kind = F.lower(F.coalesce("asset_type", F.lit("")))
    df = places.withColumn("__t", normalized(F.coalesce("tags", F.create_map().cast("map<string,string>")), fold=True))
    t = F.col("__t")
    any_of = lambda *keys: first_tag(t, *keys).isNotNull()
    word = lambda *keys: F.lower(first_tag(t, *keys))
    yes = lambda *keys: flag(word(*keys))
    metres = lambda *keys: parse_metres(first_tag(t, *keys))
    is_ = lambda key, value: F.coalesce(F.lower(t[key]) == value, F.lit(False))

    verified = F.coalesce(day(first_tag(t, "check_date", "survey:date", "lastcheck", "last_checked", "source:date")), F.col("observed_at"))
    df = df.withColumns({"__kerb": _kerb(t), "__verified": verified, "__generated": generated_at})
    kerb, verified = F.col("__kerb"), F.col("__verified")
    stairs = is_("highway", "steps") | any_of("step_count", "steps")
    barrier = F.coalesce(F.when(is_("barrier", "kerb"), F.coalesce(kerb, F.lit(0.10)) > 0.05).otherwise(F.lower(t["barrier"]).isin(*BLOCKING)), F.lit(False))
    step_free = F.coalesce(yes("wheelchair", "wheelchair:access"), F.when(stairs | barrier | F.coalesce(kerb > 0.03, F.lit(False)), False))
    incline = word("incline", "ramp:incline")
    path = made(PATH, {
        "surface": word("surface", "sidewalk:surface"), "smoothness": word("smoothness", "sidewalk:smoothness"), "width_metres": metres("width", "sidewalk:width", "est_width"),
        "kerb_height_metres": kerb, "incline_percent": _percent(incline), "incline_text": incline, "has_tactile_paving": yes("tactile_paving", "sidewalk:tactile_paving"),
        "has_curb_ramp": _curb_ramp(t, kerb), "has_step_free_access": step_free, "has_stairs": stairs, "has_barrier": barrier, "wheelchair_access": word("wheelchair", "wheelchair:access"),
        "lighting": word("lit"), "crossing_type": word("crossing", "crossing:island", "footway"), "access": word("access", "foot"),
    })
    building = kind.startswith("amenity:") | kind.startswith("public_transport:") | kind.startswith("railway:") | (kind == "highway:elevator")
    entrance = made(ENTRANCE, {
        "name": first_tag(t, "name", "entrance:name"), "entrance_type": word("entrance", "highway"), "step_free": step_free, "has_ramp": yes("ramp", "wheelchair:ramp"),
        "door_width_metres": metres("door:width", "entrance:width", "width"), "automatic_door": yes("automatic_door"), "step_height_metres": metres("step:height", "kerb:height"),
    })
    has_entrance = building | any_of("entrance", "door:width", "entrance:width", "automatic_door", "ramp", "step_count", "step:height")
    genders = F.array_compact(F.array(F.when(yes("male", "toilets:male"), "male"), F.when(yes("female", "toilets:female"), "female")))
    restroom = made(RESTROOM, {
        "wheelchair_accessible": yes("toilets:wheelchair", "wheelchair"), "has_grab_bars": yes("toilets:grab_bar", "toilets:grab_rails", "grab_bar"),
        "door_width_metres": metres("toilets:door:width", "door:width"), "turning_space_metres": metres("toilets:turning_space", "toilets:turning_circle"),
        "has_changing_table": yes("changing_table", "toilets:changing_table"),
        "requires_key": F.when(word("toilets:access", "access").isin("key", "customers", "private") | F.coalesce(yes("fee", "toilets:fee"), F.lit(False)), True),
        "gender_access": F.when(F.coalesce(yes("unisex", "toilets:unisex"), F.lit(False)), "unisex").when(F.size(genders) > 0, F.array_join(genders, ";")),
    })
    has_restroom = is_("amenity", "toilets") | (kind == "amenity:toilets") | any_of("toilets:wheelchair", "toilets:door:width", "toilets:grab_bar", "toilets:grab_rails")

    walked = kind.startswith("highway:") | kind.startswith("barrier:") | any_of("highway", "footway", "crossing", "kerb", "sidewalk", "surface", "width", "incline", "tactile_paving")
    entered = building | any_of("entrance", "door:width", "automatic_door", "ramp")
    gaps = [F.when(verified.isNull(), "last_verified_at")]
    for applies, fields in ((walked, PEDESTRIAN_GAPS), (entered, ENTRANCE_GAPS), (has_restroom, RESTROOM_GAPS)):
        gaps += [F.when(applies & ~any_of(*keys), name) for name, keys in fields.items()]
    listed = lambda has, one, fields: F.when(has, F.array(one)).otherwise(F.array().cast(f"array<{type_of(fields)}>"))
    df = df.withColumns({
        "__path": path, "__entrances": listed(has_entrance, entrance, ENTRANCE), "__restrooms": listed(has_restroom, restroom, RESTROOM), "__photos": _photos(t, verified),
        "__missing": F.array_sort(F.array_compact(F.array(*gaps))), "__evidence": F.map_filter(t, lambda k, v: k.isin(*EVIDENCE)),
    })
    age = (F.unix_seconds("__generated") - F.unix_seconds("__verified")) / DAY
    known, missing = F.size("__evidence"), F.size("__missing")
    share = F.when(known + missing > 0, known / (known + missing)).otherwise(0.0)
    df = df.withColumn("__confidence", tag_confidence(share, age, F.size("__photos"), F.size("__t")))
    profile = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(source_system).alias("source_system"), F.col("__generated").alias("profile_generated_at"), F.col("__verified").alias("last_verified_at"),
        tag_status(F.col("__confidence"), age).alias("verification_status"), F.col("__confidence").alias("confidence"), F.col("__path").alias("path"), F.col("__entrances").alias("entrances"),
        F.col("__restrooms").alias("restrooms"), F.col("__photos").alias("photos"), F.col("__missing").alias("missing_fields"), F.col("__evidence").alias("evidence_tags"), F.size("__t").alias("raw_tag_count"),
    )
    return df.select(*places.columns, profile.alias("profile"))


# merging

#: Least and most of a measure that people may give.
LIMITS = {
    "path": {"width_metres": (0.3, 10), "kerb_height_metres": (0, 0.5), "incline_percent": (-30, 30)}, "entrance": {"door_width_metres": (0.3, 3), "step_height_metres": (0, 0.5)},
    "restroom": {"door_width_metres": (0.3, 3), "turning_space_metres": (0.5, 4)},
}
PARTS = {"path": PATH, "entrance": ENTRANCE, "restroom": RESTROOM}
UPDATE_PHOTO = {"url": "string", "source": "string", "caption": "string", "taken_at": "timestamp"}


def combined(updates: DataFrame) -> DataFrame:
    """One row an asset of ``updates`` (update_id, asset_id, source, observed_at, path, entrance, restroom, photos): of every field the last known value.

    "Last" goes by observation time (none first), then by update_id. Aggregated field by field, so an asset with very many updates is
    combined before the shuffle; only photos are gathered, one for each web address (any case), the earliest.
    """
    order = "struct(observed_at is not null, observed_at, update_id)"
    out = [F.max("observed_at").alias("observed_at")]
    for part, fields in PARTS.items():
        last = [F.expr(f"max_by({part}.{f}, {order}) filter (where {part}.{f} is not null)").alias(f) for f in fields]
        out += [F.struct(*last).alias(part), F.max(F.col(part).isNotNull()).alias(f"has_{part}")]
    fields = updates.groupBy("asset_id").agg(*out)
    for part, limits in LIMITS.items():
        for f, (low, high) in limits.items():
            within = F.round(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(part)[f])), 3)
            fields = fields.withColumn(part, F.col(part).withField(f, F.when(F.col(part)[f].isNotNull(), within)))
    shown = updates.select("asset_id", "update_id", F.col("source").alias("by"), "observed_at", F.posexplode("photos").alias("at", "photo")).where("trim(photo.url) <> ''")
    named = F.when(F.trim("photo.source") != "", F.col("photo.source")).otherwise(F.col("by"))
    one = made(PHOTO, {"source": named, "url": F.col("photo.url"), "caption": F.col("photo.caption"), "taken_at": F.coalesce("photo.taken_at", "observed_at"), "verification_status": F.lit("field-verified")})
    rank = F.struct(F.col("observed_at").isNotNull().alias("known"), "observed_at", "update_id", "at").alias("rank")
    shown = shown.select("asset_id", F.lower("photo.url").alias("url"), rank, one.alias("photo")).groupBy("asset_id", "url").agg(F.min_by("photo", "rank").alias("photo"), F.min("rank").alias("rank"))
    shown = shown.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url", "photo"))), lambda x: x["photo"]).alias("photos"))
    return fields.join(shown, "asset_id", "left")


def merged(profiles: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """``profiles`` (asset_id, profile) with the updates laid over them: known values win, unknown ones leave what is there.

    The first entrance and the first restroom take the update's (one is added where there is none), the others stay; photos are united by
    address. Missing fields, confidence (never less than before) and state are worked out again. Assets without an update stay as they are,
    updates of unknown assets go.
    """
    u = combined(updates).withColumnsRenamed({c: f"u_{c}" for c in ("observed_at", "path", "entrance", "restroom", "photos", "has_path", "has_entrance", "has_restroom")})
    df = profiles.join(u.withColumn("touched", F.lit(True)), "asset_id", "left").withColumn("now", now)
    p = F.col("profile")
    over = lambda fields, new, old: F.struct(*[F.coalesce(new[f], old[f]).alias(f) for f in fields])
    tail = lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
    head = lambda has, fields, new, x: F.when(has, F.concat(F.array(over(fields, new, F.get(x, F.lit(0)))), tail(x))).otherwise(x)
    old_urls = F.transform(p["photos"], lambda x: F.lower(x["url"]))
    fresh = F.filter(F.coalesce("u_photos", F.array().cast(f"array<{type_of(PHOTO)}>")), lambda x: ~F.array_contains(old_urls, F.lower(x["url"])))
    df = df.withColumns({
        "path": F.when(F.col("u_has_path"), over(PATH, F.col("u_path"), p["path"])).otherwise(p["path"]), "entrances": head(F.col("u_has_entrance"), ENTRANCE, F.col("u_entrance"), p["entrances"]),
        "restrooms": head(F.col("u_has_restroom"), RESTROOM, F.col("u_restroom"), p["restrooms"]), "photos": F.concat(p["photos"], fresh),
        "verified": F.coalesce(F.greatest(p["last_verified_at"], F.col("u_observed_at")), F.col("now")),
    })
    path, door, room = F.col("path"), F.get("entrances", F.lit(0)), F.get("restrooms", F.lit(0))
    in_path = {
        "surface": path["surface"].isNotNull(), "smoothness": path["smoothness"].isNotNull(), "width_metres": path["width_metres"].isNotNull(),
        "kerb": path["kerb_height_metres"].isNotNull() | path["has_curb_ramp"].isNotNull(), "tactile_paving": path["has_tactile_paving"].isNotNull(),
        "incline_percent": path["incline_percent"].isNotNull() | path["incline_text"].isNotNull(),
    }
    in_door = {"door_width_metres": door["door_width_metres"], "wheelchair_access": door["step_free"]}
    in_room = {"toilets_wheelchair_access": room["wheelchair_accessible"], "toilets_door_width_metres": room["door_width_metres"], "toilets_grab_bars": room["has_grab_bars"], "changing_table": room["has_changing_table"]}
    gaps = [F.when(~known, name) for name, known in in_path.items()]
    gaps += [F.when((F.size("entrances") > 0) & value.isNull(), name) for name, value in in_door.items()]
    gaps += [F.when((F.size("restrooms") > 0) & value.isNull(), name) for name, value in in_room.items()]
    signals = sum((known.cast("int") for known in in_path.values()), F.lit(0)) + F.when(F.size("entrances") > 0, 2).otherwise(0) + F.when(F.size("restrooms") > 0, 3).otherwise(0)
    df = df.withColumns({"missing": F.array_sort(F.array_compact(F.array(*gaps))), "signals": signals})
    total = F.col("signals") + F.size("missing")
    share = F.when(total > 0, F.col("signals") / total).otherwise(0.0)
    fresh = F.when(F.unix_seconds("now") - F.unix_seconds("verified") <= 365 * DAY, 0.20).otherwise(0.05)
    df = df.withColumn("sure", half_even_3(F.greatest(F.lit(0.05), F.least(F.lit(0.99), 0.15 + share * 0.65 + fresh + F.least(F.lit(0.10), F.size("photos") * 0.05)))))
    values = {
        "profile_generated_at": F.col("now"), "last_verified_at": F.col("verified"), "verification_status": F.when(F.col("sure") >= 0.75, "verified").otherwise("partial"),
        "confidence": F.greatest(p["confidence"], F.col("sure")), "path": path, "entrances": F.col("entrances"), "restrooms": F.col("restrooms"), "photos": F.col("photos"), "missing_fields": F.col("missing"),
    }
    names = profiles.schema["profile"].dataType.names
    new = F.struct(*[values.get(n, p[n]).alias(n) for n in names])
    touched = F.coalesce("touched", F.lit(False))
    return df.select("asset_id", F.when(touched, new).otherwise(p).alias("profile"), touched.alias("touched"))
