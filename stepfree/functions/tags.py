"""Map tags (map<string,string> columns) to values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Barriers that block a way, kerb words with their height in metres.
BLOCKING = ("wall", "fence", "gate", "stile", "turnstile", "cycle_barrier", "block", "chain")
KERB_METRES = {"flush": 0.0, "lowered": 0.0, "no": 0.0, "rolled": 0.03, "raised": 0.10}


def first_tag(tags: Column, *keys: str) -> Column:
    """The first of ``keys`` with a value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.element_at(tags, F.lit(k))), F.lit("")) for k in keys])


def normalized(tags: Column, fold: bool = False) -> Column:
    """Keys (in lower case with ``fold``) and values without white space around them; blank ones go, and of keys that become equal the last stays."""
    name = (lambda k: F.lower(F.trim(k))) if fold else F.trim
    kept = F.filter(F.map_entries(tags), lambda e: (F.trim(e["key"]) != "") & (F.trim(e["value"]) != ""))
    trimmed = F.transform(kept, lambda e: F.struct(name(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    last = F.filter(trimmed, lambda e, i: ~F.exists(F.slice(trimmed, i + 2, F.greatest(F.size(trimmed) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    keys = F.transform(trimmed, lambda e: e["key"])
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), trimmed).otherwise(last))


def parse_metres(text: Column) -> Column:
    """First of a ;-list, decimal comma allowed, in mm, cm or m; null if it is no number."""
    first = F.trim(F.split(F.regexp_replace(F.lower(text), r"^[;\s]+", ""), ";")[0])
    form = r"^([0-9]+(?:[.,][0-9]+)?)\s*(mm|cm|m|met(?:re|er)s?)?$"
    number = F.regexp_replace(F.regexp_extract(first, form, 1), ",", ".").try_cast("double")
    unit = F.regexp_extract(first, form, 2)
    return number * F.when(unit == "mm", 0.001).when(unit == "cm", 0.01).otherwise(1.0)


def kerb_height(tags: Column) -> Column:
    """Metres: a measured height, else by the kerb's word, else by a sloped curb, else that of a kerb barrier, else 0."""
    measured = parse_metres(first_tag(tags, "kerb:height", "sidewalk:kerb:height", "sidewalk:left:kerb:height", "sidewalk:right:kerb:height", "sloped_curb:height"))
    word = F.lower(first_tag(tags, "kerb", "sidewalk:kerb", "sidewalk:left:kerb", "sidewalk:right:kerb"))
    by_word = F.lit(0.05)
    for name, metres in KERB_METRES.items():
        by_word = F.when(word == name, metres).otherwise(by_word)
    sloped = F.lower(first_tag(tags, "sloped_curb", "sidewalk:sloped_curb"))
    by_slope = F.when(sloped.isin("yes", "true", "1"), 0.02).otherwise(0.10)
    barrier = F.when(F.lower(F.element_at(tags, F.lit("barrier"))) == "kerb", 0.10).otherwise(0.0)
    return F.coalesce(measured, F.when(word.isNotNull(), by_word), F.when(sloped.isNotNull(), by_slope), barrier)


def blocking_barrier(tags: Column) -> Column:
    """A barrier that blocks the way; a kerb does above 5 cm."""
    barrier = F.lower(F.trim(F.element_at(tags, F.lit("barrier"))))
    return F.coalesce(F.when(barrier == "kerb", kerb_height(tags) > 0.05).otherwise(barrier.isin(*BLOCKING)), F.lit(False))


def _is(tags: Column, key: str, value: str) -> Column:
    return F.coalesce(F.lower(F.element_at(tags, F.lit(key))) == value, F.lit(False))


def crossing(tags: Column) -> Column:
    return _is(tags, "highway", "crossing") | _is(tags, "footway", "crossing") | F.map_contains_key(tags, "crossing")


def under_construction(tags: Column) -> Column:
    return _is(tags, "highway", "construction") | F.map_contains_key(tags, "construction") | _is(tags, "access", "no")


#: Highways that are assets.
ASSET_HIGHWAYS = ("elevator", "crossing", "bus_stop")


def asset_type(tags: Column) -> Column:
    """Kind of a place as key:value by the first of amenity, public_transport, railway, some highways (any case), barrier; null without one."""
    named = lambda key: F.concat(F.lit(f"{key}:"), F.element_at(tags, F.lit(key)))
    highway = F.when(F.lower(F.element_at(tags, F.lit("highway"))).isin(*ASSET_HIGHWAYS), named("highway"))
    return F.coalesce(named("amenity"), named("public_transport"), named("railway"), highway, named("barrier"))


def steep(incline: Column) -> Column:
    """Up, down or steep, or at least 8 percent either way; anything that is no number is not steep."""
    word = F.lower(F.trim(incline))
    percent = F.trim(F.replace(word, F.lit("%"), F.lit(""))).try_cast("double")
    return F.coalesce(word.isin("up", "down", "steep"), F.lit(False)) | F.coalesce((F.abs(percent) >= 8) & ~F.isnan(percent), F.lit(False))
