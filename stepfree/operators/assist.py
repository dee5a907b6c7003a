"""Suggested attributes in canonical words, review checklists, explanations, prompts, projections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepfree.functions import geo, risk
from stepfree.functions import sqltext as sql
from stepfree.functions.profile import half_even_3
from stepfree.operators.filters import edges, hazards
from stepfree.operators.graph import graph
from stepfree.operators.reports import REPORTS, has_any, reports, suggested_type
from stepfree.operators.reports import _TYPE as TYPE_SQL
from stepfree.registry import query
from stepfree.spatial import within_distance
from stepfree.views import register, with_views

# ---------------------------------------------------------------- canonical attributes

#: The attribute for words in a suggestion's attribute and value; of the first row all of whose groups have a word there.
ATTRIBUTE_WORDS = (
    ("toilets:grab_bar", (("toilet", "restroom", "bathroom"), ("grab", "rail", "bar"))),
    ("toilets:wheelchair", (("toilet", "restroom", "bathroom"), ("wheelchair", "accessible"))),
    ("curb_ramp", (("curb_ramp", "kerb_ramp", "curb_cut", "dropped_kerb", "lowered_kerb"),)),
    ("kerb_height_metres", (("kerb", "curb"),)),
    ("door_width_metres", (("door_width",),)),
    ("width_metres", (("width", "narrow"),)),
    ("surface", (("surface", "material", "concrete", "asphalt", "gravel", "cobblestone", "paving", "mud", "grass", "dirt"),)),
    ("smoothness", (("smoothness", "condition", "uneven", "broken", "cracked", "bumpy", "pothole"),)),
    ("incline", (("incline", "slope", "grade", "gradient", "steep"),)),
    ("tactile_paving", (("tactile", "truncated_domes"),)),
    ("automatic_door", (("automatic_door", "powered_door"),)),
    ("changing_table", (("changing_table", "baby_change"),)),
    ("obstacle", (("obstacle", "blocked", "blocking", "barrier"),)),
    ("crosswalk", (("crosswalk", "crossing", "zebra"),)),
    ("step_free_access", (("step_free", "stairs", "steps", "stairway"),)),
    ("wheelchair", (("wheelchair",),)),
)
#: Attributes that are true or false.
YES_NO = ("curb_ramp", "tactile_paving", "step_free_access", "automatic_door", "toilets:wheelchair", "toilets:grab_bar", "changing_table", "obstacle", "crosswalk")
#: Attributes, words in the value, canonical value; the first row that fits.
VALUE_WORDS = (
    (YES_NO, ("absent", "no", "none", "false", "missing", "blocked", "stairs", "steps"), "false"),
    (YES_NO, ("present", "yes", "true", "available", "lowered", "flush", "dropped"), "true"),
    (("wheelchair",), ("no", "false", "stairs", "steps", "blocked"), "no"),
    (("wheelchair",), ("yes", "true", "accessible"), "yes"),
    (("kerb_height_metres",), ("raised", "high", "present", "tall"), ">0.06"),
    (("kerb_height_metres",), ("flush", "lowered", "dropped", "zero"), "0"),
    (("width_metres", "door_width_metres"), ("narrow", "tight", "measure", "unknown"), "measure_clear_width"),
    (("surface",), ("concrete",), "concrete"),
    (("surface",), ("asphalt",), "asphalt"),
    (("surface",), ("gravel",), "gravel"),
    (("surface",), ("cobblestone",), "cobblestone"),
    (("surface",), ("paving",), "paving_stones"),
    (("surface",), ("mud",), "mud"),
    (("surface",), ("grass",), "grass"),
    (("surface",), ("dirt",), "dirt"),
    (("smoothness",), ("uneven", "broken", "cracked", "bumpy", "pothole", "loose", "bad", "poor"), "bad"),
    (("smoothness",), ("smooth", "flat", "even", "good"), "good"),
)


def token(text: Column) -> Column:
    """Lower case; runs of anything but letters, digits and colons become one underscore, none at the ends; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}:]+", "_"), "^_+|_+$", "")


def candidate_attribute(attribute: Column, value: Column) -> Column:
    """The canonical attribute of a suggestion; without any known word its own token, or ``unknown`` if that is empty."""
    own = token(attribute)
    joined = F.concat(own, F.lit(" "), token(value))
    out = F.when(own == "", "unknown").otherwise(own)
    for name, groups in reversed(ATTRIBUTE_WORDS):
        hit = F.lit(True)
        for words in groups:
            hit = hit & has_any(joined, words)
        if name == "curb_ramp":
            hit = hit | (own == "ramp")
        out = F.when(hit, name).otherwise(out)
    return out


def candidate_value(attribute: Column, value: Column) -> Column:
    """The canonical value for a canonical attribute; without a known word its own token, ``verify`` if that is empty."""
    own = token(value)
    out = own
    for attributes, words, name in reversed(VALUE_WORDS):
        out = F.when(attribute.isin(*attributes) & has_any(own, words), name).otherwise(out)
    return F.when(own == "", "verify").otherwise(out)


def candidate_confidence(confidence: Column) -> Column:
    """Between 0 and 0.95 to three places; 0 if it is not finite or not there."""
    finite = confidence.isNotNull() & ~F.isnan(confidence) & (F.abs(confidence) < float("inf"))
    return F.when(finite, half_even_3(F.greatest(F.lit(0.0), F.least(F.lit(0.95), confidence)))).otherwise(0.0)


def normalized_candidates(df: DataFrame, default_evidence: str) -> DataFrame:
    """Rows with attribute, value, confidence and evidence in canonical form; other columns stay."""
    named = df.withColumn("attribute", candidate_attribute(F.col("attribute"), F.col("value")))
    valued = named.withColumn("value", candidate_value(F.col("attribute"), F.col("value"))).withColumn("confidence", candidate_confidence(F.col("confidence")))
    evidence = F.trim(F.coalesce(F.col("evidence"), F.lit("")))
    return valued.withColumn("evidence", F.when(evidence == "", default_evidence).otherwise(evidence))


_SAID = (
    "Kerb ramp", "Ramp", "curb  height", "Door width (cm)", "Clear width", "Surface", "Material!", "Condition", "Slope", "Tactile paving", "Automatic-Door", "Changing table", "Barrier", "Zebra crossing",
    "Steps", "Wheelchair", "Toilet grab rail", "Accessible restroom", "Opening hours", "", "toilets",
)
_SEEN = ("Raised", "flush ", "No", "YES", "very narrow", "Gravel & mud", "cracked, uneven", "paving stones", "", "not present", "smooth", "blocked by stairs", "unknown", "12 %", "accessible", "wheelchair: yes")
_SUGGESTED = f"""select id, case id % {len(_SAID)} {' '.join(f"when {k} then '{w}'" for k, w in enumerate(_SAID))} end as attribute,
 case id % {len(_SEEN)} {' '.join(f"when {k} then '{w}'" for k, w in enumerate(_SEEN))} end as value, amount / 40e0 as confidence, case when id % 5 = 0 then '  ' else ' ' || hazard_type || ' ' end as evidence from hazard"""


def _sql_token(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{Nd}}:]+', '_', 'g'), '_')"


def _sql_any(text: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({text}, '{'|'.join(words)}')"


_SQL_ATTRIBUTE = "case " + " ".join(f"when {' and '.join(_sql_any('j', w) for w in groups)}{' or a = $$ramp$$' if name == 'curb_ramp' else ''} then '{name}'" for name, groups in ATTRIBUTE_WORDS) + " when a = '' then 'unknown' else a end"
_SQL_VALUE = "case when v = '' then 'verify' " + " ".join(f"when attribute in ({sql.quoted(names)}) and {_sql_any('v', words)} then '{name}'" for names, words, name in VALUE_WORDS) + " else v end"


@query(
    "str_normalize_candidate",
    with_views(f"""with s as ({_SUGGESTED}), t as (select *, {_sql_token('attribute')} as a, {_sql_token('value')} as v from s), j as (select *, a || ' ' || v as j from t),
n as (select id, {_SQL_ATTRIBUTE} as attribute, v, round(1000000 * greatest(0e0, least(0.95e0, confidence)))::bigint as u, evidence from j)
select id, attribute, {_SQL_VALUE} as value, (u // 1000 + if(u % 1000 > 500 or (u % 1000 = 500 and (u // 1000) % 2 = 1), 1, 0)) / 1000e0 as confidence,
 case when trim(evidence) = '' then 'Reported without evidence.' else trim(evidence) end as evidence from n"""),
)
def str_normalize_candidate(spark, sf_dir):
    """Suggestions in free words, one for each report, in canonical form."""
    register(spark, sf_dir, "hazard")
    return normalized_candidates(spark.sql(_SUGGESTED), "Reported without evidence.").select("id", "attribute", "value", "confidence", "evidence")


def best_candidates(df: DataFrame, keys: list[str], least: float = 0.35, most: int = 12) -> DataFrame:
    """Of each attribute (any case) of a key the most certain candidate (ties: smaller id); of these, from ``least`` on, the ``most`` best (ties: attribute), with ``rank``."""
    first = F.max_by(F.struct("attribute", "value", "confidence", "id"), F.struct("confidence", (-F.col("id")).alias("i")))
    best = df.groupBy(*keys, F.lower("attribute").alias("__a")).agg(first.alias("c")).select(*keys, "c.*").where(F.col("confidence") >= least)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("confidence"), "attribute"))  # a row for each attribute at most
    return best.withColumn("rank", rank).where(F.col("rank") <= most)


@query(
    "agg_group_argmax",
    with_views(f"""with s as (select s.*, h.reporter from ({_SUGGESTED}) s join hazard h on h.id = s.id), t as (select *, {_sql_token('attribute')} as a, {_sql_token('value')} as v from s), j as (select *, a || ' ' || v as j from t),
n as (select reporter, id, {_SQL_ATTRIBUTE} as attribute, v, round(1000000 * greatest(0e0, least(0.95e0, confidence)))::bigint as u from j),
c as (select reporter, id, attribute, {_SQL_VALUE} as value, (u // 1000 + if(u % 1000 > 500 or (u % 1000 = 500 and (u // 1000) % 2 = 1), 1, 0)) / 1000e0 as confidence from n),
b as (select * from c qualify row_number() over (partition by reporter, attribute order by confidence desc, id) = 1)
select reporter, attribute, value, confidence, row_number() over (partition by reporter order by confidence desc, attribute)::int as rank from b where confidence >= 0.35e0 qualify rank <= 12"""),
)
def agg_group_argmax(spark, sf_dir):
    """Of all that a reporter suggested the twelve most certain attributes."""
    register(spark, sf_dir, "hazard")
    rows = spark.sql(_SUGGESTED).join(spark.table("hazard").select("id", "reporter"), "id")
    return best_candidates(normalized_candidates(rows, ""), ["reporter"]).select("reporter", "attribute", "value", "confidence", "rank")


# ---------------------------------------------------------------- gaps, checklists, chips

#: What to ask for where fields of a profile are missing, by falling confidence: attribute, value, confidence, fields.
GAPS = (
    ("curb_ramp", "verify_flush_or_lowered", 0.80, ("kerb", "curb_ramp")),
    ("width_metres", "measure_clear_width", 0.78, ("width_metres", "door_width_metres", "toilets_door_width_metres")),
    ("toilets:wheelchair", "verify_accessible_toilet_features", 0.76, ("toilets_wheelchair_access", "toilets_grab_bars")),
    ("surface", "verify_material", 0.74, ("surface",)),
    ("smoothness", "verify_surface_quality", 0.72, ("smoothness",)),
    ("last_verified_at", "field_verify", 0.70, ("last_verified_at",)),
    ("incline", "measure_percent_grade", 0.68, ("incline_percent",)),
    ("tactile_paving", "verify_present_absent", 0.64, ("tactile_paving",)),
)
#: Asked for where a profile has no photo.
PHOTO_GAP = ("photos", "add_field_photo", 0.62)
#: The sentence of a checklist for an attribute.
CHECKS = {
    "surface": "Record the sidewalk or facility surface material using controlled values such as asphalt, concrete, paving_stones, gravel, or cobblestone.",
    "smoothness": "Record surface smoothness from excellent/good/intermediate/bad/very_bad based on wheel and mobility-aid comfort.",
    "width_metres": "Measure the narrowest clear passable width in metres, not the nominal pavement width.",
    "curb_ramp": "At crossings, verify whether kerbs are flush/lowered/rolled/raised and estimate kerb height if raised.",
    "incline": "Measure or estimate grade percentage and note if slope direction is unclear.",
    "tactile_paving": "Mark tactile paving as present or absent at crossing decision points.",
    "toilets:wheelchair": "Verify wheelchair access, door width, grab bars, turning space, key requirement, and changing table.",
    "photos": "Attach a clear field photo of the entrance, crossing, toilet, or obstruction without exposing private personal data.",
}
LOW_CONFIDENCE = "Treat this profile as low confidence until at least one recent field verification is applied."


def gap_candidates(missing: Column, photos: Column, least_confidence: float = 0.35) -> Column:
    """Array of (attribute, value, confidence) to review, most certain first, from missing fields (any case) and the number of photos."""
    fields = F.transform(F.coalesce(missing, F.array().cast("array<string>")), lambda m: F.lower(m))

    def item(attribute: str, value: str, confidence: float) -> Column:
        return F.struct(F.lit(attribute).alias("attribute"), F.lit(value).alias("value"), F.lit(confidence).alias("confidence"))

    rows = [F.when(F.arrays_overlap(fields, F.array(*[F.lit(n) for n in names])), item(a, v, c)) for a, v, c, names in GAPS if c >= least_confidence]
    rows.append(F.when(F.coalesce(photos, F.lit(0)) == 0, item(*PHOTO_GAP)))
    return F.array_compact(F.array(*rows))


def checklist(candidates: Column, confidence: Column) -> Column:
    """A sentence for each of the first eight candidates, and a warning below a confidence of 0.6."""
    table = F.create_map(*[F.lit(x) for pair in CHECKS.items() for x in pair])
    lines = F.transform(F.slice(candidates, 1, 8), lambda c: F.coalesce(F.element_at(table, c["attribute"]), F.format_string("Verify %s with direct field evidence.", c["attribute"])))
    return F.when(confidence < 0.6, F.concat(lines, F.array(F.lit(LOW_CONFIDENCE)))).otherwise(lines)


def review_summary(status: Column, confidence: Column, missing: Column, candidates: Column, lines: Column) -> Column:
    return F.format_string(
        "Accessibility profile %s at confidence %.2f; %d missing field(s), %d review candidate(s), %d checklist item(s).", status, confidence, F.size(missing), F.size(candidates), F.size(lines)
    )


def edge_gaps(ways: DataFrame) -> DataFrame:
    """Edges with the fields of a profile that their data leave open (``missing``), the known share's confidence and a status."""
    c = F.col
    gaps = (
        (c("surface") == "unknown", "surface"), (c("smoothness").isNull(), "smoothness"), (c("width_m").isNull(), "width_metres"), (c("has_crossing") & (c("kerb_height") == 0), "kerb"),
        (~c("is_steep"), "incline_percent"), (c("has_crossing"), "tactile_paving"), (c("access").isNull(), "last_verified_at"),
    )
    missing = F.array_compact(F.array(*[F.when(is_open, name) for is_open, name in gaps]))
    confidence = F.round(0.10 + 0.85 * (len(gaps) - F.size("missing")) / len(gaps), 2)
    named = ways.withColumn("missing", missing).withColumn("confidence", confidence)
    return named.withColumn("status", F.when(c("confidence") >= 0.6, "partial").otherwise("unverified"))


_EDGE_GAPS = """g as (select id, id % 3 as photos, list_filter([if(surface = 'unknown', 'surface', null), if(smoothness is null, 'smoothness', null), if(width_m is null, 'width_metres', null), if(has_crossing and kerb_height = 0, 'kerb', null),
 if(not is_steep, 'incline_percent', null), if(has_crossing, 'tactile_paving', null), if(access is null, 'last_verified_at', null)], lambda x: x is not null) as missing from edge),
h as (select *, round(0.10e0 + 0.85e0 * (7 - len(missing)) / 7, 2) as confidence from g)"""
_GAP_LIST = "list_filter([" + ", ".join(f"if(list_has_any(missing, [{sql.quoted(names)}]), '{a}', null)" for a, _, _, names in GAPS) + ", if(photos = 0, 'photos', null)], lambda x: x is not null)"


def _sql_checks(x: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in CHECKS.items()) + f" else 'Verify ' || {x} || ' with direct field evidence.' end"


@query("str_candidate_gaps", with_views(f"""with {_EDGE_GAPS}, c as (select id, unnest({_GAP_LIST}) as attribute from h)
select id, attribute, case attribute {' '.join(f"when '{a}' then '{v}'" for a, v, *_ in (*GAPS, PHOTO_GAP))} end as value, case attribute {' '.join(f"when '{a}' then {c}e0" for a, _, c, *_ in (*GAPS, PHOTO_GAP))} end as confidence from c"""))
def str_candidate_gaps(spark, sf_dir):
    """What to review at every edge, from the fields that are missing."""
    rows = edge_gaps(edges(spark, sf_dir))
    return rows.select("id", F.inline(gap_candidates(F.col("missing"), F.col("id") % 3)))


@query("str_checklist", with_views(f"""with {_EDGE_GAPS}, c as (select *, {_GAP_LIST} as found from h), l as (select *, list_transform(found[1:8], lambda x: {_sql_checks('x')}) || if(confidence < 0.6e0, ['{LOW_CONFIDENCE}'], []) as lines from c)
select id, array_to_string(lines, chr(10)) as checklist, printf('Accessibility profile %s at confidence %.2f; %d missing field(s), %d review candidate(s), %d checklist item(s).',
 if(confidence >= 0.6e0, 'partial', 'unverified'), confidence, len(missing), len(found), len(lines)) as summary from l"""))
def str_checklist(spark, sf_dir):
    """What to check in the field at every edge, and one line for reviewers."""
    rows = edge_gaps(edges(spark, sf_dir)).withColumn("found", gap_candidates(F.col("missing"), F.col("id") % 3)).withColumn("lines", checklist(F.col("found"), F.col("confidence")))
    return rows.select("id", F.array_join("lines", "\n").alias("checklist"), review_summary(F.col("status"), F.col("confidence"), F.col("missing"), F.col("found"), F.col("lines")).alias("summary"))


#: Descriptions offered for a suggested type; the last row is for any other type.
CHIPS = {
    "missing_curb_ramp": ("Raised kerb blocks wheelchair access", "No dropped kerb at this crossing", "Curb ramp is blocked"),
    "stairs": ("Steps block step-free access", "No ramp visible nearby", "Needs a step-free detour"),
    "obstruction": ("Pavement is blocked", "Wheelchair cannot pass safely", "Temporary obstruction in walkway"),
    "surface_quality": ("Uneven pavement is hard to pass", "Loose surface affects wheels", "Surface damage needs review"),
    "low_lighting": ("Street light is out", "Poor lighting after dark", "Visibility feels unsafe"),
    "": ("Hard to pass safely", "May affect wheelchair access", "Needs accessibility review"),
}


@query("str_chips", with_views(f"with r as ({REPORTS}), s as (select id, {TYPE_SQL} as kind from r) select id, case kind " + " ".join(f"when '{k}' then '{';'.join(v)}'" for k, v in CHIPS.items() if k) + f" else '{';'.join(CHIPS[''])}' end as chips from s"))
def str_chips(spark, sf_dir):
    """The three descriptions offered for the type that a report's words suggest."""
    kind = suggested_type(F.col("t"), F.col("hazard_type"))
    table = F.create_map(*[x for k, v in CHIPS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    chips = F.coalesce(F.element_at(table, kind), F.element_at(table, F.lit("")))
    return reports(spark, sf_dir).select("id", F.array_join(chips, ";").alias("chips"))


# ---------------------------------------------------------------- explanations and instructions

#: Sentences of an explanation.
WEIGHT_HIGH = "High safety weight means hazard exposure and accessibility penalties were prioritized over raw distance."
WEIGHT_LOW = "Low safety weight means distance and travel time were prioritized unless a segment violated hard accessibility filters."
WEIGHT_EVEN = "Balanced safety weight trades off travel time, hazard exposure, and accessibility penalties."


def distinct_words(words: Column) -> Column:
    """Trimmed words without blanks; of those that differ in case only the first; in the order of their lower case."""
    kept = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: F.coalesce(w != "", F.lit(False)))
    first = F.filter(kept, lambda w, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda e: F.lower(e) == F.lower(w)))
    return F.transform(F.array_sort(F.transform(first, lambda w: F.struct(F.lower(w).alias("k"), w.alias("w")))), lambda s: s["w"])


def explain_route(distance: Column, seconds: Column, weight: Column, profile: Column, preferences: Column, warnings: Column, score: Column, most_warnings: int = 5) -> Column:
    """Sentences that say why a route was chosen, from its own fields."""
    wanted = distinct_words(preferences)
    shown = F.slice(warnings, 1, max(1, most_warnings))
    reasons = F.array(
        F.format_string("The deterministic router selected a %.0f metre route estimated at %.0f seconds.", distance, seconds),
        F.when(weight >= 0.7, WEIGHT_HIGH).when(weight <= 0.3, WEIGHT_LOW).otherwise(WEIGHT_EVEN),
        F.when(F.lower(profile) != "standard", F.format_string("The %s profile applies reproducible accessibility constraints before scoring candidate edges.", profile)),
        F.when(F.size(wanted) > 0, F.format_string("Requested preferences considered by the router: %s.", F.array_join(wanted, ", "))),
        F.when(F.size(warnings) > 0, F.format_string("Remaining route warnings: %s.", F.array_join(shown, "; "))),
        F.format_string("The resulting safety score is %.2f on the service scale.", score),
    )
    return F.array_join(F.array_compact(reasons), " ")


@query("str_explain", with_views(f"""with x as (select r.id, a.distance_m, a.duration_s, r.safety_weight as w, r.profile as p, 1 - a.risk / 30 as score,
 case r.id % 4 when 0 then 'avoid_steps, Well_Lit' when 1 then 'quiet' else '' end as wanted,
 array_to_string(list_filter([if(a.risk > 20, 'High hazard exposure', null), if(a.obstacle >= 2, 'Obstacles on the way', null), if(a.distance_m > 1000, 'Long route', null)], lambda x: x is not null), '; ') as warned
 from request r join route_alternative a on a.request_id = r.id and a.alt = 0)
select id, printf('The deterministic router selected a %.0f metre route estimated at %.0f seconds.', distance_m, duration_s) || ' ' || case when w >= 0.7e0 then '{WEIGHT_HIGH}' when w <= 0.3e0 then '{WEIGHT_LOW}' else '{WEIGHT_EVEN}' end
 || if(p <> 'standard', ' The ' || p || ' profile applies reproducible accessibility constraints before scoring candidate edges.', '') || if(wanted <> '', ' Requested preferences considered by the router: ' || wanted || '.', '')
 || if(warned <> '', ' Remaining route warnings: ' || warned || '.', '') || printf(' The resulting safety score is %.2f on the service scale.', round(score + 1e-9, 2)) as explanation from x"""))
def str_explain(spark, sf_dir):
    """Every request's first alternative explained."""
    register(spark, sf_dir, "request", "route_alternative")
    first = spark.table("route_alternative").where("alt = 0").withColumnRenamed("request_id", "id")
    both = spark.table("request").join(first, "id")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    wanted = F.when(F.col("id") % 4 == 0, words("Well_Lit", " avoid_steps", "well_lit")).when(F.col("id") % 4 == 1, words("quiet", " ")).otherwise(words(" "))
    warnings = F.array_compact(F.array(F.when(F.col("risk") > 20, "High hazard exposure"), F.when(F.col("obstacle") >= 2, "Obstacles on the way"), F.when(F.col("distance_m") > 1000, "Long route")))
    score = F.round(1 - F.col("risk") / 30 + 1e-9, 2)
    return both.select("id", explain_route(F.col("distance_m"), F.col("duration_s"), F.col("safety_weight"), F.col("profile"), wanted, warnings, score).alias("explanation"))


def instruction(direction: Column, metres: Column, surface: Column, stairs: Column, steep: Column, index: Column, total: Column) -> Column:
    """What to say at a step: the first, the last, and those between with what is special about the way."""
    far = F.when(metres < 100, F.format_string("%.0fm", metres)).otherwise(F.format_string("%.2fkm", metres / 1000))
    notes = F.array_compact(F.array(F.when(~surface.isin("asphalt", "paving_stones"), F.concat(F.lit("surface: "), surface)), F.when(stairs, "stairs"), F.when(steep, "steep")))
    noted = F.when(F.size(notes) > 0, F.concat(F.lit(" ("), F.array_join(notes, ", "), F.lit(")"))).otherwise("")
    return (
        F.when(index == 0, F.format_string("Head %s for %s.", direction, far))
        .when(index == total - 1, F.format_string("Continue %s for %s to reach your destination.", direction, far))
        .otherwise(F.format_string("Continue %s for %s%s.", direction, far, noted))
    )


#: Walks of 39 steps along a street of the grid and of 25 across, by edge.
_STEP = "case when id % 4 = 0 then src % 40 when id % 4 = 1 then 39 - src % 40 else cast(floor(src / 40e0) as bigint) % 25 end"
_STEPS_OF = "case when id % 4 < 2 then 39 else 25 end"


@query("str_instruction", with_views(f"""with e as (select e.*, round(degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))), 6) as angle
 from edge e join node a on a.id = e.src join node b on b.id = e.dst),
t as (select id, {_STEP} as i, {_STEPS_OF} as n, ['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'][(floor((angle + 382.5e0) / 45)::int % 8) + 1] as way,
 if(dist < 100, printf('%.0fm', dist), printf('%.2fkm', dist / 1000)) as far,
 array_to_string(list_filter([if(surface not in ('asphalt', 'paving_stones'), 'surface: ' || surface, null), if(has_stairs, 'stairs', null), if(is_steep, 'steep', null)], lambda x: x is not null), ', ') as notes from e)
select id, case when i = 0 then 'Head ' || way || ' for ' || far || '.' when i = n - 1 then 'Continue ' || way || ' for ' || far || ' to reach your destination.'
 else 'Continue ' || way || ' for ' || far || if(notes = '', '', ' (' || notes || ')') || '.' end as text from t"""))
def str_instruction(spark, sf_dir):
    """The instruction for every edge as a step of a walk along its street."""
    nodes, ways = graph(spark, sf_dir)
    a = nodes.select(F.col("id").alias("src"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    b = nodes.select(F.col("id").alias("dst"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    e = ways.join(a, "src").join(b, "dst").withColumn("i", F.expr(_STEP)).withColumn("n", F.expr(_STEPS_OF))
    way = geo.cardinal(geo.bearing(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")))
    return e.select("id", instruction(way, F.col("dist"), F.col("surface"), F.col("has_stairs"), F.col("is_steep"), F.col("i"), F.col("n")).alias("text"))


def nav_prompts(positions: DataFrame, steps: DataFrame, metres: float = 48.0) -> DataFrame:
    """What is said on the way: a trip's first position says step 0, each later one the first step beyond the last said within ``metres``.

    ``positions``: trip, seq, lat, lon (``seq`` orders a trip's positions and is unique in it); ``steps``: trip, step (from 0), lat, lon
    (where it ends), instruction. Blank instructions are passed over, but for step 0; a trip without step 0 says nothing.
    Steps near a position meet it by cell and trip; then each trip's positions go by in order, and only the number of the step said
    last is held, so a trip may be of any length. Result: trip, seq, step, instruction.
    """
    said = steps.where("trim(instruction) <> ''").select(F.col("trip").alias("r_trip"), F.col("step"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = within_distance(positions, said, metres).where("trip = r_trip").groupBy("trip", "seq").agg(F.array_sort(F.collect_set("step")).alias("near"))
    begun = steps.where("step = 0").select("trip").distinct()
    rows = positions.join(begun.hint("merge"), "trip", "left_semi").select("trip", "seq").join(near, ["trip", "seq"], "left")
    kinds = ", ".join(f"{c} {positions.schema[c].dataType.simpleString()}" for c in ("trip", "seq"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trip, last = None, -1
        for batch in batches:
            out = []
            for row_trip, seq, steps_near in zip(batch["trip"], batch["seq"], batch["near"], strict=True):
                if row_trip != trip:
                    trip, last = row_trip, 0
                    out.append((trip, seq, 0))
                    continue
                following = next((int(s) for s in steps_near if s > last), None) if steps_near is not None else None
                if following is not None:
                    last = following
                    out.append((trip, seq, last))
            yield pd.DataFrame(out, columns=["trip", "seq", "step"])

    spoken = rows.repartition("trip").sortWithinPartitions("trip", "seq").mapInPandas(walk, f"{kinds}, step long")
    # as large as the map: planned by the size of its compressed file it would be broadcast
    texts = steps.select("trip", "step", F.trim("instruction").alias("instruction")).hint("merge")
    return spoken.join(texts, ["trip", "step"]).select("trip", "seq", "step", "instruction")


#: A walk along every street: its positions lie beside the nodes, its steps end at every third of them.
_WALK = "select cast(floor(id / 40e0) as bigint) as trip, id as seq, lat + (id % 7) * 0.00006e0 as lat, lon + (id % 5) * 0.0001e0 as lon from node"
_WALK_STEPS = "select cast(floor(id / 40e0) as bigint) as trip, cast(floor((id % 40) / 3e0) as bigint) as step, lat, lon, case when id % 11 = 5 then ' ' else 'Step at ' || id end as instruction from node where id % 40 % 3 = 0"


@query("geo_nav_prompt", with_views(f"""with recursive p as (select *, row_number() over (partition by trip order by seq) - 1 as i from ({_WALK}) where trip in (select trip from ({_WALK_STEPS}) where step = 0)), s as ({_WALK_STEPS}),
c as (select p.trip, p.i, s.step from p join s on s.trip = p.trip and trim(s.instruction) <> '' where {sql.haversine('p.lat', 'p.lon', 's.lat', 's.lon')} <= 48),
f(trip, i, last, said) as (select trip, 0::bigint, 0::bigint, 0::bigint from p where i = 0
 union all select f.trip, f.i + 1, coalesce(min(c.step), max(f.last)), min(c.step) from f join p on p.trip = f.trip and p.i = f.i + 1 left join c on c.trip = f.trip and c.i = f.i + 1 and c.step > f.last group by f.trip, f.i)
select f.trip, p.seq, f.said as step, trim(s.instruction) as instruction from f join p using (trip, i) join s on s.trip = f.trip and s.step = f.said"""))
def geo_nav_prompt(spark, sf_dir):
    """What is said on a walk along every street."""
    register(spark, sf_dir, "node")
    return nav_prompts(spark.sql(_WALK), spark.sql(_WALK_STEPS))


# ---------------------------------------------------------------- ways around hazards


def avoidance_waypoints(route: DataFrame, points: DataFrame, radius: float = 50.0, offset: float = 100.0, longest: float = 200.0) -> DataFrame:
    """For each point within ``radius`` of a route, a waypoint ``offset`` metres beside the route's nearest vertex, on the side away from the point.

    ``route``: route, i (0, 1, ..., gapless), lat, lon, no leg longer than ``longest``; ``points``: hazard_id, lat, lon. Of vertices as near
    as each other the first counts; where the vertices before and after it coincide there is no waypoint.
    """
    order = W.partitionBy("route").orderBy("i")
    v = route.select("route", "i", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    for name, step in (("p", F.lag), ("n", F.lead)):
        v = v.withColumn(f"{name}_lat", F.coalesce(step("r_lat").over(order), "r_lat")).withColumn(f"{name}_lon", F.coalesce(step("r_lon").over(order), "r_lon"))
    reach = (radius**2 + (longest / 2) ** 2) ** 0.5 + 1
    near = within_distance(points, v, reach)
    leg = geo.point_segment(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"), F.col("n_lat"), F.col("n_lon"))
    nearest = F.min_by(F.struct("lat", "lon", "r_lat", "r_lon", "p_lat", "p_lon", "n_lat", "n_lon"), F.struct(F.round("distance_m", 6), "i")).alias("v")
    # a leg within the radius has an end within reach, but perhaps its second one only: each vertex looks both ways
    back = geo.point_segment(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"), F.col("p_lat"), F.col("p_lon"))
    best = near.groupBy("route", "hazard_id").agg(F.min(F.least(leg, back)).alias("gap"), nearest).where(F.col("gap") < radius).select("route", "hazard_id", "v.*")
    dlat, dlon = F.col("n_lat") - F.col("p_lat"), F.col("n_lon") - F.col("p_lon")
    length = F.sqrt(dlat * dlat + dlon * dlon)
    moved = best.where(length >= 1e-10).withColumn("olat", F.lit(offset / geo.DEGREE_M) * dlon / length)
    moved = moved.withColumn("olon", F.lit(-offset / geo.DEGREE_M) / F.cos(F.radians("lat")) * dlat / length)
    gaps = [geo.equirectangular(F.col("r_lat") + s * F.col("olat"), F.col("r_lon") + s * F.col("olon"), F.col("lat"), F.col("lon")) for s in (1, -1)]
    side = F.when(gaps[0] > gaps[1] + 1e-6, 1).otherwise(-1)  # a point on the line itself is no nearer to either side
    return moved.select("route", "hazard_id", (F.col("r_lat") + side * F.col("olat")).alias("lat"), (F.col("r_lon") + side * F.col("olon")).alias("lon"))


_SCALE = "(111320e0 * greatest(0.1e0, cos(radians(h.lat))))"


def _sql_leg(a: str, b: str) -> str:
    ax, ay, bx, by = f"(({a}_lon - lon) * sc)", f"(({a}_lat - lat) * 111320e0)", f"(({b}_lon - lon) * sc)", f"(({b}_lat - lat) * 111320e0)"
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    t = f"(case when {dx} * {dx} + {dy} * {dy} > 0 then least(1e0, greatest(0e0, -({ax} * {dx} + {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy}))) else 0e0 end)"
    return f"sqrt(power({ax} + {t} * {dx}, 2) + power({ay} + {t} * {dy}, 2))"


@query("graph_reroute", with_views(f"""with s as (select floor(id / 40e0)::bigint as route, id, lat as r_lat, lon as r_lon, lag(lat, 1, lat) over w as p_lat, lag(lon, 1, lon) over w as p_lon, lead(lat, 1, lat) over w as n_lat, lead(lon, 1, lon) over w as n_lon
 from node window w as (partition by floor(id / 40e0) order by id)),
c as (select s.*, h.id as hazard_id, h.lat, h.lon, {_SCALE} as sc, {sql.haversine('h.lat', 'h.lon', 's.r_lat', 's.r_lon')} as d from hazard h join s on abs(h.lat - s.r_lat) < 0.0015e0 and abs(h.lon - s.r_lon) < 0.003e0 where h.status in ('reported', 'under_review')),
g as (select *, least({_sql_leg('r', 'n')}, {_sql_leg('r', 'p')}) as gap from c where d <= 112.803398874989),
b as (select * from g qualify min(gap) over (partition by route, hazard_id) < 50 and row_number() over (partition by route, hazard_id order by round(d, 6), id) = 1),
o as (select *, n_lat - p_lat as dy, n_lon - p_lon as dx, sqrt(power(n_lat - p_lat, 2) + power(n_lon - p_lon, 2)) as len from b),
m as (select *, 100 / 111320e0 * dx / len as olat, -100 / (111320e0 * cos(radians(lat))) * dy / len as olon from o where len >= 1e-10),
z as (select *, if({sql.equirectangular('(r_lat + olat)', '(r_lon + olon)', 'lat', 'lon')} > {sql.equirectangular('(r_lat - olat)', '(r_lon - olon)', 'lat', 'lon')} + 1e-6, 1, -1) as side from m)
select route, hazard_id, round(r_lat + side * olat, 7) as lat, round(r_lon + side * olon, 7) as lon from z"""))
def graph_reroute(spark, sf_dir):
    """Waypoints around the active hazards within 50 m of every street of the grid."""
    register(spark, sf_dir, "node")
    route = spark.table("node").select(F.floor(F.col("id") / 40.0).alias("route"), F.col("id").alias("i"), "lat", "lon")
    active = hazards(spark, sf_dir).where(risk.is_active(F.col("status"))).select(F.col("id").alias("hazard_id"), "lat", "lon")
    return avoidance_waypoints(route, active).select("route", "hazard_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


# ---------------------------------------------------------------- projections, cities

#: Short names of cities.
CITY_ALIASES = {"sea": "seattle", "cdmx": "mexico_city", "mexico": "mexico_city", "nyc": "new_york"}


def city_of_split(path: Column, city: Column) -> Column:
    """City for a split: the file name up to its first underscore, else the city given; aliases resolved."""
    stem = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)/*$", 1)
    given = F.coalesce(F.nullif(F.split_part(stem, F.lit("_"), F.lit(1)), F.lit("")), F.nullif(city, F.lit("")), F.lit("unknown"))
    name = F.replace(F.lower(F.trim(given)), F.lit("-"), F.lit("_"))
    table = F.create_map(*[F.lit(x) for pair in CITY_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(table, name), name)


def city_of_slice(path: Column, *cities: Column) -> Column:
    """City for a slice of results: the first city given, else the letters before the file name's first underscore."""
    stem = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)/*$", 1))
    named = F.coalesce(*[F.nullif(c, F.lit("")) for c in cities], F.nullif(F.regexp_extract(stem, "^([a-z][a-z0-9-]+)_", 1), F.lit("")))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(named)), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


_IMAGES = """select doc_id as id, case doc_id % 6 when 0 then 'img/NYC_' || doc_id || '.jpg' when 1 then '/a/b/' || source || '-Nord_' || doc_id || '_2.png' when 2 then '_' || doc_id when 3 then 'cdmx.jpg' when 4 then null else source || '_x/' end as path,
 case doc_id % 4 when 0 then 'San José (' || lang || ')' when 1 then '' when 2 then ' Mexico' else null end as city from documents"""


@query("str_city", f"""with i as ({_IMAGES}), s as (select *, regexp_extract(coalesce(path, ''), '([^/]*)/*$', 1) as stem from i),
t as (select *, replace(lower(trim(coalesce(nullif(split_part(stem, '_', 1), ''), nullif(city, ''), 'unknown'))), '-', '_') as a, coalesce(nullif(city, ''), nullif(regexp_extract(lower(stem), '^([a-z][a-z0-9-]+)_', 1), '')) as b from s)
select id, case a {' '.join(f"when '{k}' then '{v}'" for k, v in CITY_ALIASES.items())} else a end as split_city, coalesce(nullif(trim(regexp_replace(lower(trim(b)), '[^a-z0-9-]+', '-', 'g'), '-'), ''), 'unknown') as slice_city from t""")
def str_city(spark, sf_dir):
    """Both readings of an image's city, from its path and the city given."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    return spark.sql(_IMAGES).select("id", city_of_split(F.col("path"), F.col("city")).alias("split_city"), city_of_slice(F.col("path"), F.col("city")).alias("slice_city"))


def guid_of(key: Column) -> Column:
    """A long as the first eight bytes, low byte first, of an identifier whose other bytes are zero."""
    hexed = F.lpad(F.lower(F.hex(key)), 16, "0")
    return F.concat_ws("-", F.substring(hexed, 9, 8), F.substring(hexed, 5, 4), F.substring(hexed, 1, 4), F.lit("0000-000000000000"))


@query("proj_poi", with_views("select printf('%08x-%04x-%04x-0000-000000000000', id & 4294967295, (id >> 32) & 65535, (id >> 48) & 65535) as poi_id, coalesce(name, asset_type) as name, asset_type as category, lat, lon from (select id, asset_type, lat, lon, case when id % 4 = 0 then null else name end as name from asset)"))
def proj_poi(spark, sf_dir):
    """Assets as points of interest: an identifier made of the key, the name or else the type."""
    register(spark, sf_dir, "asset")
    name = F.when(F.col("id") % 4 != 0, F.col("name"))
    return spark.table("asset").select(guid_of(F.col("id")).alias("poi_id"), F.coalesce(name, "asset_type").alias("name"), F.col("asset_type").alias("category"), "lat", "lon")


def cursor_of(at: Column) -> Column:
    """A time as an opaque cursor: ISO text with seven decimals and Z, base64 with - and _ and without padding."""
    text = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), F.lit("="))


@query("proj_page", with_views("""with r as (select status, id, reported_at, row_number() over (partition by status order by reported_at desc, id) as rn from hazard qualify rn <= 51)
select status, array_to_string(list(id order by rn) filter (rn <= 50), ',') as ids, 50 as page_limit, count(*) > 50 as has_more,
 case when count(*) > 50 then rtrim(translate(base64(encode(strftime(max(reported_at) filter (rn = 50), '%Y-%m-%dT%H:%M:%S.%f') || '0Z')), '+/', '-_'), '=') end as next_cursor from r group by status"""))
def proj_page(spark, sf_dir):
    """The first page of reports for each status: ids, whether another page follows, and its cursor."""
    rank = F.row_number().over(W.partitionBy("status").orderBy(F.desc("reported_at"), "id"))
    top = hazards(spark, sf_dir).select("status", "id", "reported_at").withColumn("rn", rank).where("rn <= 51")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 50, F.struct("rn", "id")))), lambda s: s["id"].cast("string")), ",")
    more = F.count("*") > 50
    return top.groupBy("status").agg(listed.alias("ids"), F.lit(50).alias("page_limit"), more.alias("has_more"), F.when(more, cursor_of(F.max(F.when(F.col("rn") == 50, F.col("reported_at"))))).alias("next_cursor"))
