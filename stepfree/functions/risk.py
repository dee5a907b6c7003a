"""Severity, normalisation and outside signals as Columns. Results lie in 0..1."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVE = ("reported", "under_review")
DECAY_M = 150.0
DEFAULT_SEVERITY = 0.5

#: Severity by hazard token.
SEVERITY = {
    "broken_sidewalk": 0.7, "broken_pavement": 0.7, "blocked_pavement": 0.75, "blocked_sidewalk": 0.75, "obstacle_present": 0.7,
    "missing_ramp": 0.9, "missing_curb_ramp": 0.9, "missing_kerb_ramp": 0.9, "no_curb_ramp": 0.9, "obstruction": 0.6,
    "road_obstruction": 0.65, "barrier": 0.65, "bollard": 0.55, "gate": 0.6, "poor_lighting": 0.5, "broken_street_light": 0.55,
    "low_lighting": 0.5, "steep_slope": 0.6, "steep_gradient": 0.65, "flooding": 0.8, "construction": 0.7,
    "construction_obstruction": 0.75, "no_sidewalk": 0.85, "missing_sidewalk": 0.85, "narrow_path": 0.6, "narrow_sidewalk": 0.65,
    "uneven_surface": 0.55, "surface_damage": 0.65, "surface_problem_present": 0.65, "surface_quality": 0.65, "cobblestone": 0.6,
    "sett": 0.6, "gravel": 0.65, "unpaved": 0.7, "sand": 0.75, "dirt": 0.65, "earth": 0.65, "grass": 0.6, "temporary_closure": 0.9,
    "pothole": 0.5, "signal_missing": 0.7, "unsafe_crossing": 0.8, "missing_crossing": 0.8, "stairs": 0.9, "steps": 0.9, "stairs_no_ramp": 0.92,
}


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def token(text: Column) -> Column:
    """Trimmed lower case with -, blank and / as _."""
    return F.translate(F.lower(F.trim(text)), "- /", "___")


def severity(hazard_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(SEVERITY.items())])
    return F.coalesce(F.element_at(table, token(F.coalesce(hazard_type, F.lit("")))), F.lit(DEFAULT_SEVERITY))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(x: Column, k: float, midpoint: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-F.lit(k) * (x - midpoint)))


def normalised(weighted_sum: Column, count: Column) -> Column:
    """Nothing near gives 0; otherwise a steep curve around a summed weight of 1."""
    return F.when((count <= 0) | (weighted_sum <= 0), F.lit(0.0)).otherwise(clamp01(sigmoid(weighted_sum, 3.0)))


def crime(count: Column) -> Column:
    return F.when(count > 0, sigmoid(count / 12.0, 2.0)).otherwise(F.lit(0.0))


#: First hour of each step of the day and its risk.
DAY_CURVE = ((0, 0.80), (2, 0.75), (4, 0.50), (6, 0.15), (8, 0.05), (10, 0.02), (16, 0.10), (18, 0.30), (20, 0.55), (22, 0.80))


def time_of_day(hour: Column) -> Column:
    out = F.lit(DAY_CURVE[0][1])
    for start, value in DAY_CURVE[1:]:
        out = F.when(hour >= start, F.lit(value)).otherwise(out)
    return out


def coarse_time_of_day(hour: Column) -> Column:
    return F.when((hour >= 22) | (hour < 5), 0.8).when((hour >= 6) & (hour < 9), 0.4).otherwise(0.2)


#: Weather condition codes from, below, and their risk.
WEATHER_CODES = ((200, 300, 0.85), (300, 400, 0.25), (500, 505, 0.40), (505, 600, 0.65), (600, 612, 0.60), (612, 700, 0.75), (700, 770, 0.50), (771, 772, 0.70), (781, 782, 0.95))


def weather(codes: Column, wind: Column, temperature: Column) -> Column:
    """The worst of condition codes, wind and frost."""

    def of_code(code: Column) -> Column:
        out = F.lit(0.0)
        for low, high, value in WEATHER_CODES:
            out = F.when((code >= low) & (code < high), F.lit(value)).otherwise(out)
        return out

    by_code = F.coalesce(F.array_max(F.transform(codes, of_code)), F.lit(0.0))
    by_wind = F.when(wind > 15, 0.55).when(wind > 10, 0.30).otherwise(0.0)
    by_frost = F.when(temperature < -5, 0.65).when(temperature < 0, 0.45).otherwise(0.0)
    return clamp01(F.greatest(by_code, by_wind, by_frost))
