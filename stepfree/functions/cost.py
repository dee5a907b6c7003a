"""Edge costs by mobility profile as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHEELED = ("manual-wheelchair", "power-wheelchair", "stroller")
#: Metres a second; other profiles walk at WALKING.
SPEEDS = {"manual-wheelchair": 0.9, "power-wheelchair": 1.1, "stroller": 1.1}
WALKING = 1.3
ROUGH = ("bad", "very_bad", "horrible", "very_horrible", "impassable")
LOOSE = ("gravel", "unpaved", "sand", "dirt", "earth", "grass")
#: Safety cost of a surface.
SURFACE_COST = {
    "asphalt": 0.08, "paved": 0.1, "paving_stones": 0.14, "concrete": 0.1, "unknown": 0.22, "cobblestone": 0.35, "sett": 0.35,
    "gravel": 0.4, "unpaved": 0.45, "sand": 0.5, "dirt": 0.5, "earth": 0.5, "grass": 0.5,
}
SMOOTHNESS_COST = {"excellent": -0.02, "good": -0.02, "intermediate": 0.02, "bad": 0.15, "very_bad": 0.25, "horrible": 0.35, "very_horrible": 0.35, "impassable": 0.35}


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def speed(profile: str) -> float:
    return SPEEDS.get(profile, WALKING)


def access_blocked(access: Column, wheels: bool = True) -> Column:
    """No access, private, closed to walkers or (for wheels) closed to wheelchairs."""
    pattern = "access=no|access=private|foot=no" + ("|wheelchair=no" if wheels else "")
    return F.lower(F.coalesce(access, F.lit(""))).rlike(pattern)


def penalty(profile: str, dist: Column, surface: Column, smoothness: Column, stairs: Column, barrier: Column, kerb: Column, width: Column, steep: Column, access: Column) -> Column:
    """Seconds that obstacles add for a profile, 0 to 2400."""
    strict = profile in WHEELED
    pick = lambda a, b: F.lit(float(a if strict else b))
    zero = F.lit(0.0)
    base = dist / speed(profile)
    ground = F.when(_blank(surface), F.lit("unknown")).otherwise(F.lower(F.trim(surface)))
    rough = F.lower(F.coalesce(smoothness, F.lit(""))).isin(*ROUGH)
    parts = [
        F.when(stairs, pick(600, 90)).otherwise(zero),
        F.when(barrier, pick(600, 60)).otherwise(zero),
        F.when(kerb > 0.03, pick(300, 30)).otherwise(zero),
        F.when(access_blocked(access), pick(600, 90)).otherwise(zero),
        base * F.when(ground == "unknown", pick(0.6, 0.15)).when(ground.isin("cobblestone", "sett"), pick(2.0, 0.4)).when(ground.isin(*LOOSE), pick(4.0, 0.8)).otherwise(zero),
        F.when(rough, pick(300, 45)).when(_blank(smoothness), base * pick(0.25, 0)).otherwise(zero),
        F.when(width < 0.9, pick(300, 30)).when(width.isNull(), base * pick(0.35, 0)).otherwise(zero),
        F.when(steep, base * pick(1.5, 0.5)).otherwise(zero),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.greatest(zero, F.least(F.lit(2400.0), total))


def traversal(profile: str, dist: Column, penalty_s: Column) -> Column:
    return dist / speed(profile) + F.greatest(F.lit(0.0), penalty_s)


def data_quality(surface: Column, smoothness: Column, width: Column) -> Column:
    gaps = (
        F.when(_blank(surface) | (F.lower(surface) == "unknown"), 0.25).otherwise(0.0)
        + F.when(_blank(smoothness), 0.20).otherwise(0.0)
        + F.when(width.isNull(), 0.25).otherwise(0.0)
    )
    return F.greatest(F.lit(0.10), F.least(F.lit(1.0), 1.0 - gaps))


def base_safety(surface: Column, smoothness: Column, stairs: Column, steep: Column, barrier: Column, kerb: Column, width: Column, unlit: Column) -> Column:
    """Unweighted safety cost of an edge, 0.01 to 0.95 (no wheelchair tag, pedestrian way)."""
    score = (
        _lookup(F.lower(surface), SURFACE_COST, 0.2)
        + F.when(_blank(smoothness), 0.03).otherwise(0.0)
        + _lookup(F.lower(F.coalesce(smoothness, F.lit(""))), SMOOTHNESS_COST, 0.0)
        + F.when(unlit, 0.12).otherwise(0.0)
        + F.when(stairs, 0.25).otherwise(0.0)
        + F.when(steep, 0.15).otherwise(0.0)
        + F.when(barrier, 0.2).otherwise(0.0)
        + F.when(kerb > 0.03, F.least(kerb * 4.0, F.lit(0.25))).otherwise(0.0)
        + F.when(width < 0.9, 0.25).when(width.isNull(), 0.06).otherwise(0.0)
    )
    return F.greatest(F.lit(0.01), F.least(F.lit(0.95), score))


#: Wheeled profile, its highest kerb in metres, and whether it takes cobblestones.
WHEEL_RULES = {"manual-wheelchair": (0.03, False), "power-wheelchair": (0.05, True), "stroller": (0.05, True)}


def wheel_friendly(kerb_limit: float, dist_cols: dict[str, Column], cobbles: bool) -> Column:
    """Hard filter for wheeled profiles over the edge columns in ``dist_cols``; ``cobbles``: cobblestone and sett are allowed."""
    c = dist_cols
    return (
        ~c["has_stairs"]
        & ~c["has_barrier"]
        & ~access_blocked(c["access"])
        & (c["kerb_height"] <= kerb_limit)
        & (c["width_m"].isNull() | (c["width_m"] >= 0.9))
        & ~F.lower(F.coalesce(c["smoothness"], F.lit(""))).isin(*ROUGH)
        & ~F.lower(F.coalesce(c["surface"], F.lit(""))).isin(*LOOSE, *(() if cobbles else ("cobblestone", "sett")))
    )
