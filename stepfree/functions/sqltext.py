"""Formulas as SQL text for oracles, written apart from the Columns they check."""

from __future__ import annotations

from stepfree.functions.cost import LOOSE, ROUGH, SMOOTHNESS_COST, SPEEDS, SURFACE_COST, WALKING, WHEELED
from stepfree.functions.risk import DAY_CURVE, SEVERITY


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371000e0 * atan2(sqrt({a}), sqrt(greatest(0e0, 1 - {a}))))"


def equirectangular(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(6371000e0 * sqrt(power(radians({lon2} - {lon1}) * cos(radians(({lat1} + {lat2}) / 2)), 2) + power(radians({lat2} - {lat1}), 2)))"


def severity(column: str) -> str:
    cases = " ".join(f"when '{k}' then {v}e0" for k, v in SEVERITY.items())
    return f"(case translate(lower(trim({column})), '- /', '___') {cases} else 0.5e0 end)"


def normalised(total: str, count: str) -> str:
    return f"(case when {count} <= 0 or {total} <= 0 then 0e0 else 1 / (1 + exp(-3e0 * ({total} - 1))) end)"


def day_curve(hour: str) -> str:
    cases = " ".join(f"when {hour} >= {start} then {value}e0" for start, value in reversed(DAY_CURVE))
    return f"(case {cases} end)"


def quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def speed(profile: str) -> str:
    cases = " ".join(f"when '{k}' then {v}e0" for k, v in SPEEDS.items())
    return f"(case {profile} {cases} else {WALKING}e0 end)"


def blocked(access: str, wheels: bool = True) -> str:
    names = ["access=no", "access=private", "foot=no", *(["wheelchair=no"] if wheels else [])]
    return "(" + " or ".join(f"coalesce(lower({access}), '') like '%{n}%'" for n in names) + ")"


def penalty(profile: str, e: str) -> str:
    """Penalty seconds of edge alias ``e`` for a profile known when the text is made."""
    strict = profile in WHEELED
    base = f"({e}.dist / {SPEEDS.get(profile, WALKING)}e0)"
    p = lambda a, b: f"{a if strict else b}e0"
    return f"""least(2400e0, greatest(0e0,
  case when {e}.has_stairs then {p(600, 90)} else 0 end + case when {e}.has_barrier then {p(600, 60)} else 0 end
  + case when {e}.kerb_height > 0.03e0 then {p(300, 30)} else 0 end + case when {blocked(f'{e}.access')} then {p(600, 90)} else 0 end
  + {base} * case when {e}.surface = 'unknown' then {p(0.6, 0.15)} when {e}.surface in ('cobblestone', 'sett') then {p(2.0, 0.4)} when {e}.surface in ({quoted(LOOSE)}) then {p(4.0, 0.8)} else 0 end
  + case when {e}.smoothness in ({quoted(ROUGH)}) then {p(300, 45)} when {e}.smoothness is null then {base} * {p(0.25, 0)} else 0 end
  + case when {e}.width_m < 0.9e0 then {p(300, 30)} when {e}.width_m is null then {base} * {p(0.35, 0)} else 0 end
  + case when {e}.is_steep then {base} * {p(1.5, 0.5)} else 0 end))"""


def base_safety(e: str) -> str:
    surface = " ".join(f"when '{k}' then {v}e0" for k, v in SURFACE_COST.items())
    smooth = " ".join(f"when '{k}' then {v}e0" for k, v in SMOOTHNESS_COST.items())
    return f"""least(0.95e0, greatest(0.01e0, case {e}.surface {surface} else 0.2e0 end + case when {e}.smoothness is null then 0.03e0 else 0 end
  + case {e}.smoothness {smooth} else 0 end + case when {e}.lighting = 0.1e0 then 0.12e0 else 0 end + case when {e}.has_stairs then 0.25e0 else 0 end
  + case when {e}.is_steep then 0.15e0 else 0 end + case when {e}.has_barrier then 0.2e0 else 0 end
  + case when {e}.kerb_height > 0.03e0 then least({e}.kerb_height * 4, 0.25e0) else 0 end
  + case when {e}.width_m < 0.9e0 then 0.25e0 when {e}.width_m is null then 0.06e0 else 0 end))"""
