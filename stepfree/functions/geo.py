"""Distances, bearings, cells and tiles as Columns. Degrees in, metres out, on a sphere."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.lit(EARTH_M) * F.sqrt(x * x + y * y)


def lat_degrees(metres: Column | float) -> Column:
    return (metres if isinstance(metres, Column) else F.lit(metres)) / DEGREE_M


def lon_degrees(metres: Column | float, lat: Column) -> Column:
    """Longitude span of a distance; the cosine is kept from vanishing near the poles."""
    return (metres if isinstance(metres, Column) else F.lit(metres)) / (DEGREE_M * F.greatest(F.lit(0.1), F.abs(F.cos(F.radians(lat)))))


def point_segment(plat: Column, plon: Column, alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Planar distance from a point to a segment."""
    scale = F.lit(DEGREE_M) * F.greatest(F.lit(0.1), F.cos(F.radians(plat)))
    ax, ay = (alon - plon) * scale, (alat - plat) * DEGREE_M
    bx, by = (blon - plon) * scale, (blat - plat) * DEGREE_M
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / length))).otherwise(F.lit(0.0))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """0 to 360 degrees, clockwise from north."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def cardinal(degrees: Column) -> Column:
    names = F.array(*[F.lit(n) for n in ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")])
    return F.element_at(names, (F.pmod(F.floor((degrees + 22.5) / 45.0), F.lit(8)) + 1).cast("int"))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * (1 << zoom))


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / pi) / 2 * (1 << zoom))


def tile_lat(y: Column, zoom: int) -> Column:
    """Latitude of a tile's northern edge."""
    return F.degrees(F.atan(F.sinh(F.lit(pi) * (1 - 2 * y / (1 << zoom)))))


def tile_lon(x: Column, zoom: int) -> Column:
    return x / (1 << zoom) * 360.0 - 180.0
