"""Geography as column expressions: degrees in, metres or degrees out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres. [F17]"""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def metres_to_degrees(metres: Column | float, lat: Column) -> Column:
    """Degrees of longitude that ``metres`` to the east span at a latitude. [F18]"""
    metres = metres if isinstance(metres, Column) else F.lit(float(metres))
    arc = metres / F.lit(EARTH_M)
    return F.degrees(F.atan2(F.sin(arc) * F.cos(F.radians(lat)), F.cos(arc) - F.pow(F.sin(F.radians(lat)), 2) * F.cos(arc)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, 0 to 360 degrees from north. [F20]"""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def bearing_difference(one: Column, other: Column) -> Column:
    """Smaller angle between two bearings, 0 to 180. [F20]"""
    return F.abs(F.pmod(one - other + 540, F.lit(360.0)) - 180)


def tile_x(lon: Column, zoom: Column | int) -> Column:
    """Slippy-map column; ``tile_y`` the row. [F24]"""
    return F.floor((lon + 180) / 360 * _side(zoom)).cast("long")


def tile_y(lat: Column, zoom: Column | int) -> Column:
    rad = F.radians(lat)
    return F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * _side(zoom)).cast("long")


def tile_bounds(x: Column, y: Column, zoom: Column | int) -> dict[str, Column]:
    """West, south, east and north of a tile. [F25, D52]"""

    def north(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * row / _side(zoom)))))

    return {"west": x / _side(zoom) * 360 - 180, "south": north(y + 1), "east": (x + 1) / _side(zoom) * 360 - 180, "north": north(y)}


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north. [F25]"""
    radius = 6_378_137.0
    return F.radians(lon) * radius, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * radius


def _side(zoom: Column | int) -> Column:
    return F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))


def local_plane(lon: Column, lat: Column, lon0: Column | float, lat0: Column | float) -> tuple[Column, Column]:
    """Metres east and north of an origin in its tangent plane, for short distances. [F19]"""
    lon0, lat0 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lon0, lat0))
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_M, F.radians(lat - lat0) * EARTH_M


def from_local_plane(east: Column, north: Column, lon0: Column | float, lat0: Column | float) -> tuple[Column, Column]:
    """The inverse of ``local_plane``. [F19]"""
    lon0, lat0 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lon0, lat0))
    return lon0 + F.degrees(east / EARTH_M / F.cos(F.radians(lat0))), lat0 + F.degrees(north / EARTH_M)


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Point in a box that doesn't cross the date line; pushed down to the scan. [P4]"""
    return lon.between(west, east) & lat.between(south, north)


def within_degrees(lon: Column, lat: Column, lon0: float, lat0: float, degrees: float) -> Column:
    """Planar distance in degrees, which is narrower east to west than north to south. [P5]"""
    near = in_box(lon, lat, lon0 - degrees, lat0 - degrees, lon0 + degrees, lat0 + degrees)
    return near & (F.pow(lon - lon0, 2) + F.pow(lat - lat0, 2) <= degrees * degrees)


def within_metres(lon: Column, lat: Column, lon0: float, lat0: float, metres: float) -> Column:
    """Great-circle distance at most ``metres``, after a box that the scan can use. [P6]"""
    tall = math.degrees(metres / EARTH_M) * 1.001
    wide = min(180.0, tall / max(1e-6, math.cos(math.radians(min(89.9, abs(lat0) + tall)))))
    return in_box(lon, lat, lon0 - wide, lat0 - tall, lon0 + wide, lat0 + tall) & (haversine(lon, lat, F.lit(lon0), F.lit(lat0)) <= metres)


def not_null_island(lon: Column, lat: Column) -> Column:
    """False for points that lie at 0, 0 for want of a place. [P9]"""
    return ~((F.abs(lon) < 0.1) & (F.abs(lat) < 0.1))


def line_length(points: Column) -> Column:
    """Metres along an array of (lon, lat) structs. [F21]"""
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def rounded(value: Column, places: int) -> Column:
    """Coordinates as they go over the wire. [F36]"""
    return F.round(value, places)
