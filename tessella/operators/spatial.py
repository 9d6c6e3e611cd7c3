"""Planar and geodesic operators as column expressions; polygons are arrays of struct(x, y), closed or open."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
EARTH_M = 6378137.0


def bbox(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def within_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ay != by:
            crosses = (F.lit(ay) > y) != (F.lit(by) > y)
            inside = inside != (crosses & (x < (bx - ax) * (y - ay) / (by - ay) + ax))
    return inside


def distance(x: Column, y: Column, px: float, py: float) -> Column:
    return F.sqrt(F.pow(x - px, 2) + F.pow(y - py, 2))


def haversine_km(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon * (EARTH_M * math.pi / 180), EARTH_M * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_M), F.degrees(2 * F.atan(F.exp(y / EARTH_M)) - math.pi / 2)


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = 2**zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)
    return x.cast("long"), y.cast("long")
