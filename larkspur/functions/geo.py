"""Distances and grid cells on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The radius in metres, and the cell sides in degrees.
RADIUS = 6_371_000.0
CELL_LAT, CELL_LON = 0.0108, 0.0168


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in whole metres."""
    h = _haversine(lat1, lon1, lat2, lon2)
    return F.rint(2 * RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))).cast("long")


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    return 2 * RADIUS * F.asin(F.sqrt(_haversine(lat1, lon1, lat2, lon2)))


def cell(lat: Column, lon: Column, side_lat: float = CELL_LAT, side_lon: float = CELL_LON) -> Column:
    return F.struct(F.floor(lat / side_lat).alias("lat"), F.floor(lon / side_lon).alias("lon"))


def neighbour_cells(at: Column) -> Column:
    """The nine cells around and at a cell, to explode on one side of an equi-join."""
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    return F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.struct((at["lat"] + a).alias("lat"), (at["lon"] + b).alias("lon")))))


def bounding_box(lat: Column, lon: Column, margin: float) -> Column:
    """Aggregate: the box of all points grown by a margin in metres."""
    per_degree = F.lit(RADIUS * 3.141592653589793 / 180)
    dlat = F.lit(margin) / per_degree
    dlon = dlat / F.cos(F.radians((F.min(lat) + F.max(lat)) / 2))
    return F.struct((F.min(lat) - dlat).alias("south"), (F.min(lon) - dlon).alias("west"), (F.max(lat) + dlat).alias("north"), (F.max(lon) + dlon).alias("east"))
