"""Distances and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_008.8
CELL = 0.002
NEAR_M = 150.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def cell(x: Column) -> Column:
    return F.floor(x / CELL)


def is_near(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Nearer than NEAR_M; a missing coordinate is never near."""
    return F.coalesce(haversine(lat1, lng1, lat2, lng2) < NEAR_M, F.lit(False))
