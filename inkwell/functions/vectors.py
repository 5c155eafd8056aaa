"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, first element first; null unless the lengths are equal."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine_of_units(a: Column, b: Column) -> Column:
    return dot(a, b)


def great_circle(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """Kilometres between two places on a sphere of the Earth's mean radius."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(half(lat, other_lat) + F.cos(F.radians(lat)) * F.cos(F.radians(other_lat)) * half(lon, other_lon)))
