"""Dense-vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(vector: Column) -> Column:
    """Scale to length one in double precision; a zero vector stays zero."""
    doubles = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(doubles, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def cosine_distance(left: Column, right: Column, digits: int = 9) -> Column:
    """Distance of two unit vectors, clipped to [0, 2] and rounded.

    Rounding keeps float noise from separating equal distances.
    """
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.round(F.least(F.greatest(F.lit(1.0) - dot, F.lit(0.0)), F.lit(2.0)), digits)
