"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_normalise(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def mix(a: Column, b: Column, weight: float = 0.7) -> Column:
    return F.zip_with(a, b, lambda x, y: x * weight + y * (1 - weight))
