"""Vector expressions on array columns; elements are widened to double before arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def squared_norm(v: Column) -> Column:
    return F.aggregate(wide(v), F.lit(0.0), lambda s, x: s + x * x)


def l2_normalise(v: Column) -> Column:
    """Unit vectors; zero vectors stay zero."""
    n = F.sqrt(squared_norm(v))
    return F.transform(wide(v), lambda x: x / F.when(n > 0, n).otherwise(1.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n)
