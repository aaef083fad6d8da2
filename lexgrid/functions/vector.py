"""Vector columns: products, norms and cosine similarity in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def filled(width: int, value: float, *first: float) -> Column:
    """A constant vector that begins with other numbers: for checks of a store."""
    return F.concat(F.array(*map(F.lit, map(float, first))).cast("array<float>"), F.array_repeat(F.lit(value).cast("float"), width - len(first)))
