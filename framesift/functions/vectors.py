"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length, null if one is null."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).when(size.isNotNull(), 0.0)


def scaled(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def distance(a: Column, b: Column) -> Column:
    """Cosine distance, its cosine cut to -1..1."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))
