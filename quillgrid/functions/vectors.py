"""Vector functions as Column expressions; sums are in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_with(a: Column, vector: list[float]) -> Column:
    """Inner product with a literal vector."""
    return dot(a, F.array(*[F.lit(float(x)) for x in vector]))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """a over its length; null for the zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)
