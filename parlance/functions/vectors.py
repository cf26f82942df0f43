"""Vector functions over array columns, accumulated in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalized(v: Column) -> Column:
    size = norm(v)
    return F.when(size == 0, doubles(v)).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def total(vectors: Column) -> Column:
    """The sum of an array of vectors."""
    first = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    return F.aggregate(vectors, first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def unit_score(x: Column) -> Column:
    """Clamped to 0..1 and rounded half to even to two digits."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 2)


def share(labels: Column, names: list[str]) -> Column:
    """The summed probability of some labels in a map of probabilities."""
    wanted = F.array(*[F.lit(n) for n in names])
    return F.aggregate(F.map_values(F.map_filter(labels, lambda k, v: F.array_contains(wanted, k))), F.lit(0.0), lambda s, x: s + x)
