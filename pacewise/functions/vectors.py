"""Vectors held as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def normalize(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(
        vector.cast("array<double>"))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask entry is 1; all zero where no token is real."""
    real = F.filter(F.zip_with(tokens, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())
    start = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    added = F.aggregate(real, start, lambda total, v: F.zip_with(
        total, v, lambda a, b: a + b.cast("double")))
    count = F.greatest(F.size(real), F.lit(1))
    return F.transform(added, lambda x: x / count)


def append(vector: Column, value: Column) -> Column:
    return F.concat(vector.cast("array<double>"), F.array(value.cast("double")))
