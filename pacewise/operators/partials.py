"""Mergeable statistics: partials per part, merged without looking at rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.functions.money import from_minor_units, minor_units

PARTIAL_SCHEMA = "n long, units long, low double, high double"

NAN, INFINITY = float("nan"), float("inf")


def _partial_columns(value: str, decimals: int) -> list[Column]:
    column = F.col(value)
    return [
        F.count(column).alias("n"),
        F.coalesce(F.sum(minor_units(column, decimals)), F.lit(0)).alias("units"),
        F.min(column).alias("low"),
        F.max(column).alias("high"),
    ]


def partials(df: DataFrame, value: str, part: Column | str | None = None, decimals: int = 2) -> DataFrame:
    """``(part, n, units, low, high)`` per part, or one row where there is no part."""
    columns = _partial_columns(value, decimals)
    if part is None:
        return df.agg(*columns)
    return df.groupBy(part).agg(*columns)


def merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Partials of the union. Empty parts have no bounds and change none."""
    columns = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    ]
    return parts.groupBy(*keys).agg(*columns) if keys else parts.agg(*columns)


def finish(parts: DataFrame, *keys: str, decimals: int = 2) -> DataFrame:
    """``count, sum, mean, min, max``; nothing at all gives NaN, +inf and -inf.

    The mean is the sum of sums over the sum of counts, not a mean of means.
    """
    added = from_minor_units(F.col("units"), decimals)
    return parts.select(
        *keys,
        F.col("n").alias("count"),
        added.alias("sum"),
        F.when(F.col("n") > 0, added / F.col("n")).otherwise(F.lit(NAN)).alias("mean"),
        F.coalesce(F.col("low"), F.lit(INFINITY)).alias("min"),
        F.coalesce(F.col("high"), F.lit(-INFINITY)).alias("max"))
