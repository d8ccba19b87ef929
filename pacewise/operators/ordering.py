"""Order over a distributed table: ordinals, running totals, picks and sorts.

A running total over a whole table is not one window over one partition. The
order column is cut into ranges, totals per range give each range its start, and
only rows of one range are ever windowed together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


# Rows of one range go through one task; more rows make more ranges, not larger ones.
ROWS_PER_RANGE = 1_000_000
# Values the driver gets to choose bounds from, whatever the size of the table, and how many of them stand for a range.
BOUND_SAMPLE = 200_000
SAMPLE_PER_RANGE = 8


def range_bounds(df: DataFrame, column: str, pieces: int | None = None) -> list[float]:
    """Values that cut ``column`` into about equal parts.

    They come from a sample of about ``BOUND_SAMPLE`` values, 1.6 MB at the driver, so nothing is merged in
    one task. They steer the balance of the work: any bounds give the same results. Tables too
    large for one range per ``ROWS_PER_RANGE`` rows under this sample get larger ranges.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = values.count()
    if pieces is None:
        parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces = max(2, parallel, min(-(-rows // ROWS_PER_RANGE), BOUND_SAMPLE // SAMPLE_PER_RANGE))
    if rows == 0:
        return []
    drawn = values if rows <= BOUND_SAMPLE else values.sample(BOUND_SAMPLE / rows, seed=11)
    found = np.sort(drawn.toArrow().column(0).to_numpy())
    if not len(found):
        return []
    return sorted(set(found[[(i * len(found)) // pieces for i in range(1, pieces)]].tolist()))


def with_range(df: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    """Add the number of the range a value falls in.

    Equal values share a range. Nulls come first and NaN last, as in a sort.
    """
    if not bounds:
        return df.withColumn(BUCKET, F.when(F.col(column).isNull(), -1).otherwise(0))
    splits = [float("-inf"), *bounds, float("inf")]
    staged = df.withColumn("__order", F.col(column).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="__order", outputCol=BUCKET, handleInvalid="keep")
    return cut.transform(staged).withColumn(
        BUCKET, F.coalesce(F.col(BUCKET).cast("int"), F.lit(-1))).drop("__order")


def running_totals(df: DataFrame, column: str, totals: Mapping[str, Column],
                   include_own: bool = True, bounds: Sequence[float] | None = None) -> DataFrame:
    """Add running sums in rising order of ``column``, whose values must be unique.

    Aggregate a column with repeated values by value first; then a value that a
    third of the rows share is one row here.
    """
    ranged = with_range(df, column, range_bounds(df, column) if bounds is None else bounds)
    starts = ranged.groupBy(BUCKET).agg(*[F.sum(v).alias(f"__sum_{k}") for k, v in totals.items()])
    # One row per range: at most len(bounds) + 2 rows, windowed and broadcast.
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(BUCKET, *[
        F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__start_{k}") for k in totals])
    inside = (Window.partitionBy(BUCKET).orderBy(column)
              .rowsBetween(Window.unboundedPreceding, 0 if include_own else -1))
    summed = ranged.withColumns({f"__in_{k}": F.sum(v).over(inside) for k, v in totals.items()})
    joined = summed.join(F.broadcast(starts), BUCKET)
    return joined.select(*df.columns, *[
        (F.col(f"__start_{k}") + F.coalesce(F.col(f"__in_{k}"), F.lit(0))).alias(k) for k in totals])


def with_ordinal(df: DataFrame, column: str = "seq", name: str = "ordinal") -> DataFrame:
    """Add the position of each row, from 0, in rising order of a unique column."""
    one = F.lit(1).cast("long")
    return running_totals(df, column, {name: one}, include_own=False)


def every_nth(df: DataFrame, n: int = 1_000_000, picks: int = 3, column: str = "seq") -> DataFrame:
    """The rows at ordinals 0, n, 2n, ..., the first ``picks`` of them.

    Only the ranges that hold one of these ordinals are put in order.
    """
    ranged = with_range(df, column, range_bounds(df, column))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__size"))  # one row per range
    starts = sizes.select(BUCKET, "__size", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    first = F.ceil(F.col("__start") / F.lit(n)) * n
    holding = starts.where((first < F.col("__start") + F.col("__size")) & (first < n * picks)).select(BUCKET, "__start")
    inside = Window.partitionBy(BUCKET).orderBy(column)
    placed = (ranged.join(F.broadcast(holding), BUCKET)
              .withColumn("ordinal", F.col("__start") + F.row_number().over(inside) - 1))
    return (placed.where((F.col("ordinal") % n == 0) & (F.col("ordinal") < n * picks)).orderBy("ordinal")
            .select(*df.columns, "ordinal"))


def by_score(df: DataFrame, score: str, seq: str = "seq") -> DataFrame:
    """Rising scores; equal scores in arrival order."""
    return df.orderBy(score, seq)


def by_text(df: DataFrame, text: str) -> DataFrame:
    """Texts by code point, which is how Spark compares strings by default."""
    return df.orderBy(text)
