"""Nearest-rank quantiles: the value at sorted index ``min(n - 1, floor(q * n))``."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacewise.operators.ordering import BOUND_SAMPLE

LATENCY_QUANTILES = {"p50": 0.5, "p99": 0.99, "p999": 0.999}


# Rows that are counted by value and put in order; wider ranges are narrowed first.
HELD_ROWS = 200_000
# A range reaches this many standard deviations of a sampled rank to both sides of the wanted one.
DEVIATIONS = 6.0


def nearest_rank(df: DataFrame, column: str, quantiles: Mapping[str, float] = LATENCY_QUANTILES) -> DataFrame:
    """One row with the exact quantiles and ``max``; all null where there is no value.

    A range of values is kept around each wanted index. A sample of the rows in the ranges proposes two values close
    to it, one scan counts the rows below, at and between them, and the index then lies at one of the two or in a
    narrower range. Samples steer the work and never the result. This goes on until ``HELD_ROWS`` rows are left
    in all ranges, at any size of the table; only these are counted by value and put in order. The driver holds
    bounds and one sample.
    """
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    number = F.col("value").cast("double")
    kind = values.schema["value"].dataType
    rows, top = values.agg(F.count(F.lit(1)), F.max("value")).first()
    indexes = [min(rows - 1, math.floor(float(q) * rows)) for q in quantiles.values()]
    held = [Range(None, None, 0, rows) for _ in indexes]
    seed = 0
    while sum(r.rows for r in set(held) if not r.point) > HELD_ROWS:
        wide = [i for i, r in enumerate(held) if not r.point]
        seed += 1
        share = min(1.0, BOUND_SAMPLE / max(held[i].rows for i in wide))
        inside = values.where(reduce(or_, [held[i].holds(number) for i in wide])).select(number.alias("v")).sample(share, seed=seed)
        found = np.sort(inside.toArrow().column(0).to_numpy())
        asked = {i: pair for i in wide if (pair := _proposed(found, held[i], indexes[i]))}
        if asked:
            counts = iter(values.agg(*[F.count_if(test) for low, high in asked.values() for test in (
                number < low, number <= low, number < high, number <= high)]).first())
            for i, (low, high) in asked.items():
                held[i] = held[i].narrowed(indexes[i], low, high, *(next(counts) for _ in range(4)))

    which = F.explode(F.array_compact(F.array(*[F.when(r.holds(number), F.lit(i)) for i, r in enumerate(held)])))
    counted = values.select(which.alias("which"), "value").groupBy("which", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("which").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.array(*[F.lit(i - r.before) for i, r in zip(indexes, held)])[F.col("which")]
    passed = counted.withColumn("seen", F.sum("n").over(upto)).where(F.col("seen") > offset)
    return passed.agg(*[F.min(F.when(F.col("which") == i, F.col("value"))).alias(n) for i, n in enumerate(quantiles)],
                      F.max(F.lit(top).cast(kind)).alias("max"))


@dataclass(frozen=True)
class Range:
    """Values between two others, which are not part of it (none: open), or one value; rows before it and in it."""

    low: float | None
    high: float | None
    before: int
    rows: int
    point: bool = False

    def holds(self, number: Column) -> Column:
        if self.point:
            return number == F.lit(self.low)
        above = F.lit(True) if self.low is None else number > F.lit(self.low)
        return above if self.high is None else above & (number < F.lit(self.high))

    def narrowed(self, index: int, low: float, high: float, under: int, upto: int, under_high: int, upto_high: int) -> Range:
        """The part that holds an index, by the rows of the table below and up to two values inside."""
        if index < under:
            return Range(self.low, low, self.before, under - self.before)
        if index < upto:
            return Range(low, low, under, upto - under, True)
        if index < under_high:
            return Range(low, high, upto, under_high - upto)
        if index < upto_high:
            return Range(high, high, under_high, upto_high - under_high, True)
        return Range(high, self.high, upto_high, self.before + self.rows - upto_high)


def _proposed(sample: np.ndarray, held: Range, index: int) -> tuple[float, float] | None:
    """Two values of a sorted sample close around an index; NaN counts as larger than any number."""
    first = 0 if held.low is None else int(np.searchsorted(sample, held.low, "right"))
    last = len(sample) if held.high is None else int(np.searchsorted(sample, held.high, "left"))
    if first >= last:
        return None
    share = (index - held.before) / held.rows
    middle = first + share * (last - first)
    reach = DEVIATIONS * math.sqrt((last - first) * share * (1 - share)) + DEVIATIONS
    return (float(sample[max(first, math.floor(middle - reach))]), float(sample[min(last - 1, math.ceil(middle + reach))]))


def approximate(df: DataFrame, column: str, quantiles: Mapping[str, float] = LATENCY_QUANTILES,
                accuracy: int = 10_000) -> DataFrame:
    """The same report from one sketch, where an error of 1/accuracy in rank is fine."""
    return df.agg(*[F.percentile_approx(column, q, accuracy).alias(n) for n, q in quantiles.items()],
                  F.max(column).alias("max"))
