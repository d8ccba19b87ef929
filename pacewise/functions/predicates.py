"""Comparison predicates against a number."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.schema import numeric

COMPARISONS = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "=": operator.eq,
    "<>": operator.ne,
}

Condition = tuple[str, str, float]


def compare(df: DataFrame, column: str, op: str, value: float) -> Column:
    """``column op value`` on a numeric column. A null never matches."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}, use one of {list(COMPARISONS)}")
    numeric(df, column)
    # The literal is compared without a cast on the column, so it reaches the scan.
    return COMPARISONS[op](F.col(column), F.lit(float(value)))


def all_of(df: DataFrame, conditions: Sequence[Condition]) -> Column:
    """Conditions joined by AND; no condition keeps every row."""
    parts = [compare(df, *c) for c in conditions]
    return reduce(operator.and_, parts) if parts else F.lit(True)


def flag(probability: Column, threshold: float = 0.5) -> Column:
    """True strictly above the threshold."""
    return probability > F.lit(float(threshold))
