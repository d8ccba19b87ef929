"""Standardizing and scoring as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def standardized(column: Column, mean: float, std: float) -> Column:
    return (column.cast("double") - F.lit(float(mean))) / F.lit(float(std))


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def linear(columns: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    """Sum of the weighted columns in their order, plus the bias."""
    logit = None
    for column, weight in zip(columns, weights, strict=True):
        term = column * F.lit(float(weight))
        logit = term if logit is None else logit + term
    return logit + F.lit(float(bias))
