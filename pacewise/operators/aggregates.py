"""Whole-table and per-key aggregates, each with its rule for empty input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.functions.money import exact_sum
from pacewise.functions.predicates import Condition, all_of, flag
from pacewise.schema import numeric

# Fixed value: the bytes charged for the state of one key.
STATE_BYTES_PER_KEY = 240


# --- single aggregates; nulls are skipped ------------------------------------

def total(column: Column) -> Column:
    """Sum; 0 where there is no value."""
    return F.coalesce(F.sum(column), F.lit(0))


def _strict(aggregate: Column, column: Column, what: str) -> Column:
    message = F.lit(f"{what} of no values")
    return F.when(F.count(column) == 0, F.raise_error(message)).otherwise(aggregate)


def strict_min(column: Column) -> Column:
    """Minimum; the job fails where there is no value."""
    return _strict(F.min(column), column, "minimum")


def strict_max(column: Column) -> Column:
    """Maximum; the job fails where there is no value."""
    return _strict(F.max(column), column, "maximum")


def strict_mean(column: Column) -> Column:
    """Mean of the values as a double; the job fails where there is none."""
    return _strict(F.avg(column.cast("double")), column, "mean")


# --- aggregates of one column over the rows that meet all conditions ----------

def filtered_aggregate(df: DataFrame, column: str, conditions: Sequence[Condition] = (),
                       decimals: int | None = None) -> DataFrame:
    """One row ``(sum, count, max)``; no matching row gives ``(0, 0, 0)``.

    With ``decimals`` the sum is taken over whole minor units and does not depend
    on the order of rows. Conditions and column choice reach the scan.
    """
    value = numeric(df, column)
    added = F.sum(value) if decimals is None else exact_sum(value, decimals)
    return df.where(all_of(df, conditions)).agg(
        F.coalesce(added, F.lit(0.0)).alias("sum"),
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.max(value), F.lit(0.0)).alias("max"))


def filtered_sum(df: DataFrame, column: str, conditions: Sequence[Condition] = (),
                 decimals: int | None = None) -> DataFrame:
    return filtered_aggregate(df, column, conditions, decimals).select("sum")


def filtered_count(df: DataFrame, column: str, conditions: Sequence[Condition] = ()) -> DataFrame:
    return filtered_aggregate(df, column, conditions).select("count")


def filtered_max(df: DataFrame, column: str, conditions: Sequence[Condition] = ()) -> DataFrame:
    return filtered_aggregate(df, column, conditions).select("max")


def filtered_mean(df: DataFrame, column: str, conditions: Sequence[Condition] = (),
                  decimals: int | None = None) -> DataFrame:
    """Mean over the matching rows; 0 where none matches."""
    parts = filtered_aggregate(df, column, conditions, decimals)
    mean = F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(F.lit(0.0))
    return parts.select(mean.alias("mean"))


# --- per-key group-by and its rollup -------------------------------------------

def per_key(df: DataFrame, key: str, value: str, decimals: int = 2) -> DataFrame:
    """``(key, count, sum, max)``. Map-side partials keep a hot key to one row per task."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("count"),
        exact_sum(F.col(value), decimals).alias("sum"),
        F.max(value).alias("max"))


def rollup_of_keys(keyed: DataFrame, decimals: int = 2) -> DataFrame:
    """One row over the groups of :func:`per_key`."""
    return keyed.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("count").alias("rows"),
        exact_sum(F.col("sum"), decimals).alias("sum_of_sums"),
        exact_sum(F.col("max"), decimals).alias("sum_of_maxima"))


# --- run summaries -----------------------------------------------------------

def distinct_keys(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """Number of different keys ever seen."""
    counter = F.approx_count_distinct(key) if approximate else F.count_distinct(F.col(key))
    return df.agg(counter.alias("keys"))


def state_footprint(df: DataFrame, key: str) -> DataFrame:
    """Keys and the bytes their window state takes, by the fixed estimate per key."""
    return distinct_keys(df, key).select(
        "keys", (F.col("keys") * STATE_BYTES_PER_KEY).alias("state_bytes"))


def run_summary(rows: DataFrame, label: str = "isFraud", key: str = "account") -> DataFrame:
    """Rows, positives, their percentage, distinct keys."""
    counted = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    return counted.agg(
        total(F.col("n")).alias("rows"), total(F.col("p")).alias("positives"),
        F.count(F.col(key)).alias("keys"),
    ).select("rows", "positives", _percent("positives", "rows").alias("percent"), "keys")


def scored_summary(scored: DataFrame, probability: str = "p", threshold: float = 0.5) -> DataFrame:
    """Scored rows, flagged rows, their percentage, sum of the scores."""
    return scored.agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(flag(F.col(probability), threshold)).alias("flagged"),
        F.coalesce(F.sum(probability), F.lit(0.0)).alias("score_sum"),
    ).select("scored", "flagged", _percent("flagged", "scored").alias("percent"), "score_sum")


def _percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """The different values of a text column, compared by code point."""
    return df.select(F.coalesce(F.col(column), F.lit("")).alias(column)).distinct()
