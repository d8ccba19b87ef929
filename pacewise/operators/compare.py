"""Checks that two tables hold the same: fingerprint, row difference, tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The hash of a row is the first 60 bits of an md5.
HASH_HEX = 15


def row_hash(columns: Sequence[Column]) -> Column:
    """A 60-bit hash of the columns as text; null and empty text differ."""
    parts = [F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HASH_HEX), 16, 10).cast("long")


def coded(column: Column, decimals: int = 6) -> Column:
    """A real number as an integer, so that its text form is the same everywhere."""
    return F.round(column * float(10 ** decimals)).cast("long")


def fingerprint(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """One row ``(rows, hash_xor, hash_sum)``, the same for any order and partitioning.

    Put ``seq`` among the columns where the order of rows is part of the content.
    """
    hashed = df.select(row_hash(columns).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"))


def feature_fingerprint(featured: DataFrame) -> DataFrame:
    """Fingerprint of a feature table: order, key and the five features."""
    return fingerprint(featured, [
        F.col("seq"), F.col("account"), F.col("step"), F.col("velocity_count"),
        coded(F.col("window_sum"), 2), coded(F.col("window_mean")), coded(F.col("window_max"), 2),
        coded(F.col("amount_over_mean"))])


def exact_feature_fingerprint(featured: DataFrame) -> DataFrame:
    """The same over the features as they are: the text of a double tells any two apart, to the last bit."""
    return fingerprint(featured, [F.col(c) for c in (
        "seq", "account", "step", "velocity_count", "window_sum", "window_mean", "window_max", "amount_over_mean")])


def same_fingerprint(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(rows_a, rows_b, identical)`` from two fingerprints."""
    both = (a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))))

    def pick(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    return both.agg(
        pick("a", "rows").alias("rows_a"), pick("b", "rows").alias("rows_b"),
        ((pick("a", "rows") == pick("b", "rows"))
         & (pick("a", "hash_xor") == pick("b", "hash_xor"))
         & (pick("a", "hash_sum") == pick("b", "hash_sum"))).alias("identical"))


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with the ``side`` that has them.

    A row that one side has more often comes out as often as it is over there. Both inputs run once.
    """
    columns = [F.col(f"`{c}`") for c in a.columns]
    signed = (a.select(*columns, F.lit(1).alias("__one"))
              .unionAll(b.select(*columns, F.lit(-1).alias("__one"))))
    over = signed.groupBy(*columns).agg(F.sum("__one").alias("__over")).where("__over <> 0")
    return over.select(*columns, F.when(F.col("__over") > 0, "a").otherwise("b").alias("side"),
                       F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__over"))).alias("__copy")).drop("__copy")


def close(a: Column, b: Column, relative: float = 1e-9, floor: float = 0.0) -> Column:
    """``|a - b| <= relative * max(|a|, |b|, floor)``. A floor of 1 bounds small numbers absolutely."""
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(float(floor)))
    return F.abs(a - b) <= F.lit(float(relative)) * scale


def compare_within(a: DataFrame, b: DataFrame, key: str, values: Sequence[str],
                   relative: float = 1e-9, floor: float = 0.0) -> DataFrame:
    """One row ``(keys, only_a, only_b, off_<value>...)`` for two tables with one row per key."""
    left = a.select(key, F.lit(True).alias("in_a"), *[F.col(v).alias(f"a_{v}") for v in values])
    right = b.select(key, F.lit(True).alias("in_b"), *[F.col(v).alias(f"b_{v}") for v in values])
    joined = left.join(right, key, "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()

    def off(v: str) -> Column:
        near = close(F.col(f"a_{v}"), F.col(f"b_{v}"), relative, floor)
        neither = F.col(f"a_{v}").isNull() & F.col(f"b_{v}").isNull()
        return F.count_if(both & ~F.coalesce(near, neither))

    return joined.agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
        *[off(v).alias(f"off_{v}") for v in values])
