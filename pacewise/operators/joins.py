"""Joins of a large table with a dimension, safe for hot keys on the large side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dimension is broadcast up to this measured size.
BROADCAST_BYTES = 64 << 20

# Rows of one key that a single task of a shuffled join may hold.
HOT_ROWS = 1_000_000
SALT_SEED = 17


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows, measured by one aggregation: widths, text lengths, nested values as JSON."""
    fixed, variable = 0, [F.lit(0).cast("long")]
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            variable.append(F.coalesce(F.octet_length(column), F.lit(0)).cast("long"))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            variable.append(F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)).cast("long"))
        fixed += 16
    per_row = reduce(lambda a, b: a + b, variable) + fixed
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def join_dimension(facts: DataFrame, dimension: DataFrame, on: str, how: str = "left",
                   limit: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS, unique: str | None = None) -> DataFrame:
    """Equi-join with a dimension that has one row per key.

    A dimension measured to be small is broadcast and the facts stay in place. A
    larger one is joined by shuffle, with the hot keys of the facts spread out.
    """
    if how not in ("left", "inner"):
        raise ValueError("a dimension join is 'left' or 'inner'")
    if fits_broadcast(dimension, limit):
        return facts.join(F.broadcast(dimension), on, how)
    return salted_join(facts, dimension, on, how, hot_rows, unique)


def salted_join(facts: DataFrame, dimension: DataFrame, on: str, how: str = "left",
                hot_rows: int = HOT_ROWS, unique: str | None = None) -> DataFrame:
    """Shuffled join where the rows of a hot key go to several tasks.

    At most (all rows / hot_rows) keys are hot, which bounds what is broadcast; only
    their dimension rows are repeated. Name a ``unique`` column of the facts where their rows may come in another order
    when a task runs again, as after a shuffle: the salt then depends on that column alone.
    """
    hot = (facts.groupBy(on).agg(F.count(F.lit(1)).alias("__size"))
           .where((F.col("__size") >= hot_rows) & F.col(on).isNotNull())
           .select(on, (F.ceil(F.col("__size") / hot_rows) + 1).cast("int").alias("__salts")))
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    # Seeded: equal rows get different salts, and a task that runs again over rows in the same order repeats them.
    draw = F.rand(SALT_SEED) if unique is None else F.pmod(F.xxhash64(unique, F.lit(SALT_SEED)), F.lit(1 << 20)) / (1 << 20)
    spread = (facts.withColumn("__draw", draw).join(F.broadcast(hot), on, "left")
              .withColumn("__salt", F.floor(F.col("__draw") * salts).cast("int")).drop("__salts", "__draw"))
    copies = (dimension.join(F.broadcast(hot), on, "left")
              .withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts"))
    return spread.join(copies, [on, "__salt"], how).drop("__salt")
