"""Helpers that keep joins and loops of this package safe at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.session import reliable

# A side of a join is broadcast up to this size of its rows, measured by its count.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its counted rows stay below ``limit``; else unchanged, for a shuffled join.

    ``row_bytes`` is an upper estimate of a row, or a column that computes it. ``df`` should be checkpointed: it is
    counted here.
    """
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= limit else df


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(a, b)``; component is the least node reached.

    Alternates the large-star and small-star steps; each joins edges with one least
    neighbour per node, so no task holds the edges of a node. The number of rounds
    grows with the logarithm of the longest chain; one that is not stable after ``rounds`` fails. Every round ends
    in a checkpoint.
    """
    kept = reliable(edges.where(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # every larger neighbour of a node points to the least of the neighbourhood
        large = (both.where(F.col("b") > F.col("a")).join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # every smaller neighbour, and the node itself, points to the least smaller neighbour
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where(F.col("a") != F.col("b"))
                 .unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        kept = reliable(small)
        now = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return (kept.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(kept.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
