"""Best match by dot product against a set of reference vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.operators.joins import measured_bytes
from pacewise.session import reliable

# References up to this measured size are sent to every task as one matrix.
MATRIX_BYTES = 32 << 20

# Scores that a task holds at a time.
SCORE_BYTES = 64 << 20

# Queries that meet a block of references in one group, where there are more.
QUERIES_PER_GROUP = 100_000

HIT = "struct<id:string,score:double,ord:bigint>"
_HIT_TYPE = pa.struct([("id", pa.string()), ("score", pa.float64()), ("ord", pa.int64())])


def upsert(records: DataFrame, id: str = "id", seq: str = "seq") -> DataFrame:
    """The last record per id, at the position of its first one (``ord``)."""
    others = [c for c in records.columns if c not in (id, seq)]
    last = F.max_by(F.struct(*others), F.col(seq))
    return (records.groupBy(id).agg(last.alias("__last"), F.min(seq).alias("ord"))
            .select(id, "__last.*", "ord"))


def best_matches(queries: DataFrame, references: DataFrame, key: str, vector: str = "embedding",
                 k: int = 1, matrix_bytes: int = MATRIX_BYTES) -> DataFrame:
    """``queries`` with ``hits``: the k references of largest dot product, best first.

    ``references`` is ``(id, vector, ord)``; of equal scores the smaller ``ord``
    comes first. With no references, or a null query, ``hits`` is empty. ``key``
    names a unique column of ``queries``.

    References measured to be few are multiplied as one matrix inside the tasks and
    the queries stay in place. Otherwise see :func:`_block_search`.
    """
    chosen = references.select(F.col("id").cast("string").alias("id"),
                               F.col("ord").cast("long").alias("ord"),
                               F.col("vector").cast("array<double>").alias("vector"))
    chosen = reliable(chosen)  # an embedder among its columns runs once
    size = measured_bytes(chosen)
    if size > matrix_bytes:
        return _block_search(queries, chosen, key, vector, k, math.ceil(size / matrix_bytes))
    rows = chosen.toArrow().sort_by("ord")
    if rows.num_rows == 0:
        return queries.withColumn("hits", F.array().cast(f"array<{HIT}>"))
    return queries.withColumn("hits", _matrix_udf(_ReferenceSet(rows), k)(F.col(vector)))


def top1(queries: DataFrame, references: DataFrame, key: str, vector: str = "embedding",
         matrix_bytes: int = MATRIX_BYTES) -> DataFrame:
    """``queries`` with ``best_id`` and ``best_score``; both null where nothing matches."""
    found = best_matches(queries, references, key, vector, 1, matrix_bytes)
    first = F.get("hits", F.lit(0))
    return found.select(*queries.columns, first["id"].alias("best_id"), first["score"].alias("best_score"))


def search_upserted(queries: DataFrame, records: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Top-1 against ``records (id, vector, seq)`` of which only the last per id counts."""
    return top1(queries, upsert(records), key, vector)


def compare_hits(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row ``(queries, agree, max_score_delta)`` for two searches of the same queries."""
    left = a.select(key, F.col("best_id").alias("id_a"), F.col("best_score").alias("score_a"))
    right = b.select(key, F.col("best_id").alias("id_b"), F.col("best_score").alias("score_b"))
    return left.join(right, key).agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("id_a").eqNullSafe(F.col("id_b"))).alias("agree"),
        F.coalesce(F.max(F.abs(F.col("score_a") - F.col("score_b"))), F.lit(0.0)).alias("max_score_delta"))


def _better(a: Column, b: Column) -> Column:
    return (F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
            .when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))


class _ReferenceSet:
    """References of one matrix, in the order of ``ord``."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids = np.asarray(rows.column("id").to_pylist(), dtype=object)
        self.orders = rows.column("ord").to_numpy()
        flat = rows.column("vector").combine_chunks().flatten().to_numpy()
        self.matrix = flat.reshape(rows.num_rows, -1)

    def best(self, vectors: pa.Array, k: int) -> pa.Array:
        """An array of hits per vector; none for a null."""
        kept = min(k, len(self.ids))
        present = vectors.is_valid().to_numpy(zero_copy_only=False)
        filled = vectors.drop_null()
        if len(filled) == 0:
            return pa.array([[]] * len(vectors), pa.list_(_HIT_TYPE))
        flat = filled.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(filled), -1)
        # Queries in chunks, so that a chunk's scores stay small whatever the number of references.
        step = max(1, SCORE_BYTES // (8 * len(self.ids)))
        found = [self._best_of(flat[i:i + step], kept) for i in range(0, len(flat), step)]
        picked = np.concatenate([f[0] for f in found])
        hits = pa.StructArray.from_arrays([
            pa.array(self.ids[picked], pa.string()), pa.array(np.concatenate([f[1] for f in found])),
            pa.array(self.orders[picked])], fields=list(_HIT_TYPE))
        offsets = np.concatenate([[0], np.cumsum(np.where(present, kept, 0))])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), hits)

    def _best_of(self, queries: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the best references, row after row."""
        scores = queries @ self.matrix.T
        if kept == 1:
            # argmax takes the first of equal scores.
            order = scores.argmax(axis=1)[:, None]
        else:
            order = np.argsort(-scores, axis=1, kind="stable")[:, :kept]
        return order.ravel(), np.take_along_axis(scores, order, 1).ravel()


def _matrix_udf(references: _ReferenceSet, k: int):
    @F.arrow_udf(f"array<{HIT}>")
    def scan(vectors: pa.Array) -> pa.Array:
        return references.best(vectors, k)

    return scan


def _block_search(queries: DataFrame, references: DataFrame, key: str, vector: str, k: int,
                  blocks: int) -> DataFrame:
    """Exact search where the references do not fit one task.

    References fall into blocks and queries into parts; each (block, part) is one
    group of bounded size that yields k hits per query. The k best of those are kept.
    """
    parts = max(1, math.ceil(queries.count() / QUERIES_PER_GROUP))
    asked = (queries.where(F.col(vector).isNotNull())
             .select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
             .withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    placed = (references
              .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left.column("key").combine_chunks()
        if right.num_rows == 0:
            hits = pa.array([[]] * len(keys), pa.list_(_HIT_TYPE))
        else:
            hits = _ReferenceSet(right.sort_by("ord")).best(left.column("vector").combine_chunks(), k)
        return pa.table({"key": keys, "hits": hits})

    key_type = queries.schema[key].dataType.simpleString()
    met = (asked.groupBy("block", "part").cogroup(placed.groupBy("block", "part"))
           .applyInArrow(meet, f"key {key_type}, hits array<{HIT}>"))
    merged = met.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("all"))
    best = merged.select(F.col("key").alias(key), F.slice(F.array_sort("all", _better), 1, k).alias("hits"))
    found = queries.join(best, key, "left")
    return found.withColumn("hits", F.coalesce("hits", F.array().cast(f"array<{HIT}>")))
