"""Exact ranked lexical search of all documents for a stated set of queries, by norm buckets of impact vectors.

A document is a vector with one impact per term of the queries (frequency and length in integers), a query a
vector of term weights; the score is their product. Vectors are ordered by length (Euclidean norm) and
taken in buckets of neighbours, longest first. Per query and bucket:

1. If query norm times the greatest norm of the bucket is below the score that the query's
   k-th best document has already, the Cauchy-Schwarz bound rules out the whole bucket.
2. Otherwise the heaviest coordinates of the query are looked at. To reach that score a document must have
   each normalised coordinate within bounds that follow from the angle it may have to the query, and the
   product over these coordinates plus the product of the two remaining norms must reach the score.
3. Survivors are scored exactly, in 64-bit integers. Bounds are doubles with a margin, so none is lost.

The ordered vectors are written to the shared folder, split by norm and id, so that equal norms spread
over tasks. Three levels of norms are searched one after the other, since each raises the k-th best scores
for the next; a level skips files below the least norm that any query can still use. A task hands on
at most k documents per query.

The terms of the queries are broadcast, in blocks of at most ``BLOCK_BYTES`` of query text; every block
scans the documents once.

Defined cases. A null text has no terms; a document without terms is not counted in N and never ranked. A query without
terms, or whose terms no document has, has no rows. Documents that repeat an id are ranked each by
itself; one with a null id comes after others of equal score. Rows that repeat a query are queries of their own. Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacewise.llm.suffixes import ragged
from pacewise.session import shared_dir

TOP = 10
BLOCK_BYTES = 16 << 20   # of query text whose terms are broadcast together
PIECE_BYTES = 1 << 20    # of a text whose terms are counted at a time
BUCKET_ROWS = 4096       # vectors of neighbouring norm that are tested together
FOCUS = 8                # heaviest coordinates of a query that are tested first
LEVELS = (1 / 256, 1 / 16)  # shares of the longest vectors that are searched before the rest
PART_BYTES = 64 << 20    # packed vectors of one part of the ordered table
SLICE_TERMS = 1 << 14    # document frequencies summed in one task
MARGIN = 1e-9            # relative, for rounding of the bounds

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_COUNTED = "doc_id long, n long, terms binary, counts binary"
_VECTOR = "doc_id long, norm double, terms binary, impacts binary"
_FOUND = "query long, item_id long, doc_id long, score long"


def terms_of(text: bytes) -> Counter:
    """Terms of a text with their numbers, a piece of it at a time."""
    counts: Counter = Counter()
    first = 0
    while first < len(text):
        after = _BREAK.search(text, first + PIECE_BYTES)
        end = after.start() if after else len(text)
        counts.update(_TERM.findall(text[first:end].lower()))
        first = end
    return counts


def _counting(shared):
    """Number of terms of each document, and those that the queries have. Columns: doc_id, text (binary)."""
    def run(batches):
        index = shared.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for value in batch.column(1):
                found = terms_of(value.as_py() or b"")
                sizes.append(found.total())
                known = sorted((index[t], c) for t, c in found.items() if t in index)
                terms.append(np.array([t for t, _ in known], np.int32).tobytes())
                counts.append(np.array([c for _, c in known], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()),
                                              pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])
    return run


def _frequencies(vocabulary: int):
    """Documents of a task that hold each term, in slices."""
    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total[np.frombuffer(blob.as_py(), np.int32)] += 1
        starts = range(0, vocabulary, SLICE_TERMS)
        yield pa.RecordBatch.from_arrays([pa.array([k // SLICE_TERMS for k in starts], pa.int32()),
                                          pa.array([total[k:k + SLICE_TERMS].tobytes() for k in starts], pa.binary())],
                                         names=["slice", "data"])
    return run


def _slice_totals(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in table.column("data")], axis=0)
    return pa.table({"term": key[0].as_py() * SLICE_TERMS + np.arange(len(total)), "df": total})


def _vectors(documents: int, length: int):
    """Impacts and norm of each document. Columns as of ``_COUNTED``."""
    def run(batches):
        for batch in batches:
            norms, blobs = [], []
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(3)):
                times = np.frombuffer(blob.as_py(), np.int64)
                m = 25 + 75 * n * documents // length
                impact = 1_000_000_000 * times // (1000 * times + 8 * m)
                norms.append(math.sqrt(float(np.square(impact.astype(np.float64)).sum())))
                blobs.append(impact.astype(np.int32).tobytes())  # at most 1,000,000
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norms, pa.float64()), batch.column(2),
                                              pa.array(blobs, pa.binary())], names=["doc_id", "norm", "terms", "impacts"])
    return run


class Queries:
    """Query vectors of a block; each needs an item id, its distinct terms and their integer weights."""

    def __init__(self, first: int, items: list, weights: np.ndarray):
        self.first = first
        self.items = [i for i, _ in items]
        self.terms = [np.array(sorted(counts), np.int64) for _, counts in items]
        self.values = [np.array([counts[t] for t in terms], np.int64) * weights[terms]
                       for (_, counts), terms in zip(items, self.terms)]
        self.norms = np.array([math.sqrt(float(np.square(v.astype(np.float64)).sum())) for v in self.values])
        self.least = np.zeros(len(items), np.int64)  # score of the k-th best document so far
        self.vocabulary = len(weights)


class Bucket:
    """Vectors of neighbouring norm, by row and by term."""

    def __init__(self, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.norms, self.sizes, self.terms, self.impacts = norms, sizes, terms, impacts.astype(np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)[:-1]]
        rows = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        self._by_term, self._rows, self._values = terms[order], rows[order], self.impacts[order]

    def coordinate(self, term: int) -> np.ndarray:
        a, b = np.searchsorted(self._by_term, [term, term + 1])
        out = np.zeros(len(self.norms))
        out[self._rows[a:b]] = self._values[a:b]
        return out

    def candidates(self, terms: np.ndarray, values: np.ndarray, norm: float, least: int) -> np.ndarray:
        """Rows that the coordinate bounds cannot exclude from scores of at least ``least``."""
        alive = np.ones(len(self.norms), bool)
        if least <= 0:
            return np.flatnonzero(alive)
        # the least cosine of any row of the bucket that reaches the score
        angle = min(1.0, least / (norm * float(self.norms.max())) * (1 - MARGIN))
        partial, squares, rest = np.zeros(len(alive)), np.zeros(len(alive)), norm * norm
        for at in np.argsort(-values, kind="stable")[:FOCUS]:
            x = self.coordinate(int(terms[at]))
            share = float(values[at]) / norm
            spread = math.sqrt(max(0.0, (1 - angle * angle) * (1 - share * share)))
            scaled = x / self.norms
            alive &= scaled >= angle * share - spread - MARGIN
            if share < angle:
                alive &= scaled <= angle * share + spread + MARGIN
            partial += x * float(values[at])
            squares += x * x
            rest -= float(values[at]) ** 2
        left = np.sqrt(np.maximum(self.norms * self.norms * (1 + MARGIN) - squares, 0))
        alive &= (partial + math.sqrt(max(rest, 0.0) + MARGIN * norm * norm) * left) * (1 + MARGIN) >= least
        return np.flatnonzero(alive)

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``dense`` holds the query's weight of every term."""
        sizes = self.sizes[rows]
        products = dense[ragged(self.terms, self.starts[rows], sizes)] * ragged(self.impacts, self.starts[rows], sizes)
        return np.add.reduceat(products, np.r_[0, np.cumsum(sizes)[:-1]]) if len(rows) else products


class Best:
    """The best documents of one query so far."""

    def __init__(self, top: int):
        none = np.zeros(0, np.int64)
        self.top, self.scores, self.docs, self.named = top, none, none, none.astype(bool)

    def add(self, scores, docs, named) -> int:
        """Takes more documents in; the score to reach from now on, 0 while there are fewer than wanted."""
        scores, docs, named = (np.concatenate(x) for x in ((self.scores, scores), (self.docs, docs), (self.named, named)))
        order = np.lexsort((docs, ~named, -scores))[:self.top]
        self.scores, self.docs, self.named = scores[order], docs[order], named[order]
        return int(self.scores[-1]) if len(order) == self.top else 0


def _searching(shared, top: int):
    """Best documents per query among the rows of a task, which come longest first."""
    def run(batches):
        queries: Queries = shared.value
        least, best = queries.least.copy(), {}
        dense = np.zeros(queries.vocabulary, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, BUCKET_ROWS):
                part = batch.slice(first, BUCKET_ROWS)
                norms = part.column("norm").to_numpy(zero_copy_only=False)
                terms = [np.frombuffer(x.as_py(), np.int32) for x in part.column("terms")]
                sizes = np.array([len(x) for x in terms], np.int64)
                bucket = Bucket(norms, sizes, np.concatenate(terms).astype(np.int64),
                                np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in part.column("impacts")]))
                docs = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                named = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                for q in np.flatnonzero(queries.norms * float(norms.max()) * (1 + MARGIN) >= least):
                    if not queries.norms[q]:
                        continue
                    rows = bucket.candidates(queries.terms[q], queries.values[q], queries.norms[q], least[q])
                    dense[queries.terms[q]] = queries.values[q]
                    scores = bucket.scores(rows, dense)
                    dense[queries.terms[q]] = 0
                    good = scores >= max(1, least[q])
                    if good.any():
                        rows = rows[good]
                        held = best.setdefault(int(q), Best(top))
                        least[q] = max(least[q], held.add(scores[good], docs[rows], named[rows]))
        out = [(queries.first + q, queries.items[q], int(d) if k else None, int(s))
               for q, held in best.items() for s, d, k in zip(held.scores, held.docs, held.named)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)],
                                         names=["query", "item_id", "doc_id", "score"])
    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(rows: DataFrame, items: list, first: int, top: int) -> DataFrame | None:
    """Best documents for the queries ``[(item id, Counter of terms)]``; None where no document has terms."""
    spark = rows.sparkSession
    context = spark.sparkContext
    index = {t: i for i, t in enumerate(sorted({t for _, counts in items for t in counts}))}
    if not index:
        return None
    path = shared_dir(spark, "lexical-counts")
    rows.mapInArrow(_counting(context.broadcast(index)), _COUNTED).write.parquet(path)
    counted = spark.read.parquet(path)
    documents, length, size = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)),
                                          F.coalesce(F.sum(F.octet_length("terms") * 2 + 24), F.lit(0))).first()
    if not documents:
        return None
    frequency = np.zeros(len(index), np.int64)  # as long as the terms of the block
    totals = (counted.select("terms").mapInArrow(_frequencies(len(index)), "slice int, data binary")
              .groupBy("slice").applyInArrow(_slice_totals, "term long, df long").toArrow())
    frequency[totals.column("term").to_numpy()] = totals.column("df").to_numpy()
    # a term that no document has weighs nothing: it adds to no score
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) if df else 0 for df in frequency.tolist()], np.int64)
    queries = Queries(first, [(i, {index[t]: c for t, c in counts.items()}) for i, counts in items], weights)

    parts = max(context.defaultParallelism, int(size) // PART_BYTES + 1)
    path = shared_dir(spark, "lexical-vectors")
    (counted.where(F.octet_length("terms") > 0).mapInArrow(_vectors(documents, length), _VECTOR)
     .repartitionByRange(parts, F.desc("norm"), F.asc("doc_id")).sortWithinPartitions(F.desc("norm"), "doc_id")
     .write.parquet(path))
    vectors = spark.read.parquet(path)
    edges = vectors.agg(F.percentile_approx("norm", [1 - x for x in LEVELS], 10000)).first()[0]
    if not edges:
        return None
    found, above = [], None
    for edge in (*edges, 0.0):
        level = vectors.where(F.col("norm") >= edge)
        if above is not None:
            level = level.where(F.col("norm") < above)
        # below this norm no query reaches the score it needs
        useful = [s / n for s, n in zip(queries.least.tolist(), queries.norms.tolist()) if n]
        level = level.where(F.col("norm") >= min(useful, default=0.0) * (1 - MARGIN))
        path = shared_dir(spark, "lexical-found")
        level.mapInArrow(_searching(context.broadcast(queries), top), _FOUND).write.parquet(path)
        found.append(spark.read.schema(_FOUND).parquet(path))
        reached = _ranked(reduce(DataFrame.unionByName, found), top).where(F.col("rank") == top).select("query", "score")
        for query, score in reached.toLocalIterator():
            queries.least[query - first] = score
        above = edge
    return reduce(DataFrame.unionByName, found)


def search(documents: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents ``(doc_id, text)`` of each query ``(item_id, text)``."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    found, first = [], 0
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = [(r.item_id, terms_of(bytes(r.text))) for r in mine.orderBy("item_id", "text").toLocalIterator()]
        some = _search_block(rows, held, first, top)
        first += len(held)
        if some is not None:
            found.append(some)
    if not found:
        return documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _ranked(reduce(DataFrame.unionByName, found), top).select("item_id", "rank", "doc_id", "score")
