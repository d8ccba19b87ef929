"""Alignment of two tokenizers over a corpus, with a fast path for tokens that both have.

Both tokenizers encode a text. Byte offsets where a token of each ends cut the tokens into groups; the
last tokens of a group are linked. Of the vocabularies an array is made once that gives for each A
id the B id of the same bytes. A group of one A and one B token that this array holds is exact:
it is counted in a vector as long as the vocabulary, one per task. Only the links of other
groups are counted as pairs: summed in the task, packed, and shuffled by a hash of the pair.

The links of each text, as distinct ids and pairs with their number, stay in a table in the shared
folder, so nothing is encoded twice. A second pass over it meets the corpus-wide counts: the vector
and the best count of each B id (as long as the vocabularies) and the counts of the most frequent pairs
(at most ``FREQUENT``) are broadcast, pairs beyond these go through a join by pair. A frequent pair
thus never gathers its texts in one task.

A long text is encoded in blocks that end before a single space between two other characters. No
token of either kind crosses such a place (checked for the piece model when it is read; the byte-level
pattern starts a pre-token there), so blocks change nothing, and the digest of the groups is
fed block by block. A is encoded by pre-tokens, whose ids a task remembers: its merges are in the order of its
ids (checked when it is read), so they are ranks of byte strings.

Defined cases. A text that is null or empty, or whose tokens do not join to the text with a space before it
(the piece model writes a space for U+2581), has no tokens: all figures 0, digest ''. Strings that look like
special tokens are ordinary text. A row with a null id keeps its row, rows that repeat an id or a
text each have their own result and their links count each time. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.llm.bytebpe import Remembered, Splitter, one_by_one
from pacewise.llm.words import mix
from pacewise.session import shared_dir

MARK = "▁"
BLOCK_CHARACTERS = 1 << 16  # of a text, encoded at a time
FREQUENT = 1 << 20          # pairs whose counts are broadcast: 16 MB
PAIR_ENTRIES = 1 << 20      # distinct pairs that a task gathers before it hands them on
SLICE_IDS = 1 << 12         # of the vector of exact links, summed in one task
PAIR_BUCKETS = 64           # least number; more for larger corpora
BUCKET_ENTRIES = 4 << 20    # packed pairs that one task sums, on average

_BREAK = re.compile(r"(?<=\S) (?=\S)")
_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, exact binary, pairs binary"


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both vocabularies as bytes, and the array from A ids to B ids of the same bytes."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.b = model_b = SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
        added = {x["id"]: x["content"].encode() for x in model["added_tokens"]}
        self.bytes_a = [b""] * (max([*ranks.values(), *added]) + 1)
        for token, i in [*ranks.items(), *((content, i) for i, content in added.items())]:
            self.bytes_a[i] = token
        # Merges in the order of their ids are ranks.
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        ranks = {self.bytes_a[i]: i for i in [*(vocab[c] for c in alphabet), *made]}
        if sorted(made) != made or made[0] < max(vocab[c] for c in alphabet):
            raise ValueError("the merges of this vocabulary are not in the order of its ids")
        self.a = Remembered(Splitter(pattern), one_by_one(ranks))
        pieces = [model_b.id_to_piece(i) for i in range(model_b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model_b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        plain = [i for i in range(len(pieces))
                 if not (model_b.is_control(i) or model_b.is_unknown(i) or model_b.is_unused(i))]
        if any(MARK in pieces[i].lstrip(MARK) or "\n" in pieces[i] for i in plain):
            raise ValueError("a piece of this model crosses the borders of pre-tokens")
        if model_b.normalize("Aéﬁ b") != f"{MARK}Aéﬁ{MARK}b" or model_b.normalize(" ") != MARK * 2:
            raise ValueError("only piece models that leave the text as it is are supported")
        # a piece goes before the byte of the same value
        id_of = {self.bytes_b[i]: i for i in sorted(plain, key=lambda i: (not model_b.is_byte(i), -i))}
        id_of |= {self.bytes_b[i]: i for i in sorted(plain, reverse=True) if not model_b.is_byte(i)}
        self.same = np.array([id_of.get(token, -1) if token else -1 for token in self.bytes_a], np.int32)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        a, b = range(len(self.bytes_a)), range(len(self.bytes_b))
        self._written = [*(b"%d," % i for i in a), *(b"%d|" % i for i in a), *(b"%d," % i for i in b), *(b"%d;" % i for i in b)]

    def encode(self, block: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A and B ids of a block with a space before it; None where the tokens of one do not join to it."""
        a, b = np.frombuffer(self.a(f" {block}"), "<u4"), self.b.encode(block)
        want = b" " + block.encode()
        if int(self.size_a[a].sum()) != len(want) or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        return a.astype(np.int64), np.array(b, np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the last A and the last B token of every group."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        return np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)

    def written(self, a, b, last_a, last_b, of_a, of_b) -> bytes:
        """The groups in decimal ids, each with ``;`` after it."""
        codes = np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.repeat(np.r_[0, last_b[:-1] + 1], of_a)
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, of_b)
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        mark_a, mark_b = a.copy(), b + 2 * n_a
        mark_a[last_a] += n_a
        mark_b[last_b] += n_b
        codes[at_a], codes[at_b] = mark_a, mark_b
        return b"".join(map(self._written.__getitem__, codes.tolist()))


@cache
def aligner(path_a: str, path_b: str, pattern: str) -> Aligner:
    return Aligner(path_a, path_b, pattern)


def blocks(text: str, size: int):
    """Parts of a text of about ``size`` characters; the single space between two parts is left out."""
    first = 0
    while len(text) - first > size:
        found = _BREAK.search(text, first + size)
        if found is None:
            break
        yield text[first:found.start()]
        first = found.end()
    yield text[first:]


# Distinct sorted keys and their numbers, as differences: small numbers, which the file compresses.

def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return np.diff(keys, prepend=0).astype("<i8").tobytes() + counts.astype("<i4").tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.cumsum(np.frombuffer(blob, "<i8", n)), np.frombuffer(blob, "<i4", n, 8 * n).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


class _Text:
    """What is known of one text while its blocks pass."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = 0
        self.sha, self.begun, self.good = hashlib.sha256(), False, True
        none = np.zeros(0, np.int64)
        self.exact, self.pairs = (none, none), (none, none)

    def add(self, pair: Aligner, block: str) -> None:
        ids = pair.encode(block) if self.good else None
        if ids is None:
            self.good = False
            return
        a, b = ids
        last_a, last_b = pair.groups(a, b)
        of_a, of_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        text = pair.written(a, b, last_a, last_b, of_a, of_b)
        self.sha.update((b";" if self.begun else b"") + text[:-1])
        self.begun = True
        self.n_a, self.n_b, self.n_groups = self.n_a + len(a), self.n_b + len(b), self.n_groups + len(last_a)
        left, right = a[last_a], b[last_b]
        exact = (of_a == 1) & (of_b == 1) & (pair.same[left] == right)
        self.exact = self._with(self.exact, left[exact])
        self.pairs = self._with(self.pairs, left[~exact] << 32 | right[~exact])

    @staticmethod
    def _with(held, keys):
        new = np.unique(keys, return_counts=True)
        return new if not len(held[0]) else _summed(np.concatenate((held[0], new[0])), np.concatenate((held[1], new[1])))

    def row(self) -> tuple:
        if not (self.good and self.begun):
            return 0, 0, 0, "", b"", b""
        return self.n_a, self.n_b, self.n_groups, self.sha.hexdigest(), packed(*self.exact), packed(*self.pairs)


def _aligning(path_a: str, path_b: str, pattern: str, size: int):
    def run(batches):
        pair = aligner(path_a, path_b, pattern)
        for batch in batches:
            rows, first, length = [], 0, 0
            for at in range(batch.num_rows):
                value = batch.column(2)[at].as_py()
                text = _Text()
                for block in blocks(value, size) if value else ():
                    text.add(pair, block)
                rows.append(text.row())
                length += len(value or "")
                if length > 16 * size or at + 1 == batch.num_rows:
                    part = batch.slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                            (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())))],
                        names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "exact", "pairs"])
                    rows, first, length = [], at + 1, 0
    return run


# --- counts over the corpus -------------------------------------------------------------

def _counting(vocabulary: int, buckets: int):
    """Sums of a task: the vector of exact links in slices (kind 0), and packed pairs by bucket (kind 1)."""
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                           pa.array([r[2] for r in rows], pa.binary())], names=["kind", "bucket", "data"])

    def by_bucket(keys, counts):
        at = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((keys, at))
        cuts = np.searchsorted(at[order], np.arange(buckets + 1))
        return batch_of([(1, k, packed(keys[order[cuts[k]:cuts[k + 1]]], counts[order[cuts[k]:cuts[k + 1]]]))
                         for k in range(buckets) if cuts[k] < cuts[k + 1]])

    def run(batches):
        vector = np.zeros(vocabulary, np.int64)
        none = np.zeros(0, np.int64)
        sums, fresh, size = (none, none), [], 0
        for batch in batches:
            for exact, pairs in zip(batch.column(0), batch.column(1)):
                ids, counts = unpacked(exact.as_py())
                vector[ids] += counts
                fresh.append(unpacked(pairs.as_py()))
                size += len(fresh[-1][0])
                if size > PAIR_ENTRIES:
                    sums = _summed(*(np.concatenate([sums[i], *(x[i] for x in fresh)]) for i in (0, 1)))
                    fresh, size = [], 0
                    if len(sums[0]) > PAIR_ENTRIES:
                        yield by_bucket(*sums)
                        sums = none, none
        sums = _summed(*(np.concatenate([sums[i], *(x[i] for x in fresh)]) for i in (0, 1)))
        if len(sums[0]):
            yield by_bucket(*sums)
        if vector.any():
            yield batch_of([(0, k // SLICE_IDS, vector[k:k + SLICE_IDS].tobytes()) for k in range(0, vocabulary, SLICE_IDS)])
    return run


def _totals(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    blobs = [x.as_py() for x in table.column("data")]
    if key[0].as_py() == 0:
        total = np.sum([np.frombuffer(x, np.int64) for x in blobs], axis=0)
        keys = key[1].as_py() * SLICE_IDS + np.arange(len(total))
        keys, total = keys[total > 0], total[total > 0]
    else:
        parts = [unpacked(x) for x in blobs]
        keys, total = _summed(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
    return pa.table({"exact": pa.array([key[0].as_py() == 0] * len(keys), pa.bool_()), "key": keys, "count": total})


def link_counts(aligned: DataFrame, vocabulary: int) -> DataFrame:
    """``(exact, key, count)``: how often each id (exact links) or pair ``a << 32 | b`` is linked in all texts."""
    entries = aligned.agg(F.coalesce(F.sum(F.octet_length("pairs") / 12), F.lit(0))).first()[0]
    buckets = max(PAIR_BUCKETS, int(entries) // BUCKET_ENTRIES)
    sums = aligned.select("exact", "pairs").mapInArrow(_counting(vocabulary, buckets), "kind int, bucket int, data binary")
    return sums.groupBy("kind", "bucket").applyInArrow(_totals, "exact boolean, key long, count long")


# --- figures per text ----------------------------------------------------------------------

def _judging(shared):
    """Figures of each text from the vector and the frequent pairs; rarer pairs are left to the join."""
    def run(batches):
        vector, same, best, keys, totals = shared.value
        for batch in batches:
            n_best, sums = [], []
            for exact, pairs in zip(batch.column("exact"), batch.column("pairs")):
                ids, n = unpacked(exact.as_py())
                here, top = vector[ids], best[same[ids]]
                good, total = int(n[here == top].sum()), int((n * here).sum())
                codes, n = unpacked(pairs.as_py())
                if len(codes) and len(keys):
                    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                    known = keys[at] == codes
                    here, n, codes = totals[at[known]], n[known], codes[known]
                    good += int(n[here == best[codes & 0xFFFFFFFF]].sum())
                    total += int((n * here).sum())
                n_best.append(good)
                sums.append(total)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")),
                 pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"])
    return run


def _rare(shared):
    def run(batches):
        keys = shared.value[3]
        for batch in batches:
            for row, pairs in zip(batch.column("row"), batch.column("pairs")):
                codes, n = unpacked(pairs.as_py())
                if len(codes) and len(keys):
                    rare = keys[np.minimum(np.searchsorted(keys, codes), len(keys) - 1)] != codes
                    codes, n = codes[rare], n[rare]
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(codes), pa.int64()), pa.array(codes), pa.array(n)],
                                                     names=["row", "key", "n"])
    return run


def aligned_texts(documents: DataFrame, path_a: str, path_b: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
                  block: int = BLOCK_CHARACTERS) -> DataFrame:
    """Written rows ``(row, doc_id, n_a, n_b, n_groups, groups_sha256, exact, pairs)``, one per text, with its packed links."""
    spark = documents.sparkSession
    path = shared_dir(spark, "aligned")
    (documents.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("long").alias("doc_id"),
                      F.col(f"`{text_column}`").alias("text"))
     .mapInArrow(_aligning(path_a, path_b, pattern, block), _ALIGNED).write.option("compression", "zstd").parquet(path))
    return spark.read.parquet(path)


def alignment(documents: DataFrame, path_a: str, path_b: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
              frequent: int = FREQUENT, block: int = BLOCK_CHARACTERS) -> tuple[DataFrame, DataFrame]:
    """Figures per text, and the link counts of the corpus.

    The first table is ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, the second
    ``(a, b, count)`` with one row per linked pair of ids. ``pattern`` is how A cuts pre-tokens. Every executor reads both vocabularies.
    """
    spark = documents.sparkSession
    pair = aligner(path_a, path_b, pattern)
    aligned = aligned_texts(documents, path_a, path_b, pattern, id_column, text_column, block)
    path = shared_dir(spark, "link-counts")
    link_counts(aligned, len(pair.bytes_a)).write.parquet(path)
    counts = spark.read.parquet(path)
    pairs = counts.where("not exact").select("key", "count")

    vector, best = np.zeros(len(pair.bytes_a), np.int64), np.zeros(len(pair.bytes_b), np.int64)
    for key, count in counts.where("exact").select("key", "count").collect():  # as long as the vocabulary
        vector[key] = count
        best[pair.same[key]] = count
    for b, count in pairs.groupBy(F.col("key").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count")).collect():  # so is this
        best[b] = max(best[b], count)
    total = pairs.count()
    top = pairs if total <= frequent else pairs.orderBy(F.desc("count"), "key").limit(frequent)
    top = top.toArrow().sort_by("key")
    shared = spark.sparkContext.broadcast((vector, pair.same, best, top.column("key").to_numpy(), top.column("count").to_numpy()))

    known = aligned.mapInArrow(_judging(shared), "row long, doc_id long, n_a long, n_b long, n_groups long, "
                               "groups_sha256 string, n_best long, count_sum long")
    if total > frequent:
        bests = spark.createDataFrame([(i, int(x)) for i, x in enumerate(best) if x], "b int, top long")
        rare = (aligned.select("row", "pairs").mapInArrow(_rare(shared), "row long, key long, n long").join(pairs, "key")
                .withColumn("b", F.col("key").bitwiseAND(0xFFFFFFFF).cast("int")).join(F.broadcast(bests), "b")
                .groupBy("row").agg(F.sum(F.when(F.col("count") == F.col("top"), F.col("n")).otherwise(0)).alias("more_best"),
                                    F.sum(F.col("n") * F.col("count")).alias("more_sum")))
        known = (known.join(rare, "row", "left")
                 .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
                 .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))))
    figures = known.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
                           "groups_sha256")
    same = spark.createDataFrame([(i, int(b)) for i, b in enumerate(pair.same) if b >= 0], "key long, b long")
    links = (pairs.select(F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("b"), "count")
             .unionByName(counts.where("exact").join(F.broadcast(same), "key").select(F.col("key").alias("a"), "b", "count")))
    return figures, links
