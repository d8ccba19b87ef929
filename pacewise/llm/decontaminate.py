"""Benchmark passages in documents by pigeonhole pieces and Myers' bit-parallel edit distance.

Texts are words: runs of letters and digits, lower case. An item of m words may differ from
a passage by ``share`` of its words, its error budget k. It is split into k + 1 pieces; a passage within the
budget holds at least one of them unchanged. Pieces are looked up by hash at every word of every
document. Around each hit Myers' algorithm gives the least word edit distance between the item and any
run of words there, for many hits at once (one 64-bit lane each, more words for longer items).

Documents do not move: items are sent to the tasks in blocks of ``BLOCK_BYTES``, one scan per block.

Defined cases. A null or empty text matches nothing. Items of fewer than ``LEAST_WORDS`` words, or null, match
nothing: they are no evidence. Rows that repeat an item repeat its matches; rows that repeat a document repeat its
rows. A null id is kept as it is. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.llm.scale import small_side
from pacewise.llm.words import PLAIN, chunks, mix, tidy, window_hashes, word_hashes, word_spans
from pacewise.session import reliable

SHARE = 0.2
LEAST_WORDS = 8
BLOCK_BYTES = 16 << 20
LANES = 1 << 14          # hits that are verified together

_FILTER_BITS = 22
_MATCH = "doc_id long, item_id long, distance int, begin_word int, end_word int"


def hashed_words(column: pa.Array):
    """``(first row, word hashes, index of the first word of each text)`` per chunk of texts."""
    for first, _, data, offsets in chunks(pc.utf8_lower(column.cast(pa.large_string()))):
        starts, ends, at = word_spans(data, offsets, PLAIN)
        yield first, word_hashes(data, starts, ends), at


def edit_distances(equal: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against any run of its text, and where that run ends.

    ``equal[c, b, j]`` has bit i set if word 64 b + i of pattern c equals word j of its text.
    """
    lanes, blocks, size = equal.shape
    one, full = np.uint64(1), ~np.uint64(0)
    plus = np.full((blocks, lanes), full)
    minus = np.zeros((blocks, lanes), np.uint64)
    last, top = (lengths - 1) // 64, ((lengths - 1) % 64).astype(np.uint64)
    score = lengths.astype(np.int64)
    best, end = score.copy(), np.zeros(lanes, np.int64)
    for j in range(size):
        carry_plus = carry_minus = np.zeros(lanes, np.uint64)  # a run may begin anywhere
        for b in range(blocks):
            eq, pv, mv = equal[:, b, j], plus[b], minus[b]
            xv = eq | mv
            eq = eq | carry_minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            ends = last == b
            score += np.where(ends, (ph >> top) & one, 0).astype(np.int64) - np.where(ends, (mh >> top) & one, 0).astype(np.int64)
            out_plus, out_minus = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = (ph << one) | carry_plus, (mh << one) | carry_minus
            plus[b], minus[b] = mh | ~(xv | ph), ph & xv
            carry_plus, carry_minus = out_plus, out_minus
        better = score < best
        best = np.where(better, score, best)
        end = np.where(better, j + 1, end)
    return best, end


class Items:
    """Pieces and words of the items of one block."""

    def __init__(self, ids: list[int], texts: pa.Array, share: float = SHARE):
        self.ids, words = [], []
        for first, hashes, at in hashed_words(texts):
            for row in range(len(at) - 1):
                if at[row + 1] - at[row] >= LEAST_WORDS:
                    self.ids.append(ids[first + row])
                    words.append(hashes[at[row]:at[row + 1]])
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.budgets = (self.sizes * share).astype(np.int64)
        self.blocks = int(-(-self.sizes.max(initial=1) // 64))
        # for each word of an item the places where it stands
        places: dict[tuple[int, int], list[int]] = {}
        for item, row in enumerate(words):
            for j, h in enumerate(row.tolist()):
                places.setdefault((item, h), [0] * self.blocks)[j // 64] |= 1 << (j % 64)
        keys = self._word_keys(np.array([k[0] for k in places], np.int64), np.array([k[1] for k in places], np.uint64))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.masks = np.array(list(places.values()), np.uint64).reshape(-1, self.blocks)[order]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item, row in enumerate(words):
            cuts = np.linspace(0, len(row), self.budgets[item] + 2).astype(int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                pieces.setdefault(b - a, []).append((int(window_hashes(row[a:b], b - a)[0]), item, a))
        self.pieces = {}
        for size, held in pieces.items():
            held.sort()
            hashes = np.array([p[0] for p in held], np.uint64)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.pieces[size] = (hashes, np.array([p[1] for p in held]), np.array([p[2] for p in held]), seen)

    @staticmethod
    def _word_keys(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(word + mix(item.astype(np.uint64) + np.uint64(1)))

    def hits(self, words: np.ndarray, at: np.ndarray):
        """``(text, item, word index where the item would begin)`` of exact piece hits, each once."""
        found = []
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for size, (hashes, item, offset, seen) in self.pieces.items():
            windows = window_hashes(words, size)
            if not len(windows):
                continue
            spots = np.flatnonzero(seen[(windows >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            spots = spots[owner[spots] == owner[spots + size - 1]]
            low, high = (np.searchsorted(hashes, windows[spots], side) for side in ("left", "right"))
            count = high - low
            spots, low, count = spots[count > 0], low[count > 0], count[count > 0]
            which = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            spot = np.repeat(spots, count)
            found.append(np.stack((owner[spot], item[which], spot - offset[which]), axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def matches(self, words: np.ndarray, at: np.ndarray):
        """``(text, item, distance, begin, end)`` of the best passage of each item in each text that holds it."""
        hits = self.hits(words, at)
        # lanes of like length run together
        hits = hits[np.argsort(self.sizes[hits[:, 1]], kind="stable")] if len(hits) else hits
        out = []
        for k in range(0, len(hits), LANES):
            text, item, begin = hits[k:k + LANES].T
            size, budget = self.sizes[item], self.budgets[item]
            span = int((size + 2 * budget).max())
            place = (begin - budget)[:, None] + np.arange(span)
            inside = (place >= at[text][:, None]) & (place < at[text + 1][:, None])
            keys = self._word_keys(np.repeat(item, span), words[np.clip(place, 0, len(words) - 1).ravel()])
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = (self.keys[found] == keys) & inside.ravel()
            equal = np.where(known[:, None], self.masks[found], np.uint64(0)).reshape(len(item), span, self.blocks)
            best, end = edit_distances(equal.transpose(0, 2, 1), size)
            good = best <= budget
            stop = (begin - budget + end - at[text])[good]
            out.append(np.stack((text[good], item[good], best[good], np.maximum(stop - size[good], 0), stop), axis=1))
        rows = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        rows = rows[np.lexsort((rows[:, 4], rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        return rows[new]


def _scan(shared):
    def run(batches):
        items = shared.value
        ids = np.array(items.ids, np.int64)
        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            for first, words, at in hashed_words(batch.column(1)):
                rows = items.matches(words, at)
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(rows[:, 0] + first)), pa.array(ids[rows[:, 1]]),
                     *(pa.array(rows[:, c].astype(np.int32)) for c in (2, 3, 4))],
                    names=[f.split()[0] for f in _MATCH.split(", ")])
    return run


def benchmark_matches(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``(doc_id, item_id, distance, begin_word, end_word)``: each document and item that it holds within the budget.

    ``distance`` counts word edits of the best passage; the passage ends before ``end_word``, ``begin_word`` is where it
    begins if it has the item's length.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    context, scans = documents.sparkSession.sparkContext, []
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        held = mine.orderBy("item_id", "text").toArrow()
        known = Items(held.column(0).to_pylist(), held.column(1).combine_chunks(), share)
        if known.ids:
            scans.append(rows.mapInArrow(tidy(_scan(context.broadcast(known))), _MATCH))
    if not scans:
        return documents.sparkSession.createDataFrame([], _MATCH)
    return reduce(DataFrame.unionByName, scans)


def without_benchmark(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    found = reliable(benchmark_matches(documents, benchmark, share).select(F.col("doc_id").alias("__found")).distinct())
    return documents.join(small_side(found, 32), F.col("doc_id") == F.col("__found"), "left_anti")
