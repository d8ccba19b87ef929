"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte of a document goes if a string of ``width`` bytes over it also starts in a document
with a smaller id. Every window of ``width`` bytes has a key, the least hash of the
k-byte strings inside it; equal windows have equal keys. Neighbouring windows with one key
make a segment, and segments are shuffled by key, so equal windows meet in one task while
the text moves about once. A task drops keys of one document only, settles equal segments
at once, and takes the rest in order of id: each batch gets a suffix array (its suffixes
in sorted order, compared up to ``width`` bytes), is merge-scanned against the existing
levels, and what is new becomes a level; levels of about equal size merge, so there are
logarithmically many. Only the first document of a string stays in the index.

A task map-side keeps one of equal segments (that of the least id in its chunk), so a passage
that a third of all documents share reaches the shuffle once per chunk, not once per document.

Defined cases. A null text is empty. A row with a null id loses nothing and removes nothing.
Rows that repeat an id and its text have equal results; neither removes from the other. Other
columns are ignored. Windows never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.llm.words import chunks, give_back, long_hashes, mix, mix_in_place, powers, slices, tidy
from pacewise.session import reliable

WIDTH = 50
KEY_BYTES = 10
BUCKET_BYTES = 6 << 20     # text that one task of the index holds, on average
BATCH_WINDOWS = 1 << 16    # windows of one suffix array before it joins the levels
STRETCH_BYTES = 1 << 20    # segments of neighbouring keys that are searched together
BROADCAST_BYTES = 32 << 20

_SEGMENTS = "bucket int, rows int, segments binary"


def _sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= size:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return h if reach == size else np.minimum(h[:len(h) - (size - reach)], h[size - reach:])


def _segments_of(data: np.ndarray, offsets: np.ndarray, width: int, k: int):
    """``(key, text row, begin, end, content hash)`` of all segments; begin and end are bytes of ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    sums, inverse = _sums(data)
    hashes = sums[k:] - sums[:-k]
    hashes *= inverse[:len(hashes)]
    least = _sliding_min(mix_in_place(hashes), width - k + 1)
    # windows that start in the last bytes of a text cross its end
    inside = np.ones(len(least), bool)
    crossing = (offsets[1:, None] - np.arange(1, width)).ravel()
    inside[crossing[(crossing >= 0) & (crossing < len(least))]] = False
    begins = inside.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + width
    content = long_hashes(mix((sums[end] - sums[begin]) * inverse[begin]), data, begin, end)
    return least[begin], np.searchsorted(offsets, begin, "right") - 1, begin, end, content


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the bytes times the powers of the hash base, and the inverse powers."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    sums[1:] = data
    sums[1:] += np.uint64(1)
    sums[1:] *= power[:len(data)]
    np.cumsum(sums[1:], out=sums[1:])
    return sums, inverse


def _first_of_equal(key: np.ndarray, size: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document among those with an equal segment, for each segment."""
    order = np.lexsort((doc, size, content, key))
    new = np.ones(len(order), bool)
    for column in (key, size, content):
        ordered = column[order]
        new[1:] &= ordered[1:] == ordered[:-1]
    new[1:] = ~new[1:]
    least = np.empty(len(order), doc.dtype)
    least[order] = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else doc[:0]
    return least


def ragged(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    total = int(size.sum())
    kind = np.int32 if max(len(data), total) < 1 << 31 else np.int64
    at = np.repeat((begin - (np.cumsum(size) - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return data[at]


# Keys travel as 32 bits: two that look alike only cost a comparison, equality is by content.
_FIELDS = (("key", np.uint32), ("doc", np.int64), ("begin", np.int32), ("size", np.int32))


def _shipped(width: int, k: int, buckets: int, parts: int):
    """Segments by bucket of their key, and spans settled within a chunk (negative bucket: part)."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end_row, data, offsets in chunks(batch.column(1)):
                key, row, begin, end, content = _segments_of(data, offsets, width, k)
                doc, local = docs[first:end_row][row], begin - offsets[row]
                least = _first_of_equal(key, end - begin, content, doc)
                settled = doc > least
                if settled.any():
                    yield _span_batch(*_merged(doc[settled], local[settled], (local + end - begin)[settled]), parts, pack)
                keep = ~settled
                columns = {"key": key[keep] >> np.uint64(32), "doc": doc[keep], "begin": local[keep].astype(np.int32),
                           "size": (end - begin)[keep].astype(np.int32)}
                yield _segment_batch(columns, data, begin[keep], buckets, pack)
    return run


def _segment_batch(columns, data, begin, buckets, pack) -> pa.RecordBatch:
    at = (mix(columns["key"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(buckets + 1))
    some, rows, blobs = [], [], []
    for b in range(buckets):
        mine = order[cuts[b]:cuts[b + 1]]
        if len(mine):
            some.append(b)
            rows.append(len(mine))
            head = b"".join(columns[name][mine].astype(kind).tobytes() for name, kind in _FIELDS)
            blobs.append(pack.compress(head + ragged(data, begin[mine], columns["size"][mine].astype(np.int64)).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())],
                                      names=["bucket", "rows", "segments"])


def _merged(doc, begin, end):
    """Spans of each document in order, with touching or overlapping ones put together."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order].astype(np.int64)
    if not len(doc):
        return doc, begin.astype(np.int64), end
    # a running maximum of the ends that starts anew with each document
    rank = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    lift = rank * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = np.r_[True, (doc[1:] != doc[:-1]) | (begin[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    return doc[at], begin[at].astype(np.int64), np.maximum.reduceat(end, at)


def _span_batch(doc, begin, end, parts, pack) -> pa.RecordBatch:
    at = (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(parts + 1))
    some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
    blobs = [pack.compress(b"".join(x[order[cuts[p]:cuts[p + 1]]].astype(np.int64).tobytes() for x in (doc, begin, end)))
             for p in some]
    return pa.RecordBatch.from_arrays(
        [pa.array([-1 - p for p in some], pa.int32()), pa.array([int(cuts[p + 1] - cuts[p]) for p in some], pa.int32()),
         pa.array(blobs, pa.binary())], names=["bucket", "rows", "segments"])


class Levels:
    """Sorted arrays of distinct strings, each with the first document that holds it; sizes grow geometrically."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def first_documents(self, keys: np.ndarray) -> np.ndarray:
        """For sorted ``keys`` the first document known to hold each; the largest integer where none does."""
        known = np.full(len(keys), np.iinfo(np.int64).max)
        for theirs, docs in self.levels:
            at = np.minimum(np.searchsorted(theirs, keys), len(theirs) - 1)
            known = np.where(theirs[at] == keys, np.minimum(known, docs[at]), known)
        return known

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        if not len(keys):
            return
        self.levels.append((keys, docs))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(-2), self.levels.pop()
            both, firsts = np.concatenate((a, b)), np.concatenate((x, y))
            del a, b, x, y
            order = np.argsort(both, kind="stable")  # two sorted runs: one linear merge
            self.levels.append((both[order], firsts[order]))


def suffix_array(text: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` that start at ``at``, in the order of their first ``width`` bytes, and those bytes."""
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, width)[at]).view(f"S{width}").ravel()
    # most pairs differ in their first eight bytes: order by these, then mend runs of equal ones
    word = np.zeros(len(at), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | text[at + j]
    order = np.argsort(word, kind="stable")
    ordered = word[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    run = np.cumsum(new) - 1
    tied = np.flatnonzero(np.bincount(run)[run] > 1) if len(at) else np.zeros(0, int)
    if len(tied):
        group = order[tied]
        inner = np.argsort(keys[group], kind="stable")
        order[tied] = group[inner]
    return order, keys[order]


def _repeats(doc, begin, size, text, width: int):
    """Spans of windows that a smaller document holds too, among segments in order of document."""
    levels, out = Levels(), []
    offset = np.r_[0, np.cumsum(size)[:-1]]
    windows = size - width + 1
    total = np.r_[0, np.cumsum(windows)]
    first = 0
    while first < len(doc):
        end = max(first + 1, int(np.searchsorted(total, total[first] + BATCH_WINDOWS, "right")) - 1)
        many = windows[first:end]
        which = np.repeat(np.arange(first, end), many)
        inner = np.arange(many.sum()) - np.repeat(total[first:end] - total[first], many)
        order, keys = suffix_array(text, offset[which] + inner, width)
        owner = doc[which][order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(owner, at)
        known = levels.first_documents(keys[at])
        fresh = known == np.iinfo(np.int64).max
        levels.add(keys[at][fresh], least[fresh])
        earliest = np.minimum(least, known)[np.cumsum(new) - 1]
        hit = np.zeros(len(order), bool)
        hit[order] = owner > earliest
        if hit.any():
            w = which[hit]
            b = begin[w] + inner[hit]
            out.append(_merged(doc[w], b, b + width))
        first = end
    return out


def _in_stretch(key, doc, begin, size, text, width: int):
    """Spans that go among segments in order of document: equal segments at once, the rest by the index."""
    place = np.r_[0, np.cumsum(size)[:-1]]
    sums, inverse = _sums(text)
    content = long_hashes(mix((sums[place + size] - sums[place]) * inverse[place]), text, place, place + size)
    settled = doc > _first_of_equal(key, size, content, doc)
    rest = ~settled
    return [_merged(doc[settled], begin[settled], (begin + size)[settled]),
            *_repeats(doc[rest], begin[rest], size[rest], ragged(text, place[rest], size[rest]), width)]


def _texts_of(keep: np.ndarray, size: np.ndarray, pieces: list, unpack) -> tuple[np.ndarray, np.ndarray]:
    """The texts of the segments ``keep``, and where in it each lies; the pieces are unpacked one at a time."""
    stays = np.zeros(len(size), bool)
    stays[keep] = True
    head = sum(np.dtype(kind).itemsize for _, kind in _FIELDS)
    texts, first = [np.zeros(0, np.uint8)], 0
    for rows, blob in pieces:
        own, mine = size[first:first + rows], np.flatnonzero(stays[first:first + rows])
        if len(mine):
            raw = np.frombuffer(unpack.decompress(blob.as_py()), np.uint8, offset=rows * head)
            texts.append(ragged(raw, (np.cumsum(own) - own)[mine], own[mine]))
        first += rows
    return np.concatenate(texts), np.r_[0, np.cumsum(np.where(stays, size, 0))[:-1]]


def _indexed(width: int, parts: int):
    """Spans found in one bucket of segments; spans of a part only pass."""
    def run(table: pa.Table) -> pa.Table:
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        held: dict[str, list] = {name: [] for name, _ in _FIELDS}
        pieces = list(zip(table.column("rows").to_pylist(), table.column("segments")))
        for rows, blob in pieces:
            raw, at = unpack.decompress(blob.as_py()), 0
            for name, kind in _FIELDS:
                held[name].append(np.frombuffer(raw, kind, rows, at).copy())  # without its text
                at += rows * np.dtype(kind).itemsize
        key, doc, begin, size = (np.concatenate(held.pop(name)) for name, _ in _FIELDS)
        size, begin = size.astype(np.int64), begin.astype(np.int64)
        # a key that only one document has cannot repeat
        order = np.lexsort((doc, key))
        change = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        last = np.r_[change[1:], len(order)] - 1
        shared = np.repeat(doc[order][change] != doc[order][last], np.diff(np.r_[change, len(order)]))
        keep = order[shared]
        del raw, order, shared
        text, place = _texts_of(keep, size, pieces, unpack)
        # equal windows have one key: stretches of keys are searched one after the other
        cuts = np.flatnonzero(np.r_[True, key[keep][1:] != key[keep][:-1], True])
        filled = np.r_[0, np.cumsum(size[keep])]
        found, at = [(doc[:0], begin[:0], begin[:0])], 0
        while at < len(cuts) - 1:
            end = max(at + 1, int(np.searchsorted(filled[cuts], filled[cuts[at]] + STRETCH_BYTES, "right")) - 1)
            mine = keep[cuts[at]:cuts[end]]
            mine = mine[np.argsort(doc[mine], kind="stable")]
            found += _in_stretch(key[mine], doc[mine], begin[mine], size[mine], ragged(text, place[mine], size[mine]), width)
            at = end
        d, b, e = _merged(*(np.concatenate([x[i] for x in found]) for i in range(3)))
        del text, found
        give_back()
        return pa.Table.from_batches([_span_batch(d, b, e, parts, pack)])
    return run


def _put_together(table: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor()
    held = [np.frombuffer(unpack.decompress(blob.as_py()), np.int64).reshape(3, rows)
            for rows, blob in zip(table.column("rows").to_pylist(), table.column("segments"))]
    doc, begin, end = _merged(*np.concatenate(held, axis=1))
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    cuts = pa.array(np.r_[at, len(doc)].astype(np.int32))
    return pa.table({"doc": doc[at], "begins": pa.ListArray.from_arrays(cuts, pa.array(begin)),
                     "ends": pa.ListArray.from_arrays(cuts, pa.array(end))})


def repeated_spans(documents: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc, begins, ends)`` of the byte spans that go, for documents that have any. The ends are exclusive."""
    if width < 8:
        raise ValueError("a width of at least 8 bytes is needed")
    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc"), F.col(f"`{text_column}`").alias("text"))
    rows = rows.where(F.col("doc").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, parts = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // (64 * BUCKET_BYTES)))
    shipped = rows.mapInArrow(tidy(_shipped(width, min(KEY_BYTES, width), buckets, parts)), _SEGMENTS)
    # The negative buckets hold settled spans; they need no index, but go the same way.
    both = shipped.groupBy("bucket").applyInArrow(_either(width, parts), _SEGMENTS)
    return both.groupBy("bucket").applyInArrow(_put_together, "doc long, begins array<long>, ends array<long>")


def _either(width: int, parts: int):
    index = _indexed(width, parts)

    def run(table: pa.Table) -> pa.Table:
        return table if table.column("bucket")[0].as_py() < 0 else index(table)
    return run


def with_spans(documents: DataFrame, spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Documents with their ``__begins`` and ``__ends``; broadcasts the spans if their counted size is small."""
    spans = reliable(spans.select(F.col("doc").alias("__doc"), F.col("begins").alias("__begins"), F.col("ends").alias("__ends")))
    size = spans.agg(F.coalesce(F.sum(F.size("__begins") * 16 + 64), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    return documents.join(spans, F.col(f"`{id_column}`") == F.col("__doc"), "left").drop("__doc")


def _digests(batches):
    for batch in slices(batches):
        out = [[] for _ in range(4)]
        for text, begins, ends in zip(*(batch.column(i) for i in (1, 2, 3))):
            raw = (text.as_py() or "").encode()
            digest, at, gone, begins = hashlib.sha256(), 0, 0, begins.as_py() or []
            for b, e in zip(begins, ends.as_py() or []):
                digest.update(raw[at:b])
                gone += e - b
                at = e
            digest.update(raw[at:])
            for column, value in zip(out, (len(raw), gone, len(begins), digest.hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digests(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row."""
    rows = documents.select("doc_id", "text")
    return (with_spans(rows, repeated_spans(rows, width)).select("doc_id", "text", "__begins", "__ends")
            .mapInArrow(tidy(_digests), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def kept_text(raw: bytes, begins, ends) -> str:
    """The text without its spans; a character stays whole if any of its bytes stays."""
    whole = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80  # noqa: E731  # inside a character
    out, at = [], 0
    for b, e in zip(begins, ends):
        while whole(b):
            b += 1
        while e > b and whole(e):
            e -= 1
        if b < e:
            out.append(raw[at:b])
            at = e
    out.append(raw[at:])
    return b"".join(out).decode()


def without_repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Documents with the repeated bytes taken out of their text; a document that loses all its text goes.

    A character goes only if all its bytes do. ``n_chars`` follows the text where it exists.
    """
    columns = documents.columns
    spanned = with_spans(documents.withColumnRenamed("text", "__raw"), repeated_spans(documents, width))
    names = [c for c in columns if c != "text"]
    rows = spanned.select("__raw", "__begins", "__ends", *names)
    fields = [T.StructField("text", T.StringType()), *rows.schema.fields[3:]]

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            for i, (b, e) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if b:
                    texts[i] = kept_text(texts[i].encode(), b, e) or None
            keep = pa.array([t is not None or b is None for t, b in zip(texts, batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[3:]],
                                             names=["text", *batch.schema.names[3:]]).filter(keep)

    kept = rows.mapInArrow(tidy(run), T.StructType(fields))
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return kept.select(*columns)
