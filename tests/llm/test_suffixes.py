"""Removal of repeated strings against a table of all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from pacewise.llm import suffixes
from pacewise.llm.suffixes import Levels, kept_text, removal_digests, without_repeats


def expected(rows, width=50):
    first, out = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if first.setdefault(raw[p:p + width], i) < i:
                gone[p:p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ñ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(k) for k in (8, 12, 20, 60, 200)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, len(s) // 2)
            parts.insert(rng.randint(0, len(parts)), s[cut:cut + rng.randint(30, len(s))])
        rows.append((i * 3, "".join(parts)))
    return rows + [(1001, "a" * 5000), (1002, "a" * 300), (1003, "ab" * 400), (1004, "ba" * 300), (1005, rows[5][1]), (1006, rows[5][1])]


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_equals_all_windows(docs, monkeypatch):
    rows = corpus(1)
    assert result(removal_digests(docs(rows))) == expected(rows)
    monkeypatch.setattr(suffixes, "BATCH_WINDOWS", 200)
    monkeypatch.setattr(suffixes, "STRETCH_BYTES", 2000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3000)
    assert result(removal_digests(docs(rows, 7))) == expected(rows)


def test_equal_segments_within_a_chunk(docs):
    rows = [(i, "start %d " % (i % 3) + "the same long passage of words that everybody has in the text, again and again") for i in range(40)]
    assert result(removal_digests(docs(rows, 2))) == expected(rows)


def test_other_width(docs):
    rows = corpus(2)[:60]
    assert result(removal_digests(docs(rows), 20)) == expected(rows, 20)


def test_defined_cases(docs):
    text = "x".join(map(str, range(60)))
    rows = [(1, None), (2, ""), (3, text), (4, "short"), (5, text), (5, text), (None, text)]
    got = removal_digests(docs(rows)).collect()
    assert len(got) == 7
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].n_removed == 0 and by_id[3].n_removed == 0 and by_id[4].n_removed == 0
    assert by_id[5].n_removed == by_id[5].n_bytes and by_id[5].n_spans == 1
    assert by_id[1].n_bytes == by_id[2].n_bytes == 0
    assert removal_digests(docs([])).collect() == []
    kept = sorted((r.doc_id or 0, r.text) for r in without_repeats(docs(rows)).collect() if r.text)
    assert kept == [(0, text), (3, text), (4, "short")]


def test_characters_stay_whole():
    raw = "aéb".encode()
    assert kept_text(raw, [2], [3]) == "aéb" and kept_text(raw, [1], [3]) == "ab" and kept_text(raw, [0], [2]) == "éb"


def test_levels_grow_geometrically():
    import numpy as np

    levels = Levels()
    for i in range(64):
        levels.add(np.array([b"%05d" % i] * 1, "S5"), np.array([i]))
    assert len(levels.levels) <= 7 and sum(len(k) for k, _ in levels.levels) == 64
    assert levels.first_documents(np.array([b"00007", b"99999"], "S5")).tolist() == [7, np.iinfo(np.int64).max]


def test_long_segments_with_one_polynomial():
    """Different segments that any polynomial modulo 2**64 takes for one."""
    import numpy as np

    from pacewise.llm import words

    rng = random.Random(2)
    blocks = [bytes(rng.randrange(97, 123) for _ in range(30)) for _ in range(2)]
    one, two = (b"".join(blocks[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    data = np.frombuffer(one + two, np.uint8)
    starts, ends = np.array([0, len(one)]), np.array([len(one), len(one) + len(two)])
    same = np.zeros(2, np.uint64)
    assert len(set(words.long_hashes(same, data, starts, ends).tolist())) == 2
    first = suffixes._first_of_equal(np.zeros(2, np.uint32), ends - starts, same, np.array([1, 2]))
    assert first.tolist() == [1, 2]


def test_periodic_texts(docs):
    """Segments much longer than a window: texts of repeated blocks in different order."""
    rng = random.Random(3)
    blocks = ["".join(rng.choice("abcdef ") for _ in range(30)) for _ in range(2)]
    texts = ["".join(blocks[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1)]
    rows = [(1, texts[0]), (2, texts[1]), (3, "ab" * 9000), (4, "ba" * 9000), (5, texts[0][:5000] + "x" + texts[1])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removal_digests(docs(rows)).collect()}
    assert got == expected(rows)


def test_texts_of_unshared_segments_are_not_held():
    """A task of the index holds the text of segments whose key several documents have, and no other."""
    import tracemalloc

    import zstandard

    rng = np.random.default_rng(8)
    pack, parts = zstandard.ZstdCompressor(level=1), []
    for piece in range(16):
        n = 2048
        columns = {"key": np.arange(piece * n, (piece + 1) * n).astype(np.uint32), "doc": np.arange(piece * n, (piece + 1) * n),
                   "begin": np.zeros(n, np.int32), "size": np.full(n, 1000, np.int32)}
        data = rng.integers(0, 256, n * 1000).astype(np.uint8)
        if piece == 15:  # one passage of two documents
            columns["key"][-1] = 0
            data[-1000:] = passage
        elif piece == 0:
            passage = data[:1000].copy()
        parts.append(suffixes._segment_batch(columns, data, np.arange(n) * 1000, 1, pack))
    table = pa.Table.from_batches(parts)
    run = suffixes._indexed(50, 1)
    tracemalloc.start()
    found = run(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    spans = np.frombuffer(zstandard.ZstdDecompressor().decompress(found.column("segments")[0].as_py()), np.int64)
    assert spans.tolist() == [16 * 2048 - 1, 0, 1000]
    assert peak < 16 << 20  # the texts of all segments have 33 MB
