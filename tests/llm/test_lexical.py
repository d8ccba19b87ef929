"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import pytest

from pacewise.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts, n in held:
            score = 0
            for t in terms(text):
                if counts[t]:
                    m = 25 + 75 * n * n_docs // length
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return sorted(out, key=str)


def made(seed, docs, items):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Straße", "日本", "ÉTÉ", "X1", "the", "The"]
    text = lambda most: " ".join(words[min(int(rng.paretovariate(0.6)) - 1, len(words) - 1)] for _ in range(rng.randint(0, most)))
    return [(i, text(120)) for i in range(docs)], [(i, text(30)) for i in range(items)]


@pytest.fixture
def items_table(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id long, text string, score string, rank string")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, items_table, monkeypatch, seed):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 32)
    rows, items = made(seed, 900, 25)
    got = lexical.search(docs(rows), items_table(items))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_defined_cases(docs, items_table):
    rows = [(1, None), (2, ""), (3, "..."), (4, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (None, "alpha beta"),
            (7, "alpha " * 50000), (8, "gamma, GAMMA"), (9, "unbroken" * 200000 + " beta")]
    items = [(1, "Alpha!"), (2, None), (3, ""), (4, "nothing here"), (5, "gamma beta gamma"), (5, "beta"), (6, "beta"), (6, "beta"), (None, "gamma")]
    got = sorted(map(tuple, lexical.search(docs(rows), items_table(items), top=4).collect()), key=str)
    assert got == brute(rows, items, 4)


def test_blocks_of_queries(docs, items_table):
    rows, items = made(3, 200, 20)
    got = lexical.search(docs(rows), items_table(items), block_bytes=300)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items)


def test_empty_tables(docs, items_table):
    rows, items = made(4, 20, 3)
    assert lexical.search(docs([]), items_table(items)).collect() == []
    assert lexical.search(docs(rows), items_table([])).collect() == []
    assert lexical.search(docs([(1, None), (2, "!!")]), items_table(items)).collect() == []


def test_bounds_rule_out(monkeypatch):
    """Buckets and rows that cannot reach the score are not scored."""
    import numpy as np

    rng = np.random.default_rng(1)
    size, per_row = 500, 20
    terms = np.concatenate([np.sort(rng.choice(200, per_row, replace=False)) for _ in range(size)])
    impacts = rng.integers(1, 1_000_000, size * per_row)
    norms = np.sqrt(np.square(impacts.astype(float)).reshape(size, per_row).sum(axis=1))
    bucket = lexical.Bucket(norms, np.full(size, per_row), terms, impacts)
    query, values = np.array([3, 50, 77, 120]), np.array([9000, 400, 3000, 100])
    dense = np.zeros(200, np.int64)
    dense[query] = values
    scores = bucket.scores(np.arange(size), dense)
    least = int(np.sort(scores)[-10])
    rows = bucket.candidates(query, values, float(np.sqrt(np.square(values.astype(float)).sum())), least)
    assert set(np.flatnonzero(scores >= least)) <= set(rows) and len(rows) < size // 4
