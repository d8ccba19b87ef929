"""The Jaccard join against all pairs in plain Python."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from pacewise.llm import jaccard
from pacewise.llm.jaccard import near_duplicates, one_of_each_group
from pacewise.llm.scale import components


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    head = {i: i for i in sets}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            head[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for family in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 20, 60, 200]))]
        if family % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.2:
                copy = copy[:int(len(copy) * 0.85)]
            rows.append((len(rows), " ".join(copy)))
    return rows


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_all_pairs(docs, monkeypatch):
    for seed in (1, 2):
        rows = corpus(seed)
        assert result(near_duplicates(docs(rows))) == expected(rows)


def test_small_pieces_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", 2)
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 50)
    rows = corpus(3)
    assert result(near_duplicates(docs(rows))) == expected(rows)


def test_defined_cases(docs):
    text = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, text), (5, text.upper()), (6, "short one"), (7, "Short  One"), (8, "z " * 9000),
            (4, text), (None, text), (9, "lone")]
    got = near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by_id == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (3, 4), 5: (3, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 9), None: (3, None)}
    kept = sorted(r.doc_id or 0 for r in one_of_each_group(docs(rows)).collect())
    assert kept == [0, 1, 2, 3, 4, 6, 8, 9]


def test_empty_table(docs):
    assert near_duplicates(docs([])).collect() == []


def test_border_of_similarity():
    a = np.arange(100, dtype=np.uint64)
    assert jaccard.similar(a[:90], a[10:100], 80) and not jaccard.similar(a[:89], a[10:100], 80)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (205, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200, 205: 200}


def thue_morse(size, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(size))


def test_long_words_with_one_polynomial(docs):
    """Words that are equal for every polynomial modulo 2**64 are different shingles."""
    rows = [(i, thue_morse(size, letters)) for i, (size, letters) in enumerate(
        (n, x) for n in (1024, 2048, 4096) for x in ("ab", "ba"))]
    assert result(near_duplicates(docs(rows))) == expected(rows)


def test_components_that_are_not_stable_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(chain, rounds=2)
