"""Base counts, certified cutoffs and mixtures against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pacewise.llm import mixing, rules

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = SPLIT.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n ", "a", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n\nx", "#é* |日\x0b<b>\x0c&\r\n", "a b c d a b c e b c d",
         " lead\ttrail ", "w " * 3000, "\n".join(["same line here"] * 4), "p q r s " * 20 + "z y x"]


def test_counts(docs):
    rows = list(enumerate(TEXTS)) + [(None, "a b c"), (4, "a b c")]
    got = rules.measures(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(TEXTS[r.doc_id]), r


@pytest.mark.parametrize("n", [1, 50, 309, 310, 5000, 200_000])
def test_allowed_is_the_exact_bound(spark, n):
    level = 0.002
    got = spark.range(1).select(rules.allowed(F.lit(n), F.lit(level))).first()[0]
    total, k = 0.0, -1
    for i in range(n):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                          + i * math.log(rules.RISK) + (n - i) * math.log(1 - rules.RISK))
        if total > level:
            break
        k = i
    assert got == k


def test_allowed_with_very_many_documents(spark):
    n = 100_000_000
    got = spark.range(1).select(rules.allowed(F.lit(n), F.lit(0.002))).first()[0]
    sigma = math.sqrt(n * rules.RISK * (1 - rules.RISK))
    assert abs(got - (n * rules.RISK - 2.878 * sigma)) < 10  # normal approximation


def test_cutoffs_keep_their_promise(docs, spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(2400):
        good = i % 4 > 0
        words = ["word%d" % rng.randrange(5000) for _ in range(60)]
        for _ in range(0 if good and i % 301 else 20):
            words[rng.randrange(60)] = "##"
        rows.append((i, " ".join(words), "en" if i % 2 else None))
        labels.append((i, int(good)))
    table = docs(rows + [(3000, None, "en"), (None, "x", "en")])
    got = {r.doc_id: r for r in rules.judged(table, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")).collect()}
    assert len(got) == 2402 and got[3000].base_failed and not got[3000].kept
    good = [got[i].kept for i, q in labels if q]
    bad = [got[i].kept for i, q in labels if not q]
    assert 1 - sum(good) / len(good) <= rules.RISK and sum(bad) == 0


def test_without_labels_only_base_rules(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, "a b"), (2, " ".join(map(str, range(60)))), (3, "x y z " * 40)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.judged(docs(rows), none).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False)}
    assert rules.judged(docs([]), none).collect() == []


def fill(sizes):
    """Targets by repeated sharing of the excess."""
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weights[s] / sum(weights[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixture(docs, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_ROWS", 40)
    monkeypatch.setattr(mixing, "PIECE_SLOTS", 500)
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([0, 1, 7, 40, 300]), "en", rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    rows += [(900, None, "en", "a"), (901, "one two", "en", "tiny"), (902, "", "en", "empty"), (5, rows[5][1], "en", rows[5][3]), (None, "x y z", "en", "b")]
    got = mixing.mixture_digest(docs(rows)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixture_digest(docs(rows, 5)).collect()), key=str)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = fill(sizes)
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert want["tiny"] == 6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 6, (s, taken[s], want[s])


def test_slots_hold_equal_blocks(docs):
    rows = [(i, "w " * 50, "en", "ab"[i % 2]) for i in range(400)]
    _, filled = mixing.mixed(docs(rows))
    full = filled.groupBy("slot").agg(F.sum("words").alias("words")).collect()
    assert {r.words for r in full} == {1} and len(full) == 20000


def test_no_words(docs):
    assert [r.taken for r in mixing.mixture_digest(docs([(1, None, "en", "a"), (2, " ", "en", None)])).collect()] == [0, 0]
    assert mixing.mixture_digest(docs([])).collect() == []
