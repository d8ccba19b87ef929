"""Learned scores on held-out rows, and their defined cases."""

import random
import zlib

import numpy as np
import pytest

from pacewise.llm import language, quality

WORDS = {"en": "the of and house with that water light".split(), "de": "der und nicht haus mit das wasser licht".split(),
         "es": "el y no casa con que agua luz".split()}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def rows(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))), lang))
    return out


def test_languages(docs):
    table = rows()
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "de"), (1003, "wasserlicht", None), (None, "the house", None), (5, table[5][1], table[5][2]),
           (1004, "lichthaus " * 5000, None)]
    got = language.identified(docs(table + odd)).collect()
    assert len(got) == len(table) + len(odd)
    by_id = {r.doc_id: r for r in got}
    known = [(t, by_id[t[0]]) for t in table]
    assert all(r.held_out == held(r.doc_id) for _, r in known) and any(r.held_out for _, r in known)
    assert all(t[2] == r.lang_pred for t, r in known)
    assert all(0 <= r.score <= 1 for r in got)
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[1003].lang_pred == by_id[1004].lang_pred == "de" and by_id[None].lang_pred == "en"


def test_backoff_score_by_hand(docs):
    model = language.LanguageModel(["a", "b"], {"x": 0}, np.array([[-1.0, -2.0]]), {" ": 0, "y": 1, " y": 2},
                                   np.array([[-3.0, -3.0], [-2.0, -1.0], [-4.0, -1.5], [-9.0, -9.0]]))
    # " y ": " y" is known (one letter dropped), then "y" (one dropped)
    want = (np.array([-4.0, -1.5]) + np.array([-2.0, -1.0]) + 2 * language.DISCOUNT) / 2
    assert np.allclose(model.backoff(["y"])[0], want)
    langs, scores, table = model.predict(["x", "y y", None, "9"], {}, np.zeros((0, 2)))
    assert langs == ["a", "b", "und", "und"] and np.isclose(scores[0], 1 / (1 + np.exp(-1)))
    assert len(table) == 2


def test_nothing_to_learn(docs):
    assert [r.lang_pred for r in language.identified(docs([(1, "the house")])).collect()] == ["und"]
    assert language.identified(docs([])).collect() == []


def test_bounded_fit(docs):
    model = language.fit(docs(rows()), most=60)
    assert model.languages == ["de", "en", "es"]


@pytest.fixture
def marked(docs, spark):
    rng = random.Random(2)
    table, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = [rng.choice(WORDS["en"]) for _ in range(rng.randint(5, 60))]
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * len(words)
        table.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return table, labels


def test_quality(docs, spark, marked):
    table, labels = marked
    odd = [(900, None), (901, ""), (None, "the house"), (7, table[7][1]), (902, "w " * 20000)]
    more = [(901, None, 0), (None, 1, 0), (7, labels[7][1], 0), (5000, 1, 0)]
    got = quality.quality_scores(docs(table + odd), spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(table) + len(odd)
    by_id = {r.doc_id: r for r in got}
    test = [(by_id[i].score, by_id[i].predicted, y) for i, y, _ in labels if held(i)]
    assert len(test) > 40 and all(0 <= s <= 1 for s, _, _ in test)
    assert np.mean([p == y for _, p, y in test]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got) and by_id[900].score == by_id[901].score


def test_quality_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in quality.quality_scores(docs([(1, "x")]), none).collect()] == [(0.5, 1)]
    assert quality.quality_scores(docs([]), none).collect() == []


def test_isotonic_pools_violators():
    out = quality.isotonic(np.array([2, 0, 2, 2, 1]), np.array([0, 0, 2, 1, 1]))
    assert out.tolist() == [0.0, 0.0, 0.75, 0.75, 1.0]
