import numpy as np
import pytest
from pyspark.sql import functions as F

from pacewise.functions.vectors import append, mean_pool, normalize
from pacewise.operators import search
from pacewise.operators.joins import join_dimension, measured_bytes, salted_join
from pacewise.operators.search import best_matches, compare_hits, search_upserted, top1, upsert
from pacewise.operators.text import embed_different, fuse, text_key


def entries(texts):
    """Trigram vectors written out plainly."""
    out = {}
    for text in texts:
        codes = [ord(c) for c in f" {text.lower()} "]
        counts = np.zeros(64)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[(a * 961 + b * 31 + c) % 65521 % 64] += 1
        norm = np.sqrt((counts ** 2).sum())
        out[text] = counts / norm if norm else counts
    return out


def test_embedding_of_each_text_once(spark):
    texts = ["GIFT Card", "gift card!", "ü", "", "日本語 テスト 😀 ok", "a" * 50_000]
    df = spark.createDataFrame([(t,) for t in texts * 3] + [(None,)], "t string").repartition(5)
    found = {r.text: np.array(r.embedding) for r in embed_different(df, "t").collect()}
    assert set(found) == set(texts)
    for text, vector in entries(texts).items():
        assert np.allclose(found[text], vector, atol=1e-12), text[:20]


def test_fuse_refuses_unknown_texts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, merchant string")
    scores = rows.limit(1).select(text_key(F.col("merchant")).alias("text_key"), F.lit(0.5).alias("score"))
    known = fuse(rows.where("merchant = 'a'"), "merchant", scores).first()
    assert known.text_similarity == 0.5
    with pytest.raises(Exception, match="no score for text"):
        fuse(rows, "merchant", scores).collect()


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]),
                                ([3.0, 4.0], [[1.0, 2.0]], [0])],
                               "v array<double>, t array<array<double>>, m array<int>")
    got = df.select(normalize(F.col("v")), mean_pool(F.col("t"), F.col("m")),
                    append(F.col("v"), F.lit(7))).collect()
    assert got[0][0] == [0.0, 0.0] and got[1][0] == pytest.approx([0.6, 0.8])
    assert got[0][1] == [2.0, 4.0] and got[1][1] == [0.0, 0.0]
    assert got[1][2] == [3.0, 4.0, 7.0]


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [-1.0, -1.0])],
                                 "q long, embedding array<float>")


def records(spark, items):
    return spark.createDataFrame(items, "id string, vector array<double>, ord long")


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_first_of_equal_scores_wins(spark, queries, limit):
    refs = records(spark, [("late", [1.0, 0.0], 5), ("early", [1.0, 0.0], 2), ("up", [0.0, 1.0], 9)])
    got = {r.q: (r.best_id, r.best_score) for r in top1(queries, refs, "q", matrix_bytes=limit).collect()}
    assert got == {1: ("early", 1.0), 2: ("up", 1.0), 3: (None, None), 4: ("early", -1.0)}


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_best_k_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(search, "QUERIES_PER_GROUP", 7)
    rng = np.random.default_rng(2)
    q, r = rng.normal(size=(40, 6)), rng.normal(size=(25, 6))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, embedding array<double>")
    refs = records(spark, [(f"r{i}", v.tolist(), i) for i, v in enumerate(r)])
    found = best_matches(queries, refs, "q", k=4, matrix_bytes=limit).collect()
    assert len(found) == 40
    for row in found:
        best = np.argsort(-(r @ q[row.q]), kind="stable")[:4]
        assert [h.id for h in row.hits] == [f"r{i}" for i in best]


def test_upsert_keeps_the_first_place(spark, queries):
    log = spark.createDataFrame([("a", [0.0, 9.0], 1), ("b", [1.0, 0.0], 2), ("a", [1.0, 0.0], 3)],
                                "id string, vector array<double>, seq long")
    assert {(r.id, tuple(r.vector), r.ord) for r in upsert(log).collect()} == {
        ("a", (1.0, 0.0), 1), ("b", (1.0, 0.0), 2)}
    assert search_upserted(queries, log, "q").where("q = 1").first().best_id == "a"


def test_search_without_references(spark, queries):
    none = records(spark, [("a", [1.0, 0.0], 1)]).where("ord > 5")
    assert {r.best_id for r in top1(queries, none, "q").collect()} == {None}


def test_compare_hits(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.25)], "q long, best_id string, best_score double")
    b = spark.createDataFrame([(1, "x", 0.5), (2, "z", 0.5)], "q long, best_id string, best_score double")
    assert tuple(compare_hits(a, b, "q").first()) == (2, 1, 0.25)


@pytest.fixture
def skewed(spark):
    facts = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 7 = 0 THEN NULL "
                                         "ELSE id % 50 END AS k")
    return facts, spark.range(40).selectExpr("id AS k", "concat('n', id) AS name")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_the_plain_join(skewed, how):
    facts, dim = skewed
    plain = facts.join(dim, "k", how)
    salted = salted_join(facts, dim, "k", how, hot_rows=100)
    assert salted.exceptAll(plain).isEmpty() and salted.count() == plain.count()


def test_dimension_is_measured_before_it_is_broadcast(skewed):
    facts, dim = skewed
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "strategy=broadcast" in plan(join_dimension(facts, dim, "k"))
    assert "__salt" in plan(join_dimension(facts, dim, "k", limit=10))
    assert measured_bytes(dim) == 40 * 32 + sum(len(f"n{i}") for i in range(40))


def test_salt_of_a_unique_column_does_not_depend_on_row_order(skewed):
    facts, dim = skewed
    facts = facts.selectExpr("*", "row_number() over (order by k) AS row")
    plain = facts.join(dim, "k", "left")
    for ordered in (facts.repartition(3).sortWithinPartitions("row"), facts.repartition(5).sortWithinPartitions(F.desc("row"))):
        salted = salted_join(ordered, dim, "k", "left", hot_rows=100, unique="row")
        assert salted.exceptAll(plain.select(*salted.columns)).isEmpty() and salted.count() == plain.count()
        text = salted._jdf.queryExecution().toString()
        assert "xxhash64" in text and "rand(" not in text
