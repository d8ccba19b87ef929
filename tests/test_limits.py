"""Things that must fail loudly, and bounds on what a task holds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pacewise import session
from pacewise.operators import search, training
from pacewise.operators.aggregates import per_key
from pacewise.operators.joins import fits_broadcast, measured_bytes, salted_join
from pacewise.operators.ordering import every_nth
from pacewise.operators.sampling import sampled_features
from pacewise.operators.velocity import features


def test_amounts_that_are_not_whole_cents_fail(spark):
    rows = spark.createDataFrame([(1, 1, 0.004, 1), (1, 2, 1.0, 2)], "account long, step int, amount double, seq long")
    for act in (lambda: features(rows).collect(), lambda: per_key(rows, "account", "amount").collect()):
        with pytest.raises(Exception, match="not whole in minor units"):
            act()
    exact = features(rows, decimals=3).orderBy("seq").collect()
    assert exact[1].window_sum == 0.004
    large = rows.withColumn("amount", F.lit(123456789012.37))
    assert features(large).orderBy("seq").collect()[1].window_sum == 123456789012.37


def test_no_stand_in_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session._stand_in("app", "spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session._stand_in("app", "local-cluster[2,1,1024]")
    assert session._stand_in("app", "local[4]")


def test_fit_in_one_task_equals_fit_by_passes(rows, monkeypatch):
    sample = sampled_features(rows)
    one = training.fit(sample, epochs=20)
    monkeypatch.setattr(training, "ONE_TASK_BYTES", 0)
    many = training.fit(sample, epochs=20)
    assert np.allclose(one.weights, many.weights) and np.isclose(one.bias, many.bias)


def test_a_bounded_sample_fits_and_all_rows_are_scored(rows):
    sample = sampled_features(rows, 300)
    found = training.backfill_auc(training.fit(sample, epochs=20), features(rows), sample).first()
    assert sample.count() == 300 and found.positives + found.negatives == rows.count()
    assert 0 <= found.auc_in_sample <= 1


def test_nested_columns_are_measured(spark):
    rows = spark.range(1).select(F.create_map(F.lit("k"), F.repeat(F.lit("x"), 100_000)).alias("m"),
                                 F.array(F.repeat(F.lit("y"), 100_000)).alias("a"))
    assert measured_bytes(rows) > 200_000 and not fits_broadcast(rows, 150_000)


def test_equal_rows_of_a_hot_key_are_spread(spark):
    facts = spark.range(0, 20_000, 1, 4).select(F.lit(1).alias("k"))
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string")
    joined = salted_join(facts, dim, "k", "left", hot_rows=1000)
    assert joined.count() == 20_000 and joined.where("name <> 'one'").isEmpty()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "rand(" in plan


def test_scores_come_in_bounded_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    references = pa.table({"id": [str(i) for i in range(50)], "ord": pa.array(range(50), pa.int64()),
                           "vector": pa.array(rng.integers(0, 3, (50, 4)).astype(float).tolist(), pa.list_(pa.float64()))})
    queries = pa.array([None, *rng.integers(0, 3, (40, 4)).astype(float).tolist()], pa.list_(pa.float64()))
    known = search._ReferenceSet(references)
    want = [known.best(queries, k).to_pylist() for k in (1, 7)]
    seen = []
    inner = search._ReferenceSet._best_of
    monkeypatch.setattr(search, "SCORE_BYTES", 8 * 50 * 3)
    monkeypatch.setattr(search._ReferenceSet, "_best_of", lambda self, q, k: seen.append(len(q)) or inner(self, q, k))
    assert [known.best(queries, k).to_pylist() for k in (1, 7)] == want and max(seen) == 3


def test_an_embedder_of_references_runs_once_for_each(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(i):
        calls.add(1)
        return [float(i), 1.0]

    references = spark.range(64).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"), embed("id").alias("vector"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "q int, embedding array<double>")
    assert search.top1(queries, references, "q").first().best_id == "63"
    assert calls.value == 64


def test_every_nth_touches_few_ranges(spark):
    rows = spark.range(0, 10_000, 1, 8).select((F.col("id") * 3).alias("seq"))
    got = [(r.seq, r.ordinal) for r in every_nth(rows, 3000, 3).collect()]
    assert got == [(0, 0), (9000, 3000), (18000, 6000)]
    assert [r.ordinal for r in every_nth(rows, 1, 4).collect()] == [0, 1, 2, 3]
