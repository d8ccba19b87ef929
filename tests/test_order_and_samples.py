import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pacewise.operators import sampling
from pacewise.operators.ordering import every_nth, range_bounds, running_totals, with_ordinal
from pacewise.operators.sampling import bottom_k, merge_samples, sampled_features
from pacewise.operators.velocity import features


def test_ordinals_have_no_gap(spark):
    keys = random.Random(5).sample(range(10 ** 9), 5000)
    df = spark.createDataFrame([(k,) for k in keys], "seq long").repartition(6)
    found = {r.seq: r.ordinal for r in with_ordinal(df).collect()}
    assert found == {k: i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize("bounds", [[], [10.0], [0.0, 50.0, 51.0, 99.0], [-5.0, 500.0]])
def test_bounds_do_not_change_totals(spark, bounds):
    df = spark.range(100).withColumnRenamed("id", "seq")
    got = running_totals(df, "seq", {"s": F.col("seq")}, bounds=bounds).orderBy("seq").collect()
    assert [r.s for r in got] == [i * (i + 1) // 2 for i in range(100)]


def test_no_unpartitioned_window_over_rows(spark):
    """Only range totals meet in one window; rows are windowed per range."""
    df = with_ordinal(spark.range(1000).withColumnRenamed("id", "seq"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    rows_windowed = [line for line in plan.splitlines() if "Window [" in line and "seq" in line]
    assert rows_windowed and all("[__bucket" in line for line in rows_windowed)


def test_a_null_keeps_its_place(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "seq long")
    assert {r.seq: r.ordinal for r in with_ordinal(df).collect()} == {None: 0, 1: 1, 3: 2}


def test_sampled_features_are_those_of_the_table(rows):
    drawn = sampled_features(rows, 60)
    whole = features(rows).join(bottom_k(rows, 60).select("seq"), "seq", "left_semi").select(*drawn.columns)
    assert drawn.count() == 60 and drawn.exceptAll(whole).isEmpty()


def test_picks(spark):
    df = spark.range(0, 500, 2).withColumnRenamed("id", "seq")
    assert [r.seq for r in every_nth(df, 100).orderBy("seq").collect()] == [0, 200, 400]
    assert [r.seq for r in every_nth(df.limit(1), 100).collect()] == [0]


def test_bounds_of_nothing(spark):
    assert range_bounds(spark.range(0).withColumnRenamed("id", "seq"), "seq") == []


def test_sample_is_the_same_for_any_layout(rows):
    one = bottom_k(rows, 100).select("seq")
    two = bottom_k(rows.repartition(9), 100).select("seq")
    assert one.count() == 100 and one.exceptAll(two).isEmpty()
    assert bottom_k(rows, 100, seed=8).select("seq").exceptAll(one).count() > 50


@pytest.mark.parametrize("k", [1, 57, 1000, 4999, 5000])
def test_few_more_rows_than_drawn_are_sorted(spark, monkeypatch, k):
    df = spark.range(5000).withColumnRenamed("id", "seq")
    want = sorted(range(5000), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())[:k]
    assert {r.seq for r in bottom_k(df, k).collect()} == set(want)
    monkeypatch.setattr(sampling, "_SORTED", 0)
    assert {r.seq for r in bottom_k(df, k).collect()} == set(want)
    keys = df.select(sampling.sample_key(F.col("seq")).alias(sampling.SAMPLE_KEY))
    cut = sampling._cut(keys, k)
    assert len(cut) == 8 and k <= keys.where(F.substring(sampling.SAMPLE_KEY, 1, 8) <= cut).count() <= k + 1
    assert sampling._cut(keys, 5001) is None


def test_small_tables_are_kept_whole(rows):
    assert bottom_k(rows, 10 ** 6).count() == rows.count()


def test_samples_merge(rows):
    whole = bottom_k(rows, 80)
    low, high = rows.where("seq % 3 = 0"), rows.where("seq % 3 > 0")
    merged = merge_samples(bottom_k(low, 80), bottom_k(high, 80), 80)
    assert merged.exceptAll(whole).isEmpty() and merged.count() == 80


def test_sample_is_uniform(spark):
    df = spark.range(20_000).withColumnRenamed("id", "seq")
    mean = bottom_k(df, 2000).agg(F.avg("seq")).first()[0]
    assert abs(mean - 10_000) < 600
