import math

import pytest
from pyspark.sql import functions as F

from pacewise.functions.money import exact_sum
from pacewise.functions.predicates import compare
from pacewise.operators import aggregates as A
from pacewise.operators import partials as P
from pacewise.operators import quantiles
from pacewise.operators.quantiles import approximate, nearest_rank
from pacewise.schema import conform, numeric, step_of


@pytest.fixture
def few(spark):
    return spark.createDataFrame([(1,), (None,), (3,)], "v int")


@pytest.fixture
def nulls(spark):
    return spark.createDataFrame([(None,), (None,)], "v int")


def test_nulls_are_skipped(few):
    row = few.agg(A.total(F.col("v")), A.strict_min(F.col("v")), A.strict_max(F.col("v")),
                  A.strict_mean(F.col("v"))).first()
    assert tuple(row) == (4, 1, 3, 2.0)


def test_sum_of_nothing_is_zero(nulls, few):
    assert nulls.agg(A.total(F.col("v"))).first()[0] == 0
    assert few.where("v > 9").agg(A.total(F.col("v"))).first()[0] == 0


@pytest.mark.parametrize("strict", [A.strict_min, A.strict_max, A.strict_mean])
def test_strict_aggregates_fail_without_values(nulls, strict):
    with pytest.raises(Exception, match="of no values"):
        nulls.agg(strict(F.col("v"))).collect()


def test_filtered_aggregate_without_match(few):
    assert tuple(A.filtered_aggregate(few, "v", [("v", ">", 1e9)]).first()) == (0.0, 0, 0.0)
    assert A.filtered_mean(few, "v", [("v", ">", 1e9)]).first()[0] == 0.0


def test_all_negative_maximum(spark):
    df = spark.createDataFrame([(-3.0,), (-1.5,)], "v double")
    assert tuple(A.filtered_aggregate(df, "v").first()) == (-4.5, 2, -1.5)


def test_conditions_reach_the_scan(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    df = A.filtered_aggregate(lines, "l_extendedprice", [("l_quantity", ">", 10), ("l_quantity", "<", 20)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "LessThan(l_quantity,20.0)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double>" in plan


def test_arguments_are_checked(spark, few):
    with pytest.raises(ValueError, match="comparison"):
        compare(few, "v", "!", 1)
    with pytest.raises(ValueError, match="no column"):
        numeric(few, "w")
    with pytest.raises(TypeError, match="number is needed"):
        numeric(spark.createDataFrame([("a",)], "t string"), "t")


def test_mean_comes_from_sums(spark):
    parts = spark.createDataFrame([(1, 1000, 10.0, 10.0), (3, 200, 0.5, 1.0)], P.PARTIAL_SCHEMA)
    row = P.finish(P.merge(parts)).first()
    assert (row["count"], row["sum"], row["mean"], row["min"], row["max"]) == (4, 12.0, 3.0, 0.5, 10.0)


def test_empty_parts(spark):
    parts = spark.createDataFrame([(0, 0, None, None), (1, 500, 5.0, 5.0)], P.PARTIAL_SCHEMA)
    row = P.finish(P.merge(parts)).first()
    assert (row["min"], row["max"]) == (5.0, 5.0)
    none = P.finish(P.merge(parts.where("n > 9"))).first()
    assert math.isnan(none["mean"]) and (none["min"], none["max"]) == (math.inf, -math.inf)


def test_quantile_index(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "v")
    assert tuple(nearest_rank(df, "v", {"p50": 0.5, "p100": 1.0, "p0": 0.0}).first()) == (6, 10, 1, 10)


@pytest.mark.parametrize("q", [0.1, 0.25, 0.5, 0.9, 0.999])
def test_quantiles_with_a_heavy_value(spark, q):
    values = sorted([5] * 300 + list(range(1000)) + [7] * 200)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    expected = values[min(len(values) - 1, math.floor(q * len(values)))]
    assert nearest_rank(df, "v", {"q": q}).first().q == expected
    assert abs(approximate(df, "v", {"q": q}).first().q - expected) <= 1


@pytest.mark.parametrize("values", [
    [5.0] * 4000 + [float(i) for i in range(3000)], [0.0] * 3500 + [1.0] * 3500, [float("nan")] * 3000 + [1.5 ** (i % 997) for i in range(4000)],
    [float(i * 7919 % 6000) for i in range(6000)]])
def test_ranges_are_narrowed(spark, monkeypatch, values):
    """Many rounds over small samples: heavy values, two values only, NaN, long tails."""
    monkeypatch.setattr(quantiles, "HELD_ROWS", 40)
    monkeypatch.setattr(quantiles, "BOUND_SAMPLE", 300)
    ordered = sorted(values, key=lambda v: (v != v, v))
    wanted = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.501, "e": 0.999, "f": 1.0}
    got = nearest_rank(spark.createDataFrame([(v,) for v in values], "v double").repartition(5), "v", wanted).first()
    for name, q in wanted.items():
        assert str(got[name]) == str(ordered[min(len(values) - 1, math.floor(q * len(values)))])
    assert str(got["max"]) == str(ordered[-1])


def test_quantiles_of_nothing(few):
    assert tuple(nearest_rank(few.where("v > 9"), "v", {"q": 0.5}).first()) == (None, None)


def test_exact_sum_does_not_depend_on_order(spark):
    df = spark.range(10_000).selectExpr("CAST(id % 977 AS DOUBLE) / 100 AS v")
    sums = {df.repartition(n).agg(exact_sum(F.col("v"))).first()[0] for n in (1, 3, 8)}
    assert len(sums) == 1


def test_conform_fails_on_a_missing_column(few):
    with pytest.raises(ValueError, match="missing"):
        conform(few)
    with pytest.raises(ValueError, match="outside"):
        conform(few, {"nothing": "v"})


def test_conform_can_refuse_nulls(spark):
    df = spark.createDataFrame([(1, 1, None, 0, "m", 1)],
                               "account long, step int, amount double, isFraud int, merchant string, seq long")
    assert conform(df).count() == 1
    with pytest.raises(Exception, match="null in amount"):
        conform(df, strict_nulls=True).collect()


def test_step_ignores_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:30:00' AS ts")
    expected = df.select(step_of(F.col("ts"))).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert df.select(step_of(F.col("ts"))).first()[0] == expected == 475_514
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
