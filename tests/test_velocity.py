"""The window by hand-made rows, and what must not change it."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pacewise.operators.velocity import FEATURES, features, step_partials

SCHEMA = "seq long, account long, step int, amount double"

# (seq, account, step, amount) -> count, sum, mean, max, ratio
CASES = [
    ((1, 1, 10, 100.0), (0, 0.0, 0.0, 0.0, 1.0)),
    ((2, 1, 12, 50.0), (1, 100.0, 100.0, 100.0, 0.5)),
    ((3, 1, 12, 150.0), (2, 150.0, 75.0, 100.0, 2.0)),
    ((4, 1, 34, 30.0), (3, 300.0, 100.0, 150.0, 0.3)),
    ((5, 1, 35, 60.0), (3, 230.0, 230 / 3, 150.0, 60 / (230 / 3))),
    ((6, 2, 35, 10.0), (0, 0.0, 0.0, 0.0, 1.0)),
    ((7, 3, 1, 0.0), (0, 0.0, 0.0, 0.0, 1.0)),
    ((8, 3, 2, 5.0), (1, 0.0, 0.0, 0.0, 1.0)),
    ((9, 4, 1, 5.0), (0, 0.0, 0.0, 0.0, 1.0)),
    ((10, 4, 90, 5.0), (0, 0.0, 0.0, 0.0, 1.0)),
]
HOT = (None, 1_000_000, 1, 2)


def by_hand(rows, window):
    out = {}
    for seq, account, step, amount in rows:
        past = [round(r[3] * 100) for r in rows
                if r[1] == account and r[2] >= step - window
                and (r[2] < step or (r[2] == step and r[0] < seq))]
        out[seq] = (len(past), sum(past), max(past, default=0))
    return out


def computed(df):
    return {r.seq: (r.velocity_count, round(r.window_sum * 100), round(r.window_max * 100))
            for r in df.collect()}


@pytest.mark.parametrize("hot_rows", HOT)
def test_known_answers(spark, hot_rows):
    df = features(spark.createDataFrame([c[0] for c in CASES], SCHEMA), hot_rows=hot_rows)
    found = {r.seq: tuple(r[f] for f in FEATURES) for r in df.collect()}
    for row, expected in CASES:
        assert found[row[0]] == pytest.approx(expected, rel=1e-12), row


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 60), st.integers(0, 50_000)),
                min_size=1, max_size=60), st.integers(1, 30), st.sampled_from([None, 1, 3, 10]))
def test_against_brute_force(spark, drawn, window, hot_rows):
    rows = [(i, a, s, c / 100) for i, (a, s, c) in enumerate(drawn)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert computed(features(df, window, hot_rows=hot_rows)) == by_hand(rows, window)


def test_negative_steps(spark):
    rows = [(1, 1, -40, 1.0), (2, 1, -20, 2.0), (3, 1, 3, 4.0), (4, 1, 4, 8.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot_rows in HOT:
        assert computed(features(df, 24, hot_rows=hot_rows)) == by_hand(rows, 24)


def test_row_order_and_partitioning_do_not_matter(rows):
    plain = features(rows)
    mixed = features(rows.orderBy(F.md5(F.col("seq").cast("string"))).repartition(5))
    assert plain.exceptAll(mixed).isEmpty() and mixed.exceptAll(plain).isEmpty()


@pytest.mark.parametrize("hot_rows", HOT)
def test_history_stands_for_earlier_rows(rows, hot_rows):
    edge = rows.agg(F.percentile_approx("seq", 0.5)).first()[0]
    late = features(rows.where(F.col("seq") > edge), history=step_partials(
        rows.where(F.col("seq") <= edge)), hot_rows=hot_rows)
    whole = features(rows).where(F.col("seq") > edge).select(*late.columns)
    assert late.exceptAll(whole).isEmpty() and whole.exceptAll(late).isEmpty()


def test_one_exchange_one_sort(rows):
    plan = features(rows, hot_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort") == 1


def test_hot_groups_are_bounded(spark):
    """An account with all rows is cut: no window is partitioned by the account alone."""
    rows = spark.range(20_000).selectExpr("id AS seq", "7L AS account", "CAST(id DIV 5000 AS INT) AS step",
                                          "CAST(id % 100 AS DOUBLE) AS amount")
    hot = features(rows, hot_rows=640)
    plain = features(rows, hot_rows=None)
    assert hot.exceptAll(plain).isEmpty() and hot.count() == 20_000


def test_window_must_be_positive(rows):
    with pytest.raises(ValueError):
        features(rows, 0)


def test_names_used_inside_are_refused(rows):
    with pytest.raises(ValueError, match="cut"):
        features(rows.withColumn("cut", F.lit(1)))
