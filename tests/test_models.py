import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from pacewise.operators.auc import area_under_roc
from pacewise.operators.training import LogisticModel, auc_lift, fit, fit_converged, standardizer_table


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "p double, isFraud int")


def test_auc_of_distinct_scores(spark):
    df = labelled(spark, [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)])
    assert tuple(area_under_roc(df).first()) == (2, 2, 0.75)


def test_auc_needs_two_classes(spark):
    assert math.isnan(area_under_roc(labelled(spark, [(0.1, 1), (0.2, 1)])).first().auc)
    assert math.isnan(area_under_roc(labelled(spark, []).where("p > 1")).first().auc)


def test_auc_with_ties_equals_the_evaluator(spark):
    rng = np.random.default_rng(3)
    pairs = [(float(round(s, 1)), int(y)) for s, y in zip(rng.random(800), rng.random(800) < 0.3)]
    df = labelled(spark, pairs)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="isFraud", numBins=0)
    assert area_under_roc(df).first().auc == pytest.approx(evaluator.evaluate(df), abs=1e-12)
    assert area_under_roc(df.repartition(7)).first().auc == area_under_roc(df).first().auc


def test_constant_column_has_the_smallest_deviation(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    assert tuple(standardizer_table(df, ["x"]).first()) == (5.0, 1e-9)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 2)) * [3.0, 0.5] + [10.0, -2.0]
    y = rng.random(1500) < 1 / (1 + np.exp(-(0.9 * (x[:, 0] - 10) / 3 - 1.4 * (x[:, 1] + 2) / 0.5 - 0.5)))
    return spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)],
                                 "a double, b double, isFraud int").repartition(4)


def test_descent_equals_the_plain_loop(sample):
    model = fit(sample, ["a", "b"], epochs=12, lr=0.3)
    rows = np.array([tuple(r) for r in sample.collect()])
    x, y = rows[:, :2], rows[:, 2]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w, b = np.zeros(2), 0.0
    for _ in range(12):
        error = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.3 * z.T @ error / len(y), b - 0.3 * error.mean()
    assert model.weights == pytest.approx(tuple(w), abs=1e-10)
    assert model.bias == pytest.approx(b, abs=1e-10)


def test_converged_fit_learns(sample):
    model = fit_converged(sample, ["a", "b"])
    assert model.weights[0] == pytest.approx(0.9, abs=0.25)
    assert model.weights[1] == pytest.approx(-1.4, abs=0.25)
    assert area_under_roc(model.score(sample)).first().auc > 0.75


def test_model_survives_saving(spark, sample, tmp_path):
    model = fit_converged(sample, ["a", "b"])
    model.save(spark, str(tmp_path / "model"))
    assert LogisticModel.load(spark, str(tmp_path / "model")) == model


def test_lift_verdicts(sample):
    row = auc_lift(sample, ["a"], ["a", "b"]).first()
    assert row.verdict == "lifts" and row.lift == pytest.approx(row.auc_extended - row.auc_base)
    same = auc_lift(sample, ["a", "b"], ["b", "a"]).first()
    assert same.verdict == "tied"


def test_score_is_strictly_above_the_threshold(spark):
    model = LogisticModel(("x",), (0.0,), (1.0,), (1.0,), 0.0)
    scored = model.score(spark.createDataFrame([(0.0,), (1.0,)], "x double"))
    assert [r.f for r in scored.select((F.col("p") > 0.5).alias("f")).collect()] == [False, True]


def test_no_rows_to_fit(sample):
    with pytest.raises(ValueError, match="no training rows"):
        fit(sample.where("a > 1e9"), ["a", "b"])


def test_lift_over_the_history(sample):
    part = sample.where("a < 10").persist()
    row = auc_lift(part, ["a"], ["a", "b"], history=sample).first()
    for names, whole, inside in ((["a"], row.auc_base, row.auc_base_in_sample), (["a", "b"], row.auc_extended, row.auc_extended_in_sample)):
        model = fit_converged(part, names)
        assert whole == pytest.approx(area_under_roc(model.score(sample)).first().auc)
        assert inside == pytest.approx(area_under_roc(model.score(part)).first().auc)
        assert whole != pytest.approx(inside, abs=1e-4)
    assert row.lift == pytest.approx(row.auc_extended - row.auc_base)
    assert row.lift_in_sample == pytest.approx(row.auc_extended_in_sample - row.auc_base_in_sample)
