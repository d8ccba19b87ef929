"""Standardizer, logistic fit, scoring, and the lift of one feature set over another."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.functions.scoring import linear, sigmoid, standardized
from pacewise.operators.auc import area_under_roc
from pacewise.operators.velocity import FEATURES

STD_FLOOR = 1e-9


@dataclass(frozen=True)
class Standardizer:
    """Mean and population deviation per feature."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def columns(self) -> list[Column]:
        return [standardized(F.col(n), m, s) for n, m, s in zip(self.names, self.mean, self.std)]

    def apply(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.withColumns({f"{prefix}{n}": c for n, c in zip(self.names, self.columns())})


@dataclass(frozen=True)
class LogisticModel:
    """A fitted model: a handful of numbers, applied as column expressions."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def probability(self) -> Column:
        scale = Standardizer(self.names, self.mean, self.std)
        return sigmoid(linear(scale.columns(), self.weights, self.bias))

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        return df.withColumn(name, self.probability())

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the parameters as one JSON line, for a stream to load."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogisticModel:
        raw = json.loads(spark.read.text(path).first()[0])
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def standardizer_table(df: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """One row ``mean_x, std_x`` per feature ``x``."""
    columns = []
    for name in names:
        value = F.col(name).cast("double")
        columns += [F.avg(value).alias(f"mean_{name}"),
                    F.greatest(F.stddev_pop(value), F.lit(STD_FLOOR)).alias(f"std_{name}")]
    return df.agg(*columns)


def fit_standardizer(df: DataFrame, names: Sequence[str] = FEATURES) -> Standardizer:
    row = standardizer_table(df, names).first()
    if any(v is None for v in row):
        raise ValueError("no training rows")
    return Standardizer(tuple(names), tuple(row[f"mean_{n}"] for n in names),
                        tuple(row[f"std_{n}"] for n in names))


# A packed sample of up to this measured size is descended in one task; a larger one takes a pass per epoch.
ONE_TASK_BYTES = 32 << 20


def fit(sample: DataFrame, names: Sequence[str] = FEATURES, label: str = "isFraud",
        epochs: int = 300, lr: float = 0.2) -> LogisticModel:
    """Full-batch gradient descent on mean log-loss from zero weights.

    The standardized sample is packed into matrices, one per Arrow batch, and cached. Samples are
    bounded; one of up to ``ONE_TASK_BYTES`` runs all epochs in one task. With more, every epoch is one
    pass over the matrices; tasks return one partial gradient each.
    """
    kept = sample.select(*names, F.col(label).cast("double").alias("y")).persist()
    packed = None
    try:
        scale = fit_standardizer(kept, names)
        scaled = [c.alias(f"z{i}") for i, c in enumerate(scale.columns())]
        packed = kept.select(*scaled, "y").mapInArrow(_pack, "rows long, matrix binary").persist()
        rows = packed.agg(F.sum("rows")).first()[0]
        weights, bias = np.zeros(len(names)), 0.0
        if (rows or 0) * 8 * (len(names) + 1) <= ONE_TASK_BYTES:
            found = packed.select("matrix").coalesce(1).mapInArrow(_descent(len(names), epochs, lr), "w array<double>").first().w
            weights, bias = np.array(found[:-1]), found[-1]
        else:
            for _ in range(epochs):
                partial = packed.select("matrix").mapInArrow(_gradient(weights, bias), "g array<double>")
                gradient = np.sum([r.g for r in partial.collect()], axis=0) / rows
                weights = weights - lr * gradient[:-1]
                bias = bias - lr * gradient[-1]
    finally:
        kept.unpersist()
        if packed is not None:
            packed.unpersist()
    return LogisticModel(scale.names, scale.mean, scale.std,
                         tuple(float(w) for w in weights), float(bias))


def _pack(batches):
    """Each batch as one row: the bytes of its matrix, the label in the last column."""
    for batch in batches:
        matrix = np.column_stack([c.to_numpy() for c in batch.columns])
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(matrix)]), pa.array([matrix.tobytes()], pa.binary())], names=["rows", "matrix"])


def _descent(features: int, epochs: int, lr: float):
    """All epochs over the matrices of one task; the weights, the bias last."""
    def run(batches):
        matrices = [np.frombuffer(cell.as_buffer(), dtype=np.float64).reshape(-1, features + 1)
                    for batch in batches for cell in batch.column(0)]
        matrix = np.concatenate(matrices) if matrices else np.zeros((0, features + 1))
        z, y = np.column_stack([matrix[:, :-1], np.ones(len(matrix))]), matrix[:, -1]
        weights = np.zeros(features + 1)
        for _ in range(epochs):
            error = 1.0 / (1.0 + np.exp(-(z @ weights))) - y
            weights = weights - lr * (error @ z) / len(z)
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.list_(pa.float64()))], names=["w"])
    return run


def _gradient(weights: np.ndarray, bias: float):
    width = len(weights) + 1

    def partial(batches):
        total = np.zeros(width)
        for batch in batches:
            for cell in batch.column(0):
                matrix = np.frombuffer(cell.as_buffer(), dtype=np.float64).reshape(-1, width)
                z, y = matrix[:, :-1], matrix[:, -1]
                error = 1.0 / (1.0 + np.exp(-(z @ weights + bias))) - y
                total[:-1] += error @ z
                total[-1] += error.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["g"])
    return partial


def fit_converged(sample: DataFrame, names: Sequence[str] = FEATURES, label: str = "isFraud",
                  max_iter: int = 100) -> LogisticModel:
    """The maximum-likelihood weights, by Spark's own solver on standardized features."""
    rows = sample.select(*names, F.col(label).cast("double").alias("label")).persist()
    try:
        scale = fit_standardizer(rows, names)
        z = [f"z_{n}" for n in names]
        vectors = VectorAssembler(inputCols=z, outputCol="features").transform(
            scale.apply(rows).select(*z, "label"))
        solved = LogisticRegression(regParam=0.0, standardization=False, maxIter=max_iter).fit(vectors)
    finally:
        rows.unpersist()
    return LogisticModel(scale.names, scale.mean, scale.std,
                         tuple(float(w) for w in solved.coefficients), float(solved.intercept))


def in_sample_auc(model: LogisticModel, sample: DataFrame, label: str = "isFraud") -> DataFrame:
    """AUC on the rows the model was fitted on; there is no hold-out."""
    return area_under_roc(model.score(sample), "p", label)


def backfill_auc(model: LogisticModel, history: DataFrame, sample: DataFrame, label: str = "isFraud") -> DataFrame:
    """``(positives, negatives, auc)`` over all rows of the history, with ``auc_in_sample`` beside it."""
    inside = in_sample_auc(model, sample, label).select(F.col("auc").alias("auc_in_sample"))
    return area_under_roc(model.score(history), "p", label).join(F.broadcast(inside))  # one row each


# The band within which two figures count as equal, and the three verdicts below.
LIFT_BAND = 0.0005


def _lift(models: dict[str, LogisticModel], rows: DataFrame, label: str, tail: str = "") -> DataFrame:
    """One row ``auc_base, auc_extended, lift, verdict`` over ``rows``; ``tail`` ends the names."""
    parts = [area_under_roc(model.score(rows), "p", label).select(F.lit(side).alias("side"), "auc") for side, model in models.items()]
    both = parts[0].unionByName(parts[1]).agg(
        F.max(F.when(F.col("side") == "base", F.col("auc"))).alias("auc_base"),
        F.max(F.when(F.col("side") == "extended", F.col("auc"))).alias("auc_extended"))
    lift = F.col("auc_extended") - F.col("auc_base")
    verdict = (F.when(lift > LIFT_BAND, "lifts").when(lift < -LIFT_BAND, "does not lift")
               .otherwise("tied"))
    return both.select(F.col("auc_base").alias(f"auc_base{tail}"), F.col("auc_extended").alias(f"auc_extended{tail}"),
                       lift.alias(f"lift{tail}"), verdict.alias(f"verdict{tail}"))


def auc_lift(sample: DataFrame, base: Sequence[str], extended: Sequence[str], label: str = "isFraud",
             fitter=fit_converged, history: DataFrame | None = None) -> DataFrame:
    """One row ``auc_base, auc_extended, lift, verdict`` for two fits on one sample.

    With a ``history`` these are over all its rows, and those over the sample stand beside them, with
    ``_in_sample`` after the name; without one they are over the sample.
    """
    models = {"base": fitter(sample, base, label), "extended": fitter(sample, extended, label)}
    if history is None:
        return _lift(models, sample, label)
    return _lift(models, history, label).join(F.broadcast(_lift(models, sample, label, "_in_sample")))  # one row each
