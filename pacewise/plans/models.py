"""Samples, standardizer, fit, scores, AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.operators.aggregates import scored_summary
from pacewise.operators.auc import area_under_roc
from pacewise.operators.sampling import SAMPLE_CAP, bottom_k, sampled_features
from pacewise.operators.text import fuse
from pacewise.operators.training import (LogisticModel, Standardizer, auc_lift, backfill_auc, fit, fit_converged,
                                         in_sample_auc, standardizer_table)
from pacewise.operators.velocity import FEATURES, features
from pacewise.plans.registry import TXN, event_rows, features_sql, query, table
from pacewise.plans.texts import TYPE_SCORES, type_scores
from pacewise.session import reliable

# A model with given numbers, so that scoring can be checked by itself.
FIXED = LogisticModel(
    names=FEATURES,
    mean=(2.0, 100.0, 40.0, 80.0, 1.5), std=(1.5, 90.0, 35.0, 60.0, 2.0),
    weights=(0.4, -0.3, 0.25, 0.2, 1.1), bias=-1.0)

# Epochs and rate of the fit.
GD_EPOCHS, GD_RATE = 300, 0.2


def logit_sql(model: LogisticModel = FIXED) -> str:
    terms = [f"((CAST({n} AS DOUBLE) - CAST({m} AS DOUBLE)) / CAST({s} AS DOUBLE)) * CAST({w} AS DOUBLE)"
             for n, m, s, w in zip(model.names, model.mean, model.std, model.weights)]
    return f"({' + '.join(terms)} + CAST({model.bias} AS DOUBLE))"


SCORED = f"{features_sql()}, scored AS (SELECT *, 1 / (1 + exp(-{logit_sql()})) AS p FROM feat)"


@query("uniform_sample", f"""WITH {TXN} SELECT seq, account, amount FROM txn
ORDER BY md5('7:' || seq), seq LIMIT 1000""")
def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    return bottom_k(event_rows(spark, sf), 1000).select("seq", "account", "amount")


@query("uniform_sample_below_cap", f"""WITH {TXN} SELECT seq, account, amount FROM txn
ORDER BY md5('7:' || seq), seq LIMIT {SAMPLE_CAP}""")
def uniform_sample_below_cap(spark: SparkSession, sf: str) -> DataFrame:
    return bottom_k(event_rows(spark, sf)).select("seq", "account", "amount")


@query("standardizer_fit", f"WITH {features_sql()} SELECT " + ", ".join(
    f"round(avg({n}), 6) AS mean_{n}, round(greatest(stddev_pop({n}), 1e-9), 6) AS std_{n}"
    for n in FEATURES) + " FROM feat")
def standardizer_fit(spark: SparkSession, sf: str) -> DataFrame:
    found = standardizer_table(features(event_rows(spark, sf)))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("standardizer_apply", f"WITH {features_sql()} SELECT seq, " + ", ".join(
    f"round((CAST({n} AS DOUBLE) - CAST({m} AS DOUBLE)) / CAST({s} AS DOUBLE), 6) AS z_{n}"
    for n, m, s in zip(FIXED.names, FIXED.mean, FIXED.std)) + " FROM feat")
def standardizer_apply(spark: SparkSession, sf: str) -> DataFrame:
    scaled = Standardizer(FIXED.names, FIXED.mean, FIXED.std).apply(features(event_rows(spark, sf)))
    return scaled.select("seq", *[F.round(f"z_{n}", 6).alias(f"z_{n}") for n in FEATURES])


@query("score_table", f"WITH {SCORED} SELECT seq, round(p, 6) AS p, p > 0.5 AS flagged FROM scored")
def score_table(spark: SparkSession, sf: str) -> DataFrame:
    scored = FIXED.score(features(event_rows(spark, sf)))
    return scored.select("seq", F.round("p", 6).alias("p"), (F.col("p") > 0.5).alias("flagged"))


@query("scored_summary", f"""WITH {SCORED} SELECT count(*) AS scored, count(*) FILTER (p > 0.5) AS flagged,
  CAST(round(100.0 * count(*) FILTER (p > 0.5) / count(*), 6) AS DOUBLE) AS percent,
  round(sum(p), 4) AS score_sum FROM scored""")
def scored_report(spark: SparkSession, sf: str) -> DataFrame:
    return scored_summary(FIXED.score(features(event_rows(spark, sf)))).select(
        "scored", "flagged", F.round("percent", 6).alias("percent"), F.round("score_sum", 4).alias("score_sum"))


def auc_ctes(source: str, score: str, label: str, tag: str) -> str:
    """CTE ``<tag>_sums``: class sizes, and the rank sum with the mean rank for equal scores."""
    return f"""{tag}_ranked AS (SELECT {label} AS y, rank() OVER (ORDER BY {score}) +
    (count(*) OVER (PARTITION BY {score}) - 1) / 2 AS r FROM {source}),
{tag}_sums AS (SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg,
  sum(r) FILTER (y = 1) AS rank_sum FROM {tag}_ranked)"""


_AUC = "(rank_sum - pos::DOUBLE * (pos + 1) / 2) / (pos::DOUBLE * neg)"


def auc_value(tag: str) -> str:
    return f"SELECT {_AUC} FROM {tag}_sums"


def auc_sql(source: str, score: str, label: str, decimals: int = 6) -> str:
    return f"""{auc_ctes(source, score, label, 'auc')}
SELECT pos AS positives, neg AS negatives, round({_AUC}, {decimals}) AS auc FROM auc_sums"""


def _rounded_auc(result: DataFrame) -> DataFrame:
    return result.withColumn("auc", F.round("auc", 6))


@query("auc_of_scores", f"WITH {SCORED}, cut AS (SELECT isFraud, round(p, 9) AS s FROM scored), "
       + auc_sql("cut", "s", "isFraud"))
def auc_of_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = FIXED.score(features(event_rows(spark, sf))).withColumn("p", F.round("p", 9))
    return _rounded_auc(area_under_roc(scored))


@query("auc_of_a_column", "WITH cut AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity AS s "
       "FROM lineitem), " + auc_sql("cut", "s", "y"))
def auc_of_a_column(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity")
    return _rounded_auc(area_under_roc(rows, "l_quantity", "y"))


@query("auc_of_documents", """WITH cut AS (SELECT l.toxic AS y, CAST(d.n_chars AS DOUBLE) AS s
FROM documents d JOIN labels l USING (doc_id)), """ + auc_sql("cut", "s", "y"))
def auc_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(
        table(spark, sf, "labels"), "doc_id")
    return _rounded_auc(area_under_roc(rows, "n_chars", "toxic"))


# The training sample; a bound on the rows that fit, never on those that are scored.
SAMPLE_SQL = f"samp AS (SELECT * FROM {{0}} ORDER BY md5('7:' || seq), seq LIMIT {SAMPLE_CAP})"


def gradient_sql(names=FEATURES, epochs: int = GD_EPOCHS, rate: float = GD_RATE,
                 source: str = "samp", tag: str = "d") -> str:
    """Recursive CTEs of gradient descent, one row of weights per epoch; the last is ``<tag>_w``."""
    ids = range(len(names))
    dot = " + ".join(f"z{i} * w{i}" for i in ids)
    return ", ".join([
        f"{tag}_st AS (SELECT " + ", ".join(f"avg({n}) AS m{i}, greatest(stddev_pop({n}), 1e-9) AS d{i}" for i, n in enumerate(names))
        + f" FROM {source})",
        f"{tag}_z AS MATERIALIZED (SELECT " + ", ".join(f"({n} - m{i}) / d{i} AS z{i}" for i, n in enumerate(names))
        + f", CAST(isFraud AS DOUBLE) AS y FROM {source}, {tag}_st)",
        f"{tag}_steps AS (SELECT 0 AS epoch, " + ", ".join(f"CAST(0 AS DOUBLE) AS w{i}" for i in ids) + ", CAST(0 AS DOUBLE) AS b "
        "UNION ALL SELECT epoch + 1, " + ", ".join(f"any_value(w{i}) - {rate}::DOUBLE * avg(err * z{i})" for i in ids)
        + f", any_value(b) - {rate}::DOUBLE * avg(err) FROM (SELECT *, 1 / (1 + exp(-({dot} + b))) - y AS err "
        f"FROM {tag}_z, {tag}_steps WHERE epoch < {epochs}) GROUP BY epoch)",
        f"{tag}_w AS (SELECT * FROM {tag}_steps WHERE epoch = {epochs})"])


_WEIGHTS = [f"w{i}" for i in range(len(FEATURES))] + ["b"]


@query("fit_gradient_descent", f"WITH RECURSIVE {features_sql()}, {SAMPLE_SQL.format('feat')}, {gradient_sql()} SELECT "
       + ", ".join(f"round({w}, 6) AS {w}" for w in _WEIGHTS) + " FROM d_w")
def fit_gradient_descent(spark: SparkSession, sf: str) -> DataFrame:
    model = fit(sampled_features(event_rows(spark, sf)), epochs=GD_EPOCHS, lr=GD_RATE)
    values = [*model.weights, model.bias]
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(n) for n, v in zip(_WEIGHTS, values)])


@query("fit_to_convergence")
def fit_to_convergence(spark: SparkSession, sf: str) -> DataFrame:
    model = fit_converged(_training_rows(spark, sf))
    values = [*model.weights, model.bias]
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(_WEIGHTS, values)])


@query("converged_gradient", "SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS g_{w}" for w in _WEIGHTS)
       + " FROM (SELECT count(*) AS n FROM events) WHERE n > 0")
def converged_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """The gradient of the mean log-loss at the converged fit, to three decimals: zero at the optimum."""
    sample = _training_rows(spark, sf)
    model = fit_converged(sample)
    scaled = Standardizer(model.names, model.mean, model.std).apply(model.score(sample))
    off = F.col("p") - F.col("isFraud")
    parts = [off * F.col(f"z_{n}") for n in model.names] + [off]
    # abs() turns a negative zero into a zero
    return scaled.agg(*[F.abs(F.round(F.avg(g), 3)).alias(f"g_{w}") for g, w in zip(parts, _WEIGHTS)])


def _training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The training sample, kept: a fit and its report read it several times."""
    return reliable(sampled_features(event_rows(spark, sf)))


@query("sampled_features", f"""WITH {features_sql()} SELECT seq, velocity_count, window_sum, window_max
FROM feat ORDER BY md5('7:' || seq), seq LIMIT 800""")
def sampled_feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampled_features(event_rows(spark, sf), 800).select(
        "seq", "velocity_count", "window_sum", "window_max")


def score_sql(names, rows: str, sample: str, tag: str) -> str:
    """CTE ``<tag>_scored (y, s)``: scores of ``rows`` by gradient descent on ``sample``."""
    dot = " + ".join(f"({n} - m{i}) / d{i} * w{i}" for i, n in enumerate(names))
    return (f"{gradient_sql(names, GD_EPOCHS, GD_RATE, sample, tag)}, {tag}_scored AS "
            f"(SELECT isFraud AS y, 1 / (1 + exp(-({dot} + b))) AS s FROM {rows}, {tag}_st, {tag}_w)")


def _descent(sample: DataFrame, names=FEATURES, label: str = "isFraud") -> LogisticModel:
    return fit(sample, names, label, epochs=GD_EPOCHS, lr=GD_RATE)


_BACKFILL_SQL = f"""WITH RECURSIVE {features_sql()}, {SAMPLE_SQL.format('feat')}, {score_sql(FEATURES, 'feat', 'samp', 'g')},
inside AS (SELECT s, y FROM (SELECT isFraud AS y, seq, 1 / (1 + exp(-({" + ".join(
    f"({n} - m{i}) / d{i} * w{i}" for i, n in enumerate(FEATURES))} + b))) AS s FROM samp, g_st, g_w)),
{auc_ctes('g_scored', 's', 'y', 'all')}, {auc_ctes('inside', 's', 'y', 'in')}
SELECT (SELECT pos FROM all_sums) AS positives, (SELECT neg FROM all_sums) AS negatives,
  round(({auc_value('all')}), 4) AS auc, round(({auc_value('in')}), 4) AS auc_in_sample"""


@query("backfill_train_auc", _BACKFILL_SQL)
def backfill_train_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Features, fit on the sample, scores and AUC over the whole history."""
    history, sample = features(event_rows(spark, sf)), _training_rows(spark, sf)
    found = backfill_auc(_descent(sample), history, sample)
    return found.withColumns({c: F.round(c, 4) for c in ("auc", "auc_in_sample")})


@query("backfill_converged_auc")
def backfill_converged_auc(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the converged fit."""
    sample = _training_rows(spark, sf)
    return backfill_auc(fit_converged(sample), features(event_rows(spark, sf)), sample)


@query("backfill_descent_auc", f"""WITH RECURSIVE {features_sql()}, {SAMPLE_SQL.format('feat')},
{score_sql(FEATURES, 'samp', 'samp', 'g')}, """ + auc_sql("g_scored", "s", "y", 4))
def backfill_descent_auc(spark: SparkSession, sf: str) -> DataFrame:
    """The AUC on the rows of the fit."""
    sample = _training_rows(spark, sf)
    return in_sample_auc(_descent(sample), sample).withColumn("auc", F.round("auc", 4))


def _fused_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sample with the best similarity of the event type to a part name."""
    return reliable(fuse(_training_rows(spark, sf), "merchant", type_scores(spark, sf)))


def _fused_history(spark: SparkSession, sf: str) -> DataFrame:
    """All rows with their features and that similarity, kept: two models score them."""
    return reliable(fuse(features(event_rows(spark, sf)), "merchant", type_scores(spark, sf)))


EXTENDED = (*FEATURES, "text_similarity")


@query("auc_lift_of_text")
def auc_lift_of_text(spark: SparkSession, sf: str) -> DataFrame:
    """AUC over the whole history with and without the text feature, both fits converged; in-sample figures beside it."""
    return auc_lift(_fused_sample(spark, sf), FEATURES, EXTENDED, history=_fused_history(spark, sf))


@query("auc_lift_of_text_descent", f"""WITH RECURSIVE {features_sql()}, {SAMPLE_SQL.format('feat')}, {TYPE_SCORES},
fused AS (SELECT samp.*, best.score AS text_similarity FROM samp JOIN best ON best.text = samp.merchant),
{score_sql(FEATURES, 'fused', 'fused', 'g')}, {score_sql(EXTENDED, 'fused', 'fused', 'h')},
{auc_ctes('g_scored', 's', 'y', 'ga')}, {auc_ctes('h_scored', 's', 'y', 'ha')},
both_auc AS (SELECT ({auc_value('ga')}) AS a, ({auc_value('ha')}) AS b)
SELECT round(a, 4) AS auc_base, round(b, 4) AS auc_extended, round(b - a, 4) AS lift,
  CASE WHEN b - a > 0.0005 THEN 'lifts' WHEN b - a < -0.0005 THEN 'does not lift' ELSE 'tied' END AS verdict
FROM both_auc""")
def auc_lift_of_text_descent(spark: SparkSession, sf: str) -> DataFrame:
    """The lift on the rows of the fit; ``auc_lift_of_text_history`` has it over all rows."""
    found = auc_lift(_fused_sample(spark, sf), FEATURES, EXTENDED, fitter=_descent)
    return found.select(*[F.round(c, 4).alias(c) for c in ("auc_base", "auc_extended", "lift")], "verdict")


def _verdict_sql(lift: str) -> str:
    return f"CASE WHEN {lift} > 0.0005 THEN 'lifts' WHEN {lift} < -0.0005 THEN 'does not lift' ELSE 'tied' END"


def _scores_sql(names, rows: str, tag: str, name: str) -> str:
    """CTE ``<name> (y, s)``: scores of ``rows`` by the weights that ``gradient_sql`` left under ``tag``."""
    dot = " + ".join(f"({n} - m{i}) / d{i} * w{i}" for i, n in enumerate(names))
    return f"{name} AS (SELECT isFraud AS y, 1 / (1 + exp(-({dot} + b))) AS s FROM {rows}, {tag}_st, {tag}_w)"


@query("auc_lift_of_text_history", f"""WITH RECURSIVE {features_sql()}, {SAMPLE_SQL.format('feat')}, {TYPE_SCORES},
fused AS (SELECT samp.*, best.score AS text_similarity FROM samp JOIN best ON best.text = samp.merchant),
fused_all AS (SELECT feat.*, best.score AS text_similarity FROM feat JOIN best ON best.text = feat.merchant),
{score_sql(FEATURES, 'fused', 'fused', 'g')}, {score_sql(EXTENDED, 'fused', 'fused', 'h')},
{_scores_sql(FEATURES, 'fused_all', 'g', 'g_all')}, {_scores_sql(EXTENDED, 'fused_all', 'h', 'h_all')},
{auc_ctes('g_scored', 's', 'y', 'ga')}, {auc_ctes('h_scored', 's', 'y', 'ha')},
{auc_ctes('g_all', 's', 'y', 'gw')}, {auc_ctes('h_all', 's', 'y', 'hw')},
aucs AS (SELECT ({auc_value('gw')}) AS a, ({auc_value('hw')}) AS b, ({auc_value('ga')}) AS c, ({auc_value('ha')}) AS d)
SELECT round(a, 4) AS auc_base, round(b, 4) AS auc_extended, round(b - a, 4) AS lift, {_verdict_sql('b - a')} AS verdict,
  round(c, 4) AS auc_base_in_sample, round(d, 4) AS auc_extended_in_sample, round(d - c, 4) AS lift_in_sample,
  {_verdict_sql('d - c')} AS verdict_in_sample
FROM aucs""")
def auc_lift_of_text_history(spark: SparkSession, sf: str) -> DataFrame:
    """The lift over the whole history by descent on the sample, with the in-sample figures beside it."""
    found = auc_lift(_fused_sample(spark, sf), FEATURES, EXTENDED, fitter=_descent, history=_fused_history(spark, sf))
    return found.select(*[c if c.startswith("verdict") else F.round(c, 4).alias(c) for c in found.columns])
