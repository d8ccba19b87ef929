"""Queries that run as streams over the given tables, to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.operators.compare import feature_fingerprint, same_fingerprint
from pacewise.operators.ordering import range_bounds
from pacewise.operators.training import LogisticModel, fit
from pacewise.operators.sampling import sampled_features
from pacewise.operators.velocity import FEATURES, WINDOW_STEPS, features
from pacewise.plans.models import FIXED, GD_EPOCHS, GD_RATE, SAMPLE_SQL, SCORED, score_sql
from pacewise.plans.registry import TXN, event_rows, features_sql, query, table
from pacewise.plans.windows import VELOCITY_SQL, rounded
from pacewise.session import shared_dir
from pacewise.sources.landing import live_transactions
from pacewise.streaming.batchlog import BATCH
from pacewise.streaming.flow import flow_log, latest_per_interval, max_backlog, shedding, watched
from pacewise.streaming.folds import RunningSample, RunningStats
from pacewise.streaming.keyed import keyed_features
from pacewise.streaming.live import LiveFeatures

SLICES = 3


def land_and_run(spark: SparkSession, rows: DataFrame, root: str,
                 run: Callable[[DataFrame], object], slices: int = SLICES) -> None:
    """Land rows in step order, one slice after the other, and run the stream after each.

    Every run resumes from the checkpoint of the one before.
    """
    edges = [None, *range_bounds(rows, "step", slices), None]
    for low, high in zip(edges, edges[1:]):
        part = rows
        if low is not None:
            part = part.where(F.col("step") >= low)
        if high is not None:
            part = part.where(F.col("step") < high)
        part.write.mode("append").parquet(f"{root}/landed")
        run(live_transactions(spark, f"{root}/landed")).awaitTermination()


def _live(spark: SparkSession, sf: str, model: LogisticModel | None = None) -> DataFrame:
    root = shared_dir(spark, "live-features")
    live = LiveFeatures(spark, root, model=model)
    land_and_run(spark, event_rows(spark, sf), root, lambda s: live.start(s, f"{root}/checkpoint"))
    return live.output.read()


@query("stream_velocity_features", VELOCITY_SQL)
def stream_velocity_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_live(spark, sf))


@query("stream_velocity_keyed_state", VELOCITY_SQL)
def stream_velocity_keyed_state(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_dir(spark, "keyed-features")

    def run(stream):
        return (keyed_features(stream).writeStream.format("parquet")
                .option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True).start(f"{root}/features"))

    land_and_run(spark, event_rows(spark, sf), root, run, slices=2)
    return rounded(spark.read.parquet(f"{root}/features"))


@query("stream_equals_table", "SELECT count(*) AS rows_a, count(*) AS rows_b, true AS identical FROM events")
def stream_equals_table(spark: SparkSession, sf: str) -> DataFrame:
    return same_fingerprint(feature_fingerprint(features(event_rows(spark, sf))),
                            feature_fingerprint(_live(spark, sf)))


@query("live_scoring", f"WITH {SCORED} SELECT seq, round(p, 6) AS p, p > 0.5 AS flagged FROM scored")
def live_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf, FIXED).select("seq", F.round("p", 6).alias("p"), "flagged")


_SCORED_LIVE = score_sql(FEATURES, "feat", "samp", "g").replace("SELECT isFraud AS y,", "SELECT seq,")


@query("train_then_score_live", f"""WITH RECURSIVE {features_sql()}, {SAMPLE_SQL.format('feat')}, {_SCORED_LIVE}
SELECT seq, round(s, 5) AS p, s > 0.5 AS flagged FROM g_scored""")
def train_then_score_live(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the history, keep the model as a file, load it for the stream."""
    path = shared_dir(spark, "model")
    fit(sampled_features(event_rows(spark, sf)), epochs=GD_EPOCHS, lr=GD_RATE).save(spark, path)
    scored = _live(spark, sf, LogisticModel.load(spark, path))
    return scored.select("seq", F.round("p", 5).alias("p"), "flagged")


@query("stream_running_stats", """SELECT count(value) AS count,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS sum,
  round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events""")
def stream_running_stats(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_dir(spark, "running-stats")
    stats = RunningStats(spark, root)
    land_and_run(spark, event_rows(spark, sf), root, _each_batch(stats, root))
    return stats.result().withColumn("mean", F.round("mean", 6))


@query("stream_sample", f"""WITH {TXN} SELECT seq, account, amount FROM txn
ORDER BY md5('7:' || seq), seq LIMIT 500""")
def stream_sample(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_dir(spark, "running-sample")
    sample = RunningSample(spark, root, k=500)
    land_and_run(spark, event_rows(spark, sf), root, _each_batch(sample, root))
    return sample.result().select("seq", "account", "amount")


def _each_batch(function, root: str):
    return lambda stream: (stream.writeStream.foreachBatch(function)
                           .option("checkpointLocation", f"{root}/checkpoint")
                           .trigger(availableNow=True).start())


LATENESS = 48


def _late_live(spark: SparkSession, sf: str) -> LiveFeatures:
    """Odd rows arrive after all even ones."""
    root = shared_dir(spark, "late-rows")
    live = LiveFeatures(spark, root, lateness=LATENESS)
    rows = event_rows(spark, sf)
    for parity in (0, 1):
        rows.where(F.col("seq") % 2 == parity).write.mode("append").parquet(f"{root}/landed")
        live.start(live_transactions(spark, f"{root}/landed"), f"{root}/checkpoint").awaitTermination()
    return live


# Rows that were taken, and the step before which nothing is needed any more.
_TAKEN = f"""{TXN}, taken AS (
  SELECT * FROM txn WHERE seq % 2 = 0 OR step >= (SELECT max(step) FROM txn WHERE seq % 2 = 0) - {LATENESS}),
bound AS (SELECT max(step) - {LATENESS} - {WINDOW_STEPS} AS bound FROM taken)"""


@query("stream_late_rows", f"""WITH {TXN} SELECT seq, account, step, amount FROM txn
WHERE seq % 2 = 1 AND step < (SELECT max(step) FROM txn WHERE seq % 2 = 0) - {LATENESS}""")
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Those too far behind are kept apart."""
    return _late_live(spark, sf).late.read().select("seq", "account", "step", "amount")


@query("stream_evicted_steps", f"""WITH {_TAKEN} SELECT account, step, count(*) AS n,
  CAST(sum(units) AS BIGINT) AS units, max(amount) AS peak FROM taken, bound WHERE step < bound GROUP BY account, step""")
def stream_evicted_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Partials that left the state: every step that no later row can reach, each once."""
    live = _late_live(spark, sf)
    live.settle()
    return live.evicted.read().drop(BATCH)


@query("stream_progress", f"""WITH {_TAKEN}, steps AS (SELECT DISTINCT account, step FROM taken)
SELECT (SELECT count(*) FROM txn) AS rows_in, (SELECT count(*) FROM txn) - (SELECT count(*) FROM taken) AS rows_late,
  (SELECT count(*) FROM taken) AS rows_out, count(*) FILTER (step >= bound) AS state_rows,
  count(*) FILTER (step < bound) AS evicted_rows, any_value(bound) + {LATENESS + WINDOW_STEPS} AS newest_step FROM steps, bound""")
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in, late and out of all batches; partials put out, and those held at the end."""
    live = _late_live(spark, sf)
    live.settle()
    # settling is noted under a negative number, the last one under the least
    return live.progress.read().agg(
        F.sum("rows_in").alias("rows_in"), F.sum("rows_late").alias("rows_late"), F.sum("rows_out").alias("rows_out"),
        F.min_by("state_rows", BATCH).alias("state_rows"), F.sum("evicted_rows").alias("evicted_rows"),
        F.max("newest_step").alias("newest_step"))


# --- flow ------------------------------------------------------------------------

_LATEST = """SELECT time_bucket(INTERVAL '2 hours', ts) AS interval_start,
  arg_max(event_id, event_id) AS event_id, arg_max(user_id, event_id) AS user_id,
  arg_max(value, event_id) AS value FROM events GROUP BY 1"""


@query("latest_per_interval", _LATEST)
def latest_event_per_interval(spark: SparkSession, sf: str) -> DataFrame:
    latest = latest_per_interval(table(spark, sf, "events"), "ts", "2 hours", "event_id")
    return latest.select("interval_start", "event_id", "user_id", "value")


@query("stream_latest_per_interval", f"""SELECT * FROM ({_LATEST})
WHERE interval_start + INTERVAL '2 hours' <= (SELECT max(ts) FROM events) - INTERVAL '6 hours'""")
def stream_latest_per_interval(spark: SparkSession, sf: str) -> DataFrame:
    """On a stream an interval is put out once the watermark has passed its end."""
    root = shared_dir(spark, "latest-per-interval")
    table(spark, sf, "events").repartitionByRange(4, "event_id").write.parquet(f"{root}/landed")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{root}/landed")
    latest = latest_per_interval(stream, "ts", "2 hours", "event_id", lateness="6 hours")
    (watched(latest, "kept").writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start(f"{root}/kept").awaitTermination())
    return spark.read.parquet(f"{root}/kept").select(
        F.col("interval_start").cast("timestamp_ntz").alias("interval_start"), "event_id", "user_id", "value")


@query("shedding_account", """SELECT count(*) AS produced, count(DISTINCT epoch_us(ts) // 7200000000) AS consumed,
  count(*) - count(DISTINCT epoch_us(ts) // 7200000000) AS dropped FROM events""")
def shedding_account(spark: SparkSession, sf: str) -> DataFrame:
    return shedding(table(spark, sf, "events"), "ts", "2 hours")


@query("max_backlog", """WITH log AS (
  SELECT event_type AS feed, epoch_us(ts) // 1000000 AS t, 1 AS up, 0 AS down FROM events
  UNION ALL SELECT event_type, epoch_us(ts) // 1000000 + CAST(round(value * 100) AS BIGINT), 0, 1 FROM events),
m AS (SELECT feed, t, sum(up) AS up, sum(down) AS down FROM log GROUP BY feed, t),
r AS (SELECT feed, up, sum(up - down) OVER (PARTITION BY feed ORDER BY t) + down AS level FROM m)
SELECT feed, CAST(sum(up) AS BIGINT) AS produced, CAST(max(level) AS BIGINT) AS max_backlog FROM r GROUP BY feed""")
def backlog_per_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Events in flight per type, where an event is done after 100 seconds per unit of value."""
    events = table(spark, sf, "events")
    start = F.unix_timestamp("ts")
    return max_backlog(flow_log(events, F.col("event_type"), start,
                                start + F.rint(F.col("value") * 100).cast("long")))
