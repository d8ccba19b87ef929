import pytest
from pyspark.sql import functions as F

from pacewise.operators.partials import finish, partials
from pacewise.operators.velocity import features
from pacewise.plans.models import FIXED
from pacewise.streaming.flow import flow_log, latest_per_interval, max_backlog, shedding, watched
from pacewise.streaming.folds import RunningSample, RunningStats
from pacewise.streaming.keyed import keyed_features, range_max
from pacewise.streaming.live import LiveFeatures

ROW = "account long, step int, amount double, isFraud byte, merchant string, seq long"


def made(spark, items):
    """Rows (seq, account, step, amount)."""
    return spark.createDataFrame([(a, s, m, 0, "m", q) for q, a, s, m in items], ROW)


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture
def thirds(rows):
    low, high = rows.agg(F.percentile_approx("step", [0.33, 0.66])).first()[0]
    return [rows.where(F.col("step") <= low), rows.where((F.col("step") > low) & (F.col("step") <= high)),
            rows.where(F.col("step") > high)]


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_batches_give_what_the_table_gives(spark, rows, thirds, tmp_path, hot_rows):
    live = LiveFeatures(spark, str(tmp_path), hot_rows=hot_rows)
    for i, part in enumerate(thirds):
        live(part, i)
    assert same(features(rows), live.output.read().drop("batch_id"))


def test_a_batch_can_run_again(spark, rows, thirds, tmp_path):
    """After a failure the last batch repeats; nothing is counted twice."""
    live = LiveFeatures(spark, str(tmp_path))
    for i in (0, 1, 1, 2, 2):
        LiveFeatures(spark, str(tmp_path))(thirds[i], i)
    assert same(features(rows), live.output.read().drop("batch_id"))


def test_rows_of_one_step_in_two_batches(spark, tmp_path):
    items = [(1, 1, 10, 5.0), (2, 1, 10, 7.0), (3, 1, 10, 9.0), (4, 1, 11, 2.0)]
    live = LiveFeatures(spark, str(tmp_path))
    live(made(spark, items[:2]), 0)
    live(made(spark, items[2:]), 1)
    assert same(features(made(spark, items)), live.output.read().drop("batch_id"))


def test_late_rows_are_kept_apart_and_counted(spark, tmp_path):
    live = LiveFeatures(spark, str(tmp_path), lateness=5)
    live(made(spark, [(1, 1, 100, 5.0)]), 0)
    live(made(spark, [(2, 1, 96, 7.0), (3, 1, 94, 9.0), (4, 1, 101, 2.0)]), 1)
    assert [r.seq for r in live.late.read().collect()] == [3]
    found = {r.seq: r.velocity_count for r in live.output.read().collect()}
    assert found == {1: 0, 2: 0, 4: 2}


@pytest.mark.parametrize("lateness, oldest", [(0, 8), (None, 6)])
def test_old_partials_are_evicted(spark, tmp_path, lateness, oldest):
    """No lateness, and the default of one window."""
    live = LiveFeatures(spark, str(tmp_path), window=3, lateness=lateness)
    items = [(i, i % 2, i * 2, 1.0) for i in range(8)]
    for i, item in enumerate(items):
        live(made(spark, [item]), i)
    assert {r.step for r in live.history.read().collect()} <= set(range(oldest, 15, 2))
    assert same(features(made(spark, items), 3), live.output.read().drop("batch_id"))


def test_a_batch_without_rows(spark, rows, tmp_path):
    live = LiveFeatures(spark, str(tmp_path))
    live(rows.where("seq < 0"), 0)
    live(rows, 1)
    live(rows.where("seq < 0"), 2)
    assert live.output.read().count() == rows.count()


def test_scores_are_those_of_the_table(spark, rows, thirds, tmp_path):
    live = LiveFeatures(spark, str(tmp_path), model=FIXED)
    for i, part in enumerate(thirds):
        live(part, i)
    table = FIXED.score(features(rows)).withColumn("flagged", F.col("p") > 0.5)
    assert same(table, live.output.read().drop("batch_id"))


def run_keyed(spark, parts, root, **options):
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        (keyed_features(stream, **options).writeStream.format("parquet")
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
         .start(f"{root}/out").awaitTermination())
    return spark.read.parquet(f"{root}/out")


def test_keyed_state_gives_what_the_table_gives(spark, rows, thirds, tmp_path):
    found = run_keyed(spark, thirds, tmp_path)
    assert same(features(rows).select(*found.columns), found)


def test_keyed_state_with_ties_and_gaps(spark, tmp_path):
    items = [(1, 1, 10, 5.0), (2, 1, 10, 7.0), (3, 1, 10, 9.0), (4, 1, 11, 2.0), (5, 2, 11, 1.0),
             (6, 1, 34, 3.0), (7, 1, 35, 4.0), (8, 1, 90, 4.0)]
    parts = [made(spark, items[:2]), made(spark, items[2:5]), made(spark, items[5:])]
    found = run_keyed(spark, parts, tmp_path)
    assert same(features(made(spark, items)).select(*found.columns), found)


def test_keyed_state_feeds_the_scorer(spark, rows, thirds, tmp_path):
    """Label, merchant and further columns pass through, so the stream is scored as the table is."""
    found = run_keyed(spark, [t.withColumn("extra", F.col("seq") * 2) for t in thirds], tmp_path)
    assert set(rows.columns) | {"extra"} <= set(found.columns)
    assert same(FIXED.score(features(rows.withColumn("extra", F.col("seq") * 2))), FIXED.score(found))
    with pytest.raises(ValueError):
        keyed_features(rows.withColumn("w_n", F.lit(1)))


def test_keyed_state_by_bucket(spark, tmp_path):
    """Calls and held state do not grow with the accounts; buckets mix accounts that go on, come new, idle and have no number."""
    items = [(i, i % 300, 10 + i // 100 + (40 if i > 900 and i % 300 < 100 else 0), float(i % 13)) for i in range(1200)]
    rows = made(spark, items).withColumn("account", F.expr("nullif(account, 7)"))
    parts = [rows.where("seq < 500"), rows.where("seq between 500 and 900"), rows.where("seq > 900")]
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = keyed_features(spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in"), buckets=5, lateness=100)
        query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
                 .start(f"{tmp_path}/out"))
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6
    found = spark.read.parquet(f"{tmp_path}/out")
    # those without a number are one account
    table = features(rows.withColumn("account", F.coalesce("account", F.lit(-5)))).withColumn("account", F.expr("nullif(account, -5)"))
    assert same(table.select(*found.columns), found) and found.count() == len(items)


def test_range_max():
    import numpy as np

    rng = np.random.default_rng(4)
    values = rng.normal(size=300)
    first = np.sort(rng.integers(0, 300, 300))
    end = np.minimum(first + rng.integers(0, 90, 300), 300)
    want = [values[a:b].max() if b > a else np.nan for a, b in zip(first, end)]
    assert np.array_equal(range_max(values, first, end), want, equal_nan=True)


def test_stats_follow_the_stream(spark, rows, thirds, tmp_path):
    stats = RunningStats(spark, str(tmp_path))
    for i, part in enumerate([*thirds, rows.where("seq < 0")]):
        stats(part, i)
        stats(part, i)
    assert stats.result().first() == finish(partials(rows, "amount")).first()


def test_sample_follows_the_stream(spark, rows, thirds, tmp_path):
    from pacewise.operators.sampling import bottom_k

    sample = RunningSample(spark, str(tmp_path), k=50)
    for i in (0, 1, 1, 2):
        sample(thirds[i], i)
    assert same(bottom_k(rows, 50), sample.result())


def test_latest_on_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = (watched(latest_per_interval(stream, "ts", "1 hour", "event_id", "3 hours"), "kept")
             .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    table = latest_per_interval(events, "ts", "1 hour", "event_id")
    # The newest intervals stay open until the watermark passes them.
    assert found.exceptAll(table).isEmpty() and 0 <= table.count() - found.count() <= 5
    assert query.lastProgress["observedMetrics"]["kept"] is not None


def test_shedding_adds_up(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = shedding(events, "ts", "6 hours").first()
    assert row.produced == row.consumed + row.dropped == 1000
    assert tuple(shedding(events.where("value < 0"), "ts", "6 hours").first()) == (0, 0, 0)


def backlog_by_hand(items):
    out = {}
    for feed in {f for f, _, _ in items}:
        moments = sorted({t for f, a, b in items if f == feed for t in (a, b)})
        peak = level = 0
        for t in moments:
            up = sum(f == feed and a == t for f, a, _ in items)
            peak = max(peak, level + up)
            level += up - sum(f == feed and b == t for f, _, b in items)
        out[feed] = peak
    return out


def test_backlog(spark):
    import random

    rng = random.Random(4)
    items = [(rng.choice("aaab"), a := rng.randrange(300), a + rng.randrange(40)) for _ in range(400)]
    df = spark.createDataFrame(items, "f string, a long, b long")
    log = flow_log(df, F.col("f"), F.col("a"), F.col("b"))
    for pieces in (2, 9):
        found = {r.feed: r.max_backlog for r in max_backlog(log, pieces).collect()}
        assert found == backlog_by_hand(items)


# --- history -----------------------------------------------------------------------


def test_files_and_runs_stay_few(spark, tmp_path):
    """A batch of one account opens one bucket of logarithmically many runs, however many batches there were."""
    live = LiveFeatures(spark, str(tmp_path), window=3, lateness=0, buckets=8)
    items = [(i, i % 5, i, 1.0) for i in range(24)]
    for i, item in enumerate(items):
        live(made(spark, [item]), i)
    told = {r.batch_id: r for r in live.progress.read().collect()}
    assert max(r.files_read for r in told.values()) <= 4 and max(r.runs for r in told.values()) <= 6
    assert all(r.rows_in == r.rows_out == 1 and r.rows_late == 0 for r in told.values())
    runs = list((tmp_path / "history" / "runs").glob("run=*"))
    assert len(runs) <= 12 and len(list((tmp_path / "history" / "marks").glob("[0-9]*.json"))) <= 2
    assert same(features(made(spark, items), 3), live.output.read().drop("batch_id"))


def test_only_buckets_of_the_batch_are_read(spark, rows, thirds, tmp_path):
    live = LiveFeatures(spark, str(tmp_path), buckets=16)
    for i, part in enumerate(thirds[:2]):
        live(part, i)
    mark = live.history.mark()
    one = rows.limit(1).first().account
    bucket = spark.range(1).select(live.history.bucket_of(F.lit(one).cast("long"))).first()[0]
    past = live.history.past(mark, [bucket], -10**6)
    assert past.inputFiles() and all(f"bucket={bucket}/" in f for f in past.inputFiles())
    assert len(past.inputFiles()) < len(live.history.past(mark, list(range(16)), -10**6).inputFiles())
    assert past.where(F.col("account") == one).agg(F.sum("n")).first()[0] == (
        thirds[0].unionAll(thirds[1]).where(F.col("account") == one).count())


def test_merges_and_evictions_can_run_again(spark, rows, tmp_path):
    """Each batch runs twice, as after a failure before its commit; merges happen in between."""
    edges = rows.agg(F.percentile_approx("step", [i / 10 for i in range(1, 10)])).first()[0]
    parts = [rows.where((F.col("step") > lo) & (F.col("step") <= hi)) for lo, hi in zip([-1, *edges], [*edges, 10**9])]
    for i, part in enumerate(parts):
        for _ in range(2):
            LiveFeatures(spark, str(tmp_path), window=5, lateness=3)(part, i)
    live = LiveFeatures(spark, str(tmp_path), window=5, lateness=3)
    assert same(features(rows, 5), live.output.read().drop("batch_id"))
    live.settle()
    live.settle()
    high = rows.agg(F.max("step")).first()[0]
    steps = rows.groupBy("account", "step").agg(F.count(F.lit(1)).alias("n"))
    assert same(steps.where(F.col("step") < high - 8), live.evicted.read().select("account", "step", "n"))
    assert same(steps.where(F.col("step") >= high - 8), live.history.read().select("account", "step", "n"))


def test_stream_goes_on_after_settling(spark, rows, thirds, tmp_path):
    live = LiveFeatures(spark, str(tmp_path))
    for i, part in enumerate(thirds):
        live(part, i)
        live.settle()
    assert same(features(rows), live.output.read().drop("batch_id"))
    assert live.evicted.read().groupBy("account", "step").count().where("count > 1").isEmpty()
