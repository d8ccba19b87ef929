"""Throughput at the size of the published baseline, about five million rows.

Copies of the events table with shifted accounts and times, written once to the folder
given as argument. A third of the rows may be moved to one account (``--hot``).
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pacewise.operators.aggregates import filtered_aggregate, filtered_count, per_key, rollup_of_keys  # noqa: E402
from pacewise.operators.velocity import features  # noqa: E402
from pacewise.plans.models import FIXED  # noqa: E402
from pacewise.plans.registry import event_rows  # noqa: E402
from pacewise.session import local_session, path_exists, shared_dir  # noqa: E402
from pacewise.sources.landing import live_transactions  # noqa: E402
from pacewise.streaming.live import LiveFeatures  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("folder")
    parser.add_argument("--copies", type=int, default=50)
    parser.add_argument("--hot", action="store_true")
    parser.add_argument("--hot-rows", type=int, default=1_000_000)
    parser.add_argument("--runs", type=int, default=3)
    parser.add_argument("--stream", type=int, metavar="BATCHES", help="only run the rows as a live stream in so many micro-batches")
    args = parser.parse_args()
    spark = local_session("bench-scale", cores=int(os.environ.get("BENCH_CPUS", "8")))

    if not path_exists(spark, args.folder):
        base = event_rows(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))
        copies = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(args.copies - 1))))
        account = F.col("account") * args.copies + F.col("copy")
        if args.hot:
            account = F.when(F.col("seq") % 3 == 0, F.lit(-1)).otherwise(account)
        (copies.withColumn("account", account)
         .withColumn("seq", F.col("seq") * args.copies + F.col("copy")).drop("copy")
         .repartitionByRange(16, "seq").write.parquet(args.folder))
    rows = spark.read.parquet(args.folder).drop("merchant")
    count = rows.count()

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    if args.stream:
        stream(spark, rows, count, args.stream)
        return
    jobs = {
        "features": lambda: sink(features(rows, hot_rows=args.hot_rows)),
        "features_and_score": lambda: sink(FIXED.score(features(rows, hot_rows=args.hot_rows))),
        "per_account_rollup": lambda: sink(rollup_of_keys(per_key(rows, "account", "amount"))),
        "filtered_aggregate": lambda: sink(filtered_aggregate(rows, "amount", [("amount", ">", 200)], 2)),
        "unfiltered_count": lambda: sink(filtered_count(rows, "amount")),
    }
    if not args.hot:
        jobs["features_without_hot_check"] = lambda: sink(features(rows, hot_rows=None))
    for name, job in jobs.items():
        best = None
        for _ in range(args.runs):
            begin = time.perf_counter()
            job()
            took = time.perf_counter() - begin
            best = took if best is None else min(best, took)
        print(json.dumps({"job": name, "rows": count, "seconds": round(best, 3),
                          "million_rows_per_second": round(count / best / 1e6, 3)}), flush=True)
    spark.stop()


def stream(spark, rows, count, batches):
    """Live features and scores over all rows in step order, one landed file a micro-batch."""
    root = shared_dir(spark, "bench-stream")
    files = rows.withColumn("merchant", F.lit("")).repartitionByRange(batches, "step", "seq").sortWithinPartitions("step", "seq")
    files.write.parquet(f"{root}/landed")
    live = LiveFeatures(spark, f"{root}/live", model=FIXED)
    begin = time.perf_counter()
    query = live.start(live_transactions(spark, f"{root}/landed", files_per_trigger=1), f"{root}/checkpoint")
    query.awaitTermination()
    took = time.perf_counter() - begin
    seconds = [round(p["durationMs"]["triggerExecution"] / 1000, 2) for p in query.recentProgress if p["numInputRows"]]
    told = live.progress.read().agg(F.sum("rows_in"), F.max("runs"), F.max("files_read"), F.max("state_rows")).first()
    print(json.dumps({"job": "stream_features_and_score", "rows": told[0], "seconds": round(took, 3),
                      "million_rows_per_second": round(count / took / 1e6, 3), "seconds_per_batch": seconds,
                      "most_runs": told[1], "most_files_read": told[2], "most_state_rows": told[3]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
