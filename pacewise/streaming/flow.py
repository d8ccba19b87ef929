"""Flow accounting: the latest row per interval, what that sheds, and the backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacewise.operators.joins import fits_broadcast
from pacewise.operators.ordering import BUCKET, range_bounds, with_range

KEPT = "kept"


def latest_per_interval(df: DataFrame, ts: str, interval: str, seq: str,
                        lateness: str | None = None) -> DataFrame:
    """The last row of each interval of event time, with ``interval_start``.

    Works on a table, and on a stream when ``lateness`` sets its watermark. On a table
    the newest time of each interval is found first, by hashed partials over the time
    column alone, and only rows of those times are compared as a whole.
    """
    if lateness is not None:
        rows = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    else:
        newest = df.groupBy(F.window(ts, interval)).agg(F.max(ts).alias("__newest")).select("__newest")
        found = F.broadcast(newest) if fits_broadcast(newest) else newest
        rows = df.join(found, F.col(ts) == F.col("__newest"), "left_semi")
    last = F.max_by(F.struct(*df.columns), F.struct(ts, seq))
    return (rows.groupBy(F.window(ts, interval).alias("interval")).agg(last.alias(KEPT))
            .select(F.col("interval.start").alias("interval_start"), f"{KEPT}.*"))


def shedding(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """One row ``(produced, consumed, dropped)`` for keeping one row per interval."""
    per_interval = df.groupBy(F.window(ts, interval)).agg(F.count(F.lit(1)).alias("n"))
    return per_interval.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("produced"),
        F.count(F.lit(1)).alias("consumed"),
    ).withColumn("dropped", F.col("produced") - F.col("consumed"))


def watched(stream: DataFrame, name: str = "flow") -> DataFrame:
    """Count the rows that pass here; a stream reports it in ``observedMetrics``."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"))


def flow_log(df: DataFrame, feed: Column, start: Column, end: Column) -> DataFrame:
    """Changes of the backlog: +1 when an item is produced, -1 when it is done or dropped.

    ``(feed, at, up, down)``, one row per feed and moment; times are integers.
    """
    moments = df.select(feed.alias("feed"), F.explode(F.array(
        F.struct(start.cast("long").alias("at"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(end.cast("long").alias("at"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )).alias("m"))
    return (moments.groupBy("feed", F.col("m.at").alias("at"))
            .agg(F.sum("m.up").cast("long").alias("up"), F.sum("m.down").cast("long").alias("down")))


def max_backlog(log: DataFrame, pieces: int | None = None) -> DataFrame:
    """``(feed, produced, max_backlog)``: the largest number of items in flight.

    Within one moment arrivals count before departures. Time is cut into ranges; each
    (feed, range) gives its net change and the peak inside it, and only those few rows
    per feed are put in sequence. A feed that holds all rows is still many groups.
    """
    ranged = with_range(log, "at", range_bounds(log, "at", pieces))
    net = F.col("up") - F.col("down")
    inside = (Window.partitionBy("feed", BUCKET).orderBy("at")
              .rowsBetween(Window.unboundedPreceding, -1))
    peaks = (ranged.withColumn("level", F.coalesce(F.sum(net).over(inside), F.lit(0)) + F.col("up"))
             .groupBy("feed", BUCKET)
             .agg(F.sum("up").alias("up"), F.sum(net).alias("net"), F.max("level").alias("peak")))
    before = Window.partitionBy("feed").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("net").over(before), F.lit(0)) + F.col("peak")
    return (peaks.withColumn("level", level).groupBy("feed")
            .agg(F.sum("up").alias("produced"), F.max("level").alias("max_backlog")))
