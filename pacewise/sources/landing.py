"""Files that land for a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.operators.joins import fits_broadcast
from pacewise.operators.ordering import with_ordinal
from pacewise.schema import SEQUENCED, conform

PAYSIM_CSV = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.IntegerType()),
    T.StructField("isFlaggedFraud", T.IntegerType()),
])


def read_paysim(spark: SparkSession, path: str) -> DataFrame:
    """PaySim CSV files as transactions: the account is the number in ``nameOrig``.

    The files have no row numbers. ``seq`` counts rows in the order of file names, and inside a file by place, however
    Spark packs the splits of the files into tasks.
    """
    raw = spark.read.csv(path, header=True, schema=PAYSIM_CSV, enforceSchema=False)
    placed = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                        F.monotonically_increasing_id().alias("__id"))
    # One row per split. The rows of a split lie together in one task.
    splits = placed.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__rows"), F.min("__id").alias("__first"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("__file", "__block", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    numbered_rows = (placed.join(F.broadcast(starts) if fits_broadcast(starts) else starts, ["__file", "__block"])
                     .withColumn("place", F.col("__start") + F.col("__id") - F.col("__first")))
    account = F.regexp_extract("nameOrig", r"(\d+)", 1).cast("long")
    return conform(numbered_rows, {"account": account, "merchant": F.coalesce(F.col("nameDest"), F.lit("")),
                                   "seq": F.col("place")})


def numbered(rows: DataFrame) -> DataFrame:
    """Replace ``seq`` by the gapless ordinal of the same order."""
    return with_ordinal(rows, "seq", "__ordinal").withColumn("seq", F.col("__ordinal")).drop("__ordinal")


FILES_PER_TRIGGER = 1000


def live_transactions(spark: SparkSession, path: str, files_per_trigger: int | None = FILES_PER_TRIGGER,
                      bytes_per_trigger: str | None = None, fmt: str = "parquet",
                      schema: T.StructType = SEQUENCED) -> DataFrame:
    """Transactions as a stream of the files that land under ``path``.

    Spark asks for the next files when it is ready for them, so the intake of a
    micro-batch is bounded by these options, nothing queues up, and nothing is lost.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.load(path)


def paced(writer, seconds: float = 0.0):
    """Trigger for a stream: at most one micro-batch per interval, or all that is there."""
    if seconds > 0:
        return writer.trigger(processingTime=f"{seconds} seconds")
    return writer.trigger(availableNow=True)
