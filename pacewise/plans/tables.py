"""Sources, filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.functions.predicates import all_of, compare, flag
from pacewise.operators.ordering import by_score, by_text, every_nth, with_ordinal
from pacewise.plans.registry import ORDER_TXN, TXN, event_rows, order_rows, query, table
from pacewise.schema import DAY_SECONDS, numeric, publish, step_of, text_or_empty
from pacewise.session import shared_dir
from pacewise.sources import arrow_stream
from pacewise.sources.landing import live_transactions, paced, read_paysim

_ROW = "account, step, amount, isFraud, merchant, seq"


@query("conform_events", f"WITH {TXN} SELECT {_ROW} FROM txn")
def conform_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(spark, sf)


@query("conform_orders", f"WITH {ORDER_TXN} SELECT {_ROW} FROM txn")
def conform_orders(spark: SparkSession, sf: str) -> DataFrame:
    return order_rows(spark, sf)


@query("published_rows", f"""WITH {TXN} SELECT merchant, count(*) AS n, max(amount) AS largest
FROM txn WHERE step % 24 < 6 GROUP BY merchant""")
def published_rows(spark: SparkSession, sf: str) -> DataFrame:
    publish(event_rows(spark, sf), "published_transactions")
    return spark.sql("""SELECT merchant, count(*) AS n, max(amount) AS largest
        FROM published_transactions WHERE step % 24 < 6 GROUP BY merchant""")


@query("arrow_stream_round_trip", f"WITH {TXN} SELECT {_ROW} FROM txn")
def arrow_stream_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "arrow-stream")
    arrow_stream.write(event_rows(spark, sf), path)
    return arrow_stream.read(spark, path)


@query("arrow_stream_rows_written", "SELECT count(*) AS rows_written FROM orders")
def arrow_stream_rows_written(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "arrow-stream")
    written = arrow_stream.write(order_rows(spark, sf), path, batch_size=4096)
    return spark.range(1).select(F.lit(written).cast("long").alias("rows_written"))


@query("arrow_stream_followed", f"WITH {TXN} SELECT {_ROW} FROM txn")
def arrow_stream_followed(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over Arrow files that are appended between its runs, one restart after each; a manifest says what was taken."""
    root = shared_dir(spark, "arrow-followed")
    for part in range(3):
        arrow_stream.write(event_rows(spark, sf).where(F.col("seq") % 3 == part), f"{root}/landed")
        stream = arrow_stream.follow(spark, f"{root}/landed", progress=f"{root}/progress")
        (stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start(f"{root}/taken").awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{root}/taken")


@query("live_intake", f"""WITH {TXN} SELECT account, count(*) AS n, max(seq) AS last_seq
FROM txn GROUP BY account""")
def live_intake(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that land as several files, read as a stream two files at a time."""
    root = shared_dir(spark, "live-intake")
    event_rows(spark, sf).repartitionByRange(6, "seq").write.parquet(f"{root}/landed")
    stream = live_transactions(spark, f"{root}/landed", files_per_trigger=2)
    out = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    paced(out).start(f"{root}/taken").awaitTermination()
    taken = spark.read.schema(stream.schema).parquet(f"{root}/taken")
    return taken.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


FILE_ROWS = 500_000  # of a CSV file, on average


@query("paysim_csv_rows", """SELECT o_custkey AS account,
  CAST(epoch_us(o_orderdate) // 86400000000 AS INTEGER) AS step, o_totalprice AS amount,
  CAST(o_orderstatus = 'F' AS TINYINT) AS isFraud, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders""")
def paysim_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written in the layout of the PaySim CSV, as files of uneven size, and read back in order."""
    path = shared_dir(spark, "paysim")
    zero, key = F.lit(0.0), F.asc_nulls_last("o_orderkey")
    orders = table(spark, sf, "orders")
    few = F.coalesce(F.col("o_orderkey") < 100, F.lit(False))
    files = -(-orders.count() // FILE_ROWS)
    # the few first rows in one folder, the rest in the next, as ranges that one task sorts each
    for folder, rows, parts in (("0", orders.where(few), 1), ("1", orders.where(~few), max(1, files))):
        (rows.repartitionByRange(parts, key).sortWithinPartitions(key)
         .select(step_of(F.col("o_orderdate"), DAY_SECONDS).alias("step"), F.lit("PAYMENT").alias("type"),
                 F.col("o_totalprice").cast("double").alias("amount"),
                 F.concat(F.lit("C"), F.col("o_custkey").cast("long")).alias("nameOrig"), zero.alias("oldbalanceOrg"),
                 zero.alias("newbalanceOrig"), F.lit("M1").alias("nameDest"), zero.alias("oldbalanceDest"),
                 zero.alias("newbalanceDest"), (F.col("o_orderstatus") == "F").cast("int").alias("isFraud"),
                 F.lit(0).alias("isFlaggedFraud"))
         .write.csv(f"{path}/{folder}", header=True))
    return read_paysim(spark, f"{path}/*").select("account", "step", "amount", "isFraud", "seq")


# --- comparisons ----------------------------------------------------------------

def _register_comparison(name: str, op: str, value: float) -> None:
    @query(f"filter_{name}", f"""SELECT l_orderkey, l_linenumber, l_quantity
FROM lineitem WHERE l_quantity {op} {value}""")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, "lineitem")
        return (rows.where(compare(rows, "l_quantity", op, value))
                .select("l_orderkey", "l_linenumber", "l_quantity"))


for _name, _op, _value in (("greater", ">", 45.0), ("greater_or_equal", ">=", 45.0), ("less", "<", 4.0),
                           ("less_or_equal", "<=", 4.0), ("equal", "=", 24.0), ("not_equal", "<>", 24.0)):
    _register_comparison(_name, _op, _value)


@query("filter_stacked", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 20 AND l_discount <= 0.05 AND l_tax <> 0.02 AND l_linenumber < 5""")
def filter_stacked(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    wanted = [("l_quantity", ">", 20), ("l_discount", "<=", 0.05), ("l_tax", "<>", 0.02),
              ("l_linenumber", "<", 5)]
    return rows.where(all_of(rows, wanted)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_row_predicate", "SELECT event_id, value FROM events WHERE value > 200")
def filter_row_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """A predicate given as a function of the column; the plan is that of a comparison."""
    above = lambda amount: amount > 200.0
    return table(spark, sf, "events").where(above(F.col("value"))).select("event_id", "value")


@query("select_one_number", "SELECT l_extendedprice FROM lineitem")
def select_one_number(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return rows.select(numeric(rows, "l_extendedprice").alias("l_extendedprice"))


@query("widen_to_double", """SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS key_as_double,
  CAST(p_size AS DOUBLE) AS size_as_double FROM part""")
def widen_to_double(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", numeric(rows, "p_partkey").alias("key_as_double"),
                       numeric(rows, "p_size").alias("size_as_double"))


@query("null_text_to_empty", """SELECT coalesce(CASE WHEN l_returnflag <> 'N' THEN l_linestatus END, '')
  AS text, count(*) AS n FROM lineitem GROUP BY 1""")
def null_text_to_empty(spark: SparkSession, sf: str) -> DataFrame:
    some = F.when(F.col("l_returnflag") != "N", F.col("l_linestatus"))
    return (table(spark, sf, "lineitem").groupBy(text_or_empty(some).alias("text"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("flag_above_threshold", f"WITH {TXN} SELECT seq, amount > 150 AS flagged FROM txn")
def flag_above_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(spark, sf).select("seq", flag(F.col("amount"), 150.0).alias("flagged"))


# --- order ----------------------------------------------------------------------

@query("row_ordinal", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal
FROM orders""")
def row_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return with_ordinal(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("every_nth_row", """SELECT seq, ordinal FROM (
  SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM events)
WHERE ordinal % 100 = 0 ORDER BY ordinal LIMIT 3""")
def every_nth_row(spark: SparkSession, sf: str) -> DataFrame:
    return every_nth(event_rows(spark, sf).select("seq"), n=100).select("seq", "ordinal")


@query("sort_by_ordinal", f"WITH {TXN} SELECT seq, account, amount FROM txn ORDER BY seq")
def sort_by_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(spark, sf).select("seq", "account", "amount").orderBy("seq")


@query("sort_by_score", f"WITH {TXN} SELECT seq, amount AS score FROM txn ORDER BY score, seq")
def sort_by_score(spark: SparkSession, sf: str) -> DataFrame:
    return by_score(event_rows(spark, sf).select("seq", F.col("amount").alias("score")), "score")


@query("sort_by_text", "SELECT DISTINCT p_name FROM part ORDER BY p_name")
def sort_by_text(spark: SparkSession, sf: str) -> DataFrame:
    return by_text(table(spark, sf, "part").select("p_name").distinct(), "p_name")
