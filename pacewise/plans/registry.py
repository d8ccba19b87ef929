"""Registration of named queries, and the pieces they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pacewise.schema import transactions_from_events, transactions_from_orders

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query. Without ``sql`` no statement gives its result."""

    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} exists")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(table(spark, sf_dir, "events"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_orders(table(spark, sf_dir, "orders"))


# --- SQL pieces ---------------------------------------------------------------

TXN = """txn AS (
  SELECT user_id AS account, CAST(epoch_us(ts) // 3600000000 AS INTEGER) AS step,
         value AS amount, CAST(value >= 150 AS TINYINT) AS isFraud,
         coalesce(event_type, '') AS merchant, event_id AS seq,
         CAST(round(value * 100) AS BIGINT) AS units
  FROM events)"""

ORDER_TXN = """txn AS (
  SELECT o_custkey AS account, CAST(epoch_us(o_orderdate) // 86400000000 AS INTEGER) AS step,
         o_totalprice AS amount, CAST(o_orderpriority = '1-URGENT' AS TINYINT) AS isFraud,
         coalesce(o_orderpriority, '') AS merchant, o_orderkey AS seq,
         CAST(round(o_totalprice * 100) AS BIGINT) AS units
  FROM orders)"""


def features_sql(txn: str = TXN, window: int = 24) -> str:
    """CTEs ``txn``, ``win`` and ``feat``: the window as a self-join."""
    return f"""{txn}, win AS (
  SELECT a.account, a.step, a.amount, a.isFraud, a.merchant, a.seq,
         count(b.seq) AS n, CAST(coalesce(sum(b.units), 0) AS DOUBLE) / CAST(100 AS DOUBLE) AS total,
         coalesce(max(b.amount), 0) AS peak
  FROM txn a LEFT JOIN txn b
    ON b.account = a.account AND b.step >= a.step - {window}
   AND (b.step < a.step OR (b.step = a.step AND b.seq < a.seq))
  GROUP BY a.account, a.step, a.amount, a.isFraud, a.merchant, a.seq),
avgs AS (SELECT *, CASE WHEN n > 0 THEN total / n ELSE 0 END AS mean FROM win),
feat AS (
  SELECT account, step, seq, amount, isFraud, merchant,
         CAST(n AS BIGINT) AS velocity_count, total AS window_sum, CAST(mean AS DOUBLE) AS window_mean,
         CAST(peak AS DOUBLE) AS window_max,
         CAST(CASE WHEN mean <= 0 THEN 1 ELSE amount / mean END AS DOUBLE) AS amount_over_mean
  FROM avgs)"""
