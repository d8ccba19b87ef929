"""Velocity features over tables, and checks on feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.operators import compare as C
from pacewise.operators.aggregates import per_key
from pacewise.operators.velocity import (FEATURES, feature_vector, features,
                                         in_arrival_order)
from pacewise.plans.registry import (ORDER_TXN, TXN, event_rows, features_sql, order_rows, query)

KEYS = ("account", "step", "seq")
ORDER_WINDOW_DAYS = 365

FEATURE_SELECT = ", ".join([*KEYS, "velocity_count", "window_sum", "round(window_mean, 6) AS window_mean",
                            "window_max", "round(amount_over_mean, 6) AS amount_over_mean"])


def rounded(featured: DataFrame, *extra: str) -> DataFrame:
    return featured.select(*KEYS, "velocity_count", "window_sum",
                           F.round("window_mean", 6).alias("window_mean"), "window_max",
                           F.round("amount_over_mean", 6).alias("amount_over_mean"), *extra)


VELOCITY_SQL = f"WITH {features_sql()} SELECT {FEATURE_SELECT} FROM feat"


@query("velocity_features", VELOCITY_SQL)
def velocity_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features(event_rows(spark, sf)))


@query("velocity_features_hot_accounts", VELOCITY_SQL)
def velocity_features_hot_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """The same with accounts of 64 rows or more cut into pieces, as hot accounts are."""
    return rounded(features(event_rows(spark, sf), hot_rows=64))


@query("velocity_features_orders",
       f"WITH {features_sql(ORDER_TXN, ORDER_WINDOW_DAYS)} SELECT {FEATURE_SELECT} FROM feat")
def velocity_features_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features(order_rows(spark, sf), window=ORDER_WINDOW_DAYS))


def _register_single(name: str, precision: int | None) -> None:
    value = name if precision is None else f"round({name}, {precision}) AS {name}"

    @query(f"feature_{name}", f"WITH {features_sql()} SELECT seq, {value} FROM feat")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        column = F.col(name) if precision is None else F.round(name, precision)
        return features(event_rows(spark, sf)).select("seq", column.alias(name))


for _name, _precision in zip(FEATURES, (None, 2, 6, None, 6)):
    _register_single(_name, _precision)


@query("feature_vector", f"""WITH {features_sql()}, v AS (SELECT seq, [CAST(velocity_count AS DOUBLE),
  window_sum, window_mean, window_max, amount_over_mean] AS x FROM feat)
SELECT seq, CAST(i - 1 AS INTEGER) AS position, round(x[i], 6) AS value
FROM v, range(1, 6) AS r(i)""")
def feature_vector_entries(spark: SparkSession, sf: str) -> DataFrame:
    vectors = features(event_rows(spark, sf)).select("seq", feature_vector().alias("x"))
    return vectors.select("seq", F.posexplode("x").alias("position", "value")).withColumn(
        "value", F.round("value", 6))


@query("features_in_arrival_order", f"WITH {features_sql()} SELECT {FEATURE_SELECT} FROM feat ORDER BY seq")
def features_in_arrival_order(spark: SparkSession, sf: str) -> DataFrame:
    return in_arrival_order(rounded(features(event_rows(spark, sf))))


# --- checks -------------------------------------------------------------------

@query("feature_fingerprint", f"""WITH {features_sql()}, h AS (
  SELECT CAST('0x' || substr(md5(concat_ws('|', seq, account, step, velocity_count,
    CAST(round(window_sum * 100) AS BIGINT), CAST(round(window_mean * 1000000) AS BIGINT),
    CAST(round(window_max * 100) AS BIGINT), CAST(round(amount_over_mean * 1000000) AS BIGINT))), 1, 15)
    AS BIGINT) AS h FROM feat)
SELECT count(*) AS rows, bit_xor(h) AS hash_xor, CAST(sum(h) AS DECIMAL(38,0)) AS hash_sum FROM h""")
def feature_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return C.feature_fingerprint(features(event_rows(spark, sf)))


@query("same_features_two_ways", """SELECT count(*) AS rows_a, count(*) AS rows_b,
  true AS identical FROM events""")
def same_features_two_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of the plain form and of the form for hot accounts."""
    plain = features(event_rows(spark, sf), hot_rows=None)
    split = features(event_rows(spark, sf), hot_rows=64)
    return C.same_fingerprint(C.feature_fingerprint(plain), C.feature_fingerprint(split))


@query("same_features_to_the_last_bit", """SELECT count(*) AS rows_a, count(*) AS rows_b,
  true AS identical FROM events""")
def same_features_to_the_last_bit(spark: SparkSession, sf: str) -> DataFrame:
    plain = features(event_rows(spark, sf), hot_rows=None)
    split = features(event_rows(spark, sf), hot_rows=64)
    return C.same_fingerprint(C.exact_feature_fingerprint(plain), C.exact_feature_fingerprint(split))


@query("planted_difference_found", """SELECT count(*) AS rows_a, count(*) AS rows_b, false AS identical FROM events""")
def planted_difference_found(spark: SparkSession, sf: str) -> DataFrame:
    """One ratio of the table is off by its last bit; the exact fingerprints differ."""
    plain = features(event_rows(spark, sf))
    first = event_rows(spark, sf).agg(F.min("seq").alias("seq")).withColumn("off", F.lit(2.0 ** -52))
    changed = plain.join(F.broadcast(first), "seq", "left").withColumn(  # one row
        "amount_over_mean", F.col("amount_over_mean") * (1 + F.coalesce("off", F.lit(0.0))))
    return C.same_fingerprint(C.exact_feature_fingerprint(plain), C.exact_feature_fingerprint(changed))


@query("rows_that_differ", f"""WITH {TXN} SELECT merchant, count(*) AS n, 'a' AS side FROM txn
GROUP BY merchant HAVING count(*) FILTER (isFraud = 1) > 0
UNION ALL SELECT merchant, count(*) FILTER (isFraud = 0), 'b' FROM txn
GROUP BY merchant HAVING count(*) FILTER (isFraud = 1) > 0""")
def rows_that_differ(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per merchant, of all rows and of the rows without the label."""
    def counted(rows):
        return rows.groupBy("merchant").agg(F.count(F.lit(1)).alias("n"))
    rows = event_rows(spark, sf)
    return C.row_differences(counted(rows), counted(rows.where(F.col("isFraud") == 0)))


@query("totals_within_tolerance", """SELECT count(DISTINCT o_custkey) AS keys, CAST(0 AS BIGINT) AS only_a,
  CAST(0 AS BIGINT) AS only_b, CAST(0 AS BIGINT) AS off_count, CAST(0 AS BIGINT) AS off_sum,
  CAST(0 AS BIGINT) AS off_max FROM orders""")
def totals_within_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Exact totals per account against sums of doubles."""
    rows = order_rows(spark, sf)
    plain = rows.groupBy("account").agg(F.count(F.lit(1)).alias("count"), F.sum("amount").alias("sum"),
                                        F.max("amount").alias("max"))
    return C.compare_within(per_key(rows, "account", "amount"), plain, "account",
                            ["count", "sum", "max"], relative=1e-9)


