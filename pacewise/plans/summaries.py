"""Aggregates, partials, rollups, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.functions.money import minor_units
from pacewise.operators import aggregates as A
from pacewise.operators import partials as P
from pacewise.operators.quantiles import LATENCY_QUANTILES, approximate, nearest_rank
from pacewise.plans.registry import TXN, event_rows, query, table

_NULLED = "CASE WHEN value >= 50 THEN value END"
_CENTS = "CAST(round({0} * 100) AS BIGINT)"


def _exact(column: str) -> str:
    return f"CAST(coalesce(sum({_CENTS.format(column)}), 0) AS DOUBLE) / CAST(100 AS DOUBLE)"


def _some_null(spark: SparkSession, sf: str) -> DataFrame:
    """Event values of which the small ones are null."""
    return table(spark, sf, "events").select(
        "event_type", F.when(F.col("value") >= 50, F.col("value")).alias("value"))


@query("sum_skips_nulls", f"SELECT coalesce(sum({_CENTS.format(_NULLED)}), 0)::BIGINT AS units FROM events")
def sum_skips_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return _some_null(spark, sf).agg(A.total(F.rint(F.col("value") * 100).cast("long")).alias("units"))


@query("sum_of_nothing", "SELECT CAST(0 AS BIGINT) AS units")
def sum_of_nothing(spark: SparkSession, sf: str) -> DataFrame:
    none = table(spark, sf, "lineitem").where(F.col("l_quantity") < 0)
    return none.agg(A.total(F.col("l_orderkey")).alias("units"))


@query("strict_min", f"SELECT event_type, min({_NULLED}) AS low FROM events GROUP BY event_type")
def strict_min(spark: SparkSession, sf: str) -> DataFrame:
    return _some_null(spark, sf).groupBy("event_type").agg(A.strict_min(F.col("value")).alias("low"))


@query("strict_max", f"SELECT event_type, max({_NULLED}) AS high FROM events GROUP BY event_type")
def strict_max(spark: SparkSession, sf: str) -> DataFrame:
    return _some_null(spark, sf).groupBy("event_type").agg(A.strict_max(F.col("value")).alias("high"))


@query("strict_mean", f"SELECT event_type, round(avg({_NULLED}), 6) AS mean FROM events GROUP BY event_type")
def strict_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _some_null(spark, sf).groupBy("event_type").agg(
        F.round(A.strict_mean(F.col("value")), 6).alias("mean"))


_OVER_200 = [("value", ">", 200.0)]


@query("filtered_aggregate", f"""SELECT {_exact('value')} AS sum, count(*) AS count,
  coalesce(max(value), 0) AS max FROM events WHERE value > 200""")
def filtered_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return A.filtered_aggregate(table(spark, sf, "events"), "value", _OVER_200, decimals=2)


@query("filtered_aggregate_lineitem", f"""SELECT {_exact('l_extendedprice')} AS sum, count(*) AS count,
  coalesce(max(l_extendedprice), 0) AS max FROM lineitem
WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount > 0.02""")
def filtered_aggregate_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [("l_quantity", ">=", 10), ("l_quantity", "<", 40), ("l_discount", ">", 0.02)]
    return A.filtered_aggregate(table(spark, sf, "lineitem"), "l_extendedprice", wanted, decimals=2)


@query("unfiltered_aggregate", f"""SELECT {_exact('l_extendedprice')} AS sum, count(*) AS count,
  coalesce(max(l_extendedprice), 0) AS max FROM lineitem""")
def unfiltered_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return A.filtered_aggregate(table(spark, sf, "lineitem"), "l_extendedprice", decimals=2)


@query("aggregate_of_no_match", "SELECT CAST(0 AS DOUBLE) AS sum, CAST(0 AS BIGINT) AS count, CAST(0 AS DOUBLE) AS max")
def aggregate_of_no_match(spark: SparkSession, sf: str) -> DataFrame:
    return A.filtered_aggregate(table(spark, sf, "events"), "value", [("value", ">", 1e9)])


@query("filtered_sum", f"SELECT {_exact('value')} AS sum FROM events WHERE value > 200")
def filtered_sum(spark: SparkSession, sf: str) -> DataFrame:
    return A.filtered_sum(table(spark, sf, "events"), "value", _OVER_200, decimals=2)


@query("filtered_count", "SELECT count(*) AS count FROM events WHERE value > 200")
def filtered_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.filtered_count(table(spark, sf, "events"), "value", _OVER_200)


@query("unfiltered_count", "SELECT count(*) AS count FROM lineitem")
def unfiltered_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.filtered_count(table(spark, sf, "lineitem"), "l_quantity")


@query("filtered_mean", "SELECT round(coalesce(avg(value), 0), 6) AS mean FROM events WHERE value > 200")
def filtered_mean(spark: SparkSession, sf: str) -> DataFrame:
    return A.filtered_mean(table(spark, sf, "events"), "value", _OVER_200, decimals=2).select(
        F.round("mean", 6).alias("mean"))


@query("filtered_max", "SELECT coalesce(max(value), 0) AS max FROM events WHERE value > 200")
def filtered_max(spark: SparkSession, sf: str) -> DataFrame:
    return A.filtered_max(table(spark, sf, "events"), "value", _OVER_200)


# --- partials -------------------------------------------------------------------


@query("mean_from_partials", "SELECT count(*) AS count, round(avg(value), 6) AS mean FROM events")
def mean_from_partials(spark: SparkSession, sf: str) -> DataFrame:
    parts = P.partials(table(spark, sf, "events"), "value", "event_type")
    return P.finish(P.merge(parts)).select("count", F.round("mean", 6).alias("mean"))


@query("stats_from_partials", f"""SELECT event_type, count(value) AS count, {_exact('value')} AS sum,
  round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY event_type""")
def stats_from_partials(spark: SparkSession, sf: str) -> DataFrame:
    """Partials per type and day, merged per type."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    parts = events.groupBy("event_type", "day").agg(
        F.count("value").alias("n"), F.sum(minor_units(F.col("value"))).alias("units"),
        F.min("value").alias("low"), F.max("value").alias("high"))
    return P.finish(P.merge(parts, "event_type"), "event_type").withColumn("mean", F.round("mean", 6))


@query("fold_per_day", f"""SELECT CAST(ts AS DATE) AS day, count(value) AS count, {_exact('value')} AS sum,
  round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1""")
def fold_per_day(spark: SparkSession, sf: str) -> DataFrame:
    parts = P.partials(table(spark, sf, "events"), "value", F.to_date("ts").alias("day"))
    return P.finish(parts, "day").withColumn("mean", F.round("mean", 6))


@query("stats_of_nothing", """SELECT CAST(0 AS BIGINT) AS count, CAST(0 AS DOUBLE) AS sum,
  CAST('nan' AS DOUBLE) AS mean, CAST('inf' AS DOUBLE) AS min, CAST('-inf' AS DOUBLE) AS max""")
def stats_of_nothing(spark: SparkSession, sf: str) -> DataFrame:
    none = table(spark, sf, "events").where(F.col("value") < 0)
    return P.finish(P.partials(none, "value"))


# --- groups ---------------------------------------------------------------------

@query("per_account_totals", f"""WITH {TXN} SELECT account, count(*) AS count,
  CAST(sum(units) AS DOUBLE) / CAST(100 AS DOUBLE) AS sum, max(amount) AS max FROM txn GROUP BY account""")
def per_account_totals(spark: SparkSession, sf: str) -> DataFrame:
    return A.per_key(event_rows(spark, sf), "account", "amount")


@query("per_account_rollup", f"""WITH {TXN}, g AS (SELECT account, count(*) AS c, sum(units) AS s,
  max(units) AS m FROM txn GROUP BY account)
SELECT count(*) AS groups, CAST(sum(c) AS BIGINT) AS rows,
  CAST(sum(s) AS DOUBLE) / CAST(100 AS DOUBLE) AS sum_of_sums,
  CAST(sum(m) AS DOUBLE) / CAST(100 AS DOUBLE) AS sum_of_maxima FROM g""")
def per_account_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return A.rollup_of_keys(A.per_key(event_rows(spark, sf), "account", "amount"))


@query("per_supplier_rollup", """WITH g AS (SELECT l_suppkey, count(*) AS c,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS s,
  max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS m FROM lineitem GROUP BY 1)
SELECT count(*) AS groups, CAST(sum(c) AS BIGINT) AS rows,
  CAST(sum(s) AS DOUBLE) / CAST(100 AS DOUBLE) AS sum_of_sums,
  CAST(sum(m) AS DOUBLE) / CAST(100 AS DOUBLE) AS sum_of_maxima FROM g""")
def per_supplier_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return A.rollup_of_keys(A.per_key(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice"))


@query("run_summary", f"""WITH {TXN} SELECT count(*) AS rows, count(*) FILTER (isFraud = 1) AS positives,
  round(100.0 * count(*) FILTER (isFraud = 1) / count(*), 6)::DOUBLE AS percent,
  count(DISTINCT account) AS keys FROM txn""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.run_summary(event_rows(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("distinct_texts", "SELECT DISTINCT coalesce(p_name, '') AS p_name FROM part")
def distinct_texts(spark: SparkSession, sf: str) -> DataFrame:
    return A.distinct_texts(table(spark, sf, "part"), "p_name")


@query("distinct_accounts", f"WITH {TXN} SELECT count(DISTINCT account) AS keys FROM txn")
def distinct_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return A.distinct_keys(event_rows(spark, sf), "account")


@query("distinct_accounts_sketch")
def distinct_accounts_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return A.distinct_keys(event_rows(spark, sf), "account", approximate=True)


@query("state_footprint", f"""WITH {TXN} SELECT count(DISTINCT account) AS keys,
  count(DISTINCT account) * 240 AS state_bytes FROM txn""")
def state_footprint(spark: SparkSession, sf: str) -> DataFrame:
    return A.state_footprint(event_rows(spark, sf), "account")


def _ranked(column: str, table_name: str) -> str:
    picks = ", ".join(
        f"s[least(len(s) - 1, CAST(floor({q} * len(s)) AS BIGINT)) + 1] AS {n}"
        for n, q in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999)))
    return f"""WITH v AS (SELECT list_sort(list({column})) AS s FROM {table_name})
SELECT {picks}, s[len(s)] AS max FROM v"""


@query("nearest_rank_quantiles", _ranked("value", "events"))
def nearest_rank_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_rank(table(spark, sf, "events"), "value")


@query("nearest_rank_quantiles_lineitem", _ranked("l_extendedprice", "lineitem"))
def nearest_rank_quantiles_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_rank(table(spark, sf, "lineitem"), "l_extendedprice")


@query("sketches_within_bounds", """SELECT true AS keys_within, true AS p50_within, true AS p99_within, true AS p999_within
FROM (SELECT count(DISTINCT user_id) AS n FROM events) WHERE n > 0""")
def sketches_within_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the sketches of keys and quantiles stay within three times their stated error of the exact figures."""
    exact, rough = (A.distinct_keys(event_rows(spark, sf), "account", approximate=a).first()[0] for a in (False, True))
    rows = table(spark, sf, "lineitem").select("l_extendedprice")
    found = approximate(rows, "l_extendedprice").first()
    value, bounds = F.col("l_extendedprice"), []
    for name, q in LATENCY_QUANTILES.items():
        # the rank of the sketch's value, as the range of ranks its equals take
        below, upto = F.count_if(value < found[name]), F.count_if(value <= found[name])
        slack = 1 + 3 * F.count(F.lit(1)) / 10_000
        bounds.append(((below <= q * F.count(F.lit(1)) + slack) & (upto >= q * F.count(F.lit(1)) - slack)).alias(f"{name}_within"))
    return rows.agg(F.lit(abs(rough - exact) <= 3 * 0.05 * exact).alias("keys_within"), *bounds)


@query("quantile_sketch")
def quantile_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return approximate(table(spark, sf, "lineitem"), "l_extendedprice")
