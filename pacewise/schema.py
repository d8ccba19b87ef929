"""The canonical transaction table and the step that conforms other tables to it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("account", T.LongType(), False),
    T.StructField("step", T.IntegerType(), False),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("isFraud", T.ByteType(), False),
    T.StructField("merchant", T.StringType(), False),
])

# The stream order of a row. Tables have no order, so it is a column of its own.
SEQ = T.StructField("seq", T.LongType(), False)

SEQUENCED = T.StructType([*TRANSACTIONS.fields, SEQ])

HOUR_SECONDS = 3600
DAY_SECONDS = 86_400

# Events carry no fraud label; a large amount stands in for one.
PROXY_FRAUD_AMOUNT = 150.0


def conform(df: DataFrame, mapping: Mapping[str, Column | str] | None = None,
            schema: T.StructType = SEQUENCED, strict_nulls: bool = False) -> DataFrame:
    """Select the columns of ``schema`` from ``df``, cast to its types, in its order.

    ``mapping`` gives the source of a column where it has another name or must be
    computed. A column that is neither mapped nor present is an error. With
    ``strict_nulls`` a null in a non-nullable column fails the job.
    """
    mapping = dict(mapping or {})
    unknown = set(mapping) - set(schema.names)
    if unknown:
        raise ValueError(f"mapping names columns outside the schema: {sorted(unknown)}")
    missing = [n for n in schema.names if n not in mapping and n not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the source: {missing}")
    columns = []
    for field in schema.fields:
        source = mapping.get(field.name, field.name)
        value = (F.col(source) if isinstance(source, str) else source).cast(field.dataType)
        if strict_nulls and not field.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"null in {field.name}")).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def step_of(ts: Column, unit_seconds: int = HOUR_SECONDS) -> Column:
    """Whole time units since the epoch as an integer.

    ``unix_timestamp`` reads the clock value of a timestamp without time zone as
    it stands, so the result does not depend on the session time zone.
    """
    return F.floor(F.unix_timestamp(ts) / unit_seconds).cast("int")


def text_or_empty(text: Column) -> Column:
    """Null text reads as the empty string."""
    return F.coalesce(text, F.lit(""))


def transactions_from_events(events: DataFrame) -> DataFrame:
    return conform(events, {
        "account": "user_id",
        "step": step_of(F.col("ts")),
        "amount": "value",
        "isFraud": (F.col("value") >= PROXY_FRAUD_AMOUNT).cast("int"),
        "merchant": text_or_empty(F.col("event_type")),
        "seq": "event_id",
    })


def transactions_from_orders(orders: DataFrame) -> DataFrame:
    """Orders as transactions of a customer; the time unit is a day."""
    return conform(orders, {
        "account": "o_custkey",
        "step": step_of(F.col("o_orderdate"), DAY_SECONDS),
        "amount": "o_totalprice",
        "isFraud": (F.col("o_orderpriority") == "1-URGENT").cast("int"),
        "merchant": text_or_empty(F.col("o_orderpriority")),
        "seq": "o_orderkey",
    })


def numeric(df: DataFrame, column: str) -> Column:
    """The column widened to double; a column that is no number is an error."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    kind = df.schema[column].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"column {column!r} has type {kind.simpleString()}, a number is needed")
    return F.col(column).cast("double")


def publish(df: DataFrame, name: str, table: bool = False) -> DataFrame:
    """Make rows available to SQL as a view, or as a saved table."""
    if table:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
