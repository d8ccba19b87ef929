"""Run registered queries next to their SQL in DuckDB and compare the values."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal
from glob import glob

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "tinyint": "TINYINT", "decimal(38,0)": "DECIMAL(38,0)", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, connection, name: str, function, sql: str | None, sf_dir: str):
    """``(message, seconds)``; an empty message means equal."""
    begin = time.time()
    df = function(spark, sf_dir)
    got_rows = df.collect()
    seconds = time.time() - begin
    if sql is None:
        return ("" if got_rows else "no rows"), seconds
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", seconds
    types = dict(zip(columns, (str(d[1]) for d in result.description)))
    for field, kind in df.dtypes:
        if types[field] not in (_SAME.get(kind, kind), "NUMBER") and _SAME.get(kind) != types[field]:
            return f"type of {field}: {kind} != {types[field]}", seconds
    expected, got = rows_of(columns, result.fetchall()), rows_of(df.columns, got_rows)
    if expected != got:
        missing, extra = expected - got, got - expected
        return (f"{sum(got.values())} rows, expected {sum(expected.values())}; "
                f"missing {list(missing)[:2]}, extra {list(extra)[:2]}"), seconds
    return "", seconds


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pacewise.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session = local_session("oracle", cores=8, spark__ui__showConsoleProgress="false")
    database = connect(sf)
    oracles, bad = entry.oracle_sql(), 0
    for key, query in entry.queries().items():
        if wanted and key not in wanted:
            continue
        try:
            message, took = compare(session, database, key, query, oracles.get(key), sf)
        except Exception as error:  # noqa: BLE001
            message, took = f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += bool(message)
        state = "FAIL" if message else ("ok" if key in oracles else "rows")
        print(f"{state:5} {took:7.2f}s {key} {message}", flush=True)
    print(f"{bad} failed")
