from pyspark.sql import functions as F

from pacewise.operators.compare import (compare_within, feature_fingerprint, fingerprint, row_differences,
                                        same_fingerprint)
from pacewise.operators.velocity import features


def test_fingerprint_sees_order_and_content(rows):
    columns = [F.col("seq"), F.col("account"), F.col("amount")]
    base = fingerprint(rows, columns)
    assert same_fingerprint(base, fingerprint(rows.repartition(6), columns)).first().identical
    moved = rows.withColumn("seq", F.col("seq") + F.when(F.col("seq") == 3, 10 ** 6).otherwise(0))
    assert not same_fingerprint(base, fingerprint(moved, columns)).first().identical
    doubled = same_fingerprint(base, fingerprint(rows.union(rows), columns)).first()
    assert not doubled.identical and doubled.rows_b == 2 * doubled.rows_a


def test_fingerprint_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    a, b = (fingerprint(df.where(c), [F.col("t")]) for c in ("t IS NULL", "t = ''"))
    assert not same_fingerprint(a, b).first().identical


def test_fingerprint_of_nothing(rows):
    assert tuple(feature_fingerprint(features(rows.where("seq < 0"))).first()) == (0, 0, 0)


def test_row_differences_keep_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    b = spark.createDataFrame([(1,), (3,)], "v int")
    assert sorted(tuple(r) for r in row_differences(a, b).collect()) == [(1, "a"), (2, "a"), (3, "b")]


def test_tolerance(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None), (4, 5.0), (6, 0.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-10), (2, 1.1), (3, None), (5, 5.0), (6, 1e-12)], "k int, v double")
    row = compare_within(a, b, "k", ["v"]).first()
    assert (row["keys"], row.only_a, row.only_b, row.off_v) == (6, 1, 1, 2)
    # A floor of one bounds small numbers absolutely.
    assert compare_within(a, b, "k", ["v"], floor=1.0).first().off_v == 1
