import json
import os

import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from pacewise.schema import TRANSACTIONS, conform, publish
from pacewise.sources import arrow_stream
from pacewise.sources.landing import live_transactions, numbered, read_paysim


def files_of(path):
    return sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(arrow_stream.SUFFIX))


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "stream")


def test_round_trip_in_full_batches(spark, rows, path):
    assert arrow_stream.write(rows.repartition(3), path, batch_size=100) == rows.count()
    assert same(arrow_stream.read(spark, path), rows)
    for file in files_of(path):
        sizes = [b.num_rows for b in pa.ipc.open_stream(file)]
        assert set(sizes[:-1]) <= {100} and 0 < sizes[-1] <= 100


@pytest.mark.parametrize("width", ["1500", "5000", "1000000"])
def test_splits_cover_each_batch_once(spark, rows, path, width):
    arrow_stream.write(rows.coalesce(1), path, batch_size=64)
    assert same(arrow_stream.read(spark, path, split_bytes=width), rows)


def test_a_file_of_another_writer(spark, tmp_path):
    schema = pa.schema([("account", pa.int64()), ("merchant", pa.string()),
                        ("code", pa.dictionary(pa.int8(), pa.string()))])
    file = str(tmp_path / "other.arrows")
    with pa.ipc.new_stream(file, schema) as out:
        for start in (0, 10, 20):
            out.write_table(pa.table({
                "account": list(range(start, start + 10)), "merchant": ["m", None] * 5,
                "code": pa.array(["x", "y"] * 5).dictionary_encode().cast(schema.field("code").type)}, schema))
    plain = arrow_stream.read(spark, file, split_bytes="400").orderBy("account").collect()
    assert [r.account for r in plain] == list(range(30)) and plain[1].merchant is None
    assert {r.code for r in plain} == {"x", "y"}


def test_append_and_overwrite(spark, rows, path):
    arrow_stream.write(rows, path)
    assert arrow_stream.write(rows, path) == rows.count()
    assert arrow_stream.read(spark, path).count() == 2 * rows.count()
    arrow_stream.write(rows.limit(7), path, mode="overwrite")
    assert arrow_stream.read(spark, path).count() == 7
    assert not [f for f in os.listdir(path) if f.startswith("_staging")]


def test_failed_write_leaves_nothing(spark, rows, path):
    bad = rows.selectExpr("seq", "IF(seq = 500, raise_error('stop'), 1) AS x")
    with pytest.raises(Exception, match="stop"):
        arrow_stream.write(bad, path)
    assert not os.path.exists(path) or files_of(path) == []


def test_no_rows(spark, rows, path):
    assert arrow_stream.write(rows.where("seq < 0"), path) == 0
    assert arrow_stream.read(spark, path).count() == 0


def test_arguments(spark, rows, path):
    with pytest.raises(Exception, match="batch_size"):
        arrow_stream.write(rows, path, batch_size=0)
    with pytest.raises(Exception, match="no Arrow stream file"):
        arrow_stream.read(spark, path)


def test_files_as_a_stream(spark, rows, path, tmp_path):
    arrow_stream.register(spark)
    arrow_stream.write(rows.repartition(4), path)

    def take():
        stream = spark.readStream.format("arrow_stream").option("files_per_trigger", "2").option("progress", str(tmp_path / "p")).load(path)
        query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
                 .trigger(processingTime="0 seconds").start(str(tmp_path / "out")))
        query.processAllAvailable()
        query.stop()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    batches = take()
    assert len(batches) == 2 and sum(batches) == rows.count()
    assert same(spark.read.parquet(str(tmp_path / "out")), rows)


def test_intake_is_bounded_and_complete(spark, rows, tmp_path):
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = live_transactions(spark, str(tmp_path / "in"), files_per_trigger=2)
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_paysim_layout(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,"
        "isFraud,isFlaggedFraud\n"
        "1,PAYMENT,9839.64,C1231006815,170136.0,160296.36,M1979787155,0.0,0.0,0,0\n"
        "1,TRANSFER,181.0,C1305486145,181.0,0.0,C553264065,0.0,0.0,1,0\n")
    got = read_paysim(spark, str(tmp_path / "p.csv")).orderBy("seq").collect()
    assert [(r.account, r.step, r.amount, r.isFraud, r.merchant) for r in got] == [
        (1231006815, 1, 9839.64, 0, "M1979787155"), (1305486145, 1, 181.0, 1, "C553264065")]


def test_numbered(spark, rows):
    gapped = rows.withColumn("seq", rows["seq"] * 7 + 3)
    assert same(numbered(gapped).select("account", "seq"), rows.select("account", "seq"))


def test_publish(spark, rows):
    assert publish(rows, "rows_view").count() == rows.count()
    assert conform(spark.table("rows_view"), schema=TRANSACTIONS).columns == TRANSACTIONS.names


@pytest.mark.parametrize("limit", [None, "1"])
def test_stream_takes_appended_files_once(spark, rows, path, tmp_path, limit):
    """Appends between runs, with names in any order and a restart after each."""
    def take():
        stream = arrow_stream.follow(spark, path, **({"files_per_trigger": limit, "progress": str(tmp_path / "p")} if limit else {}))
        query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
                 .trigger(processingTime="0 seconds").start(str(tmp_path / "out")))
        query.processAllAvailable()
        query.stop()

    for part in range(4):
        arrow_stream.write(rows.where(f"seq % 5 = {part}").repartition(2), path)
        take()
    extra = str(tmp_path / "extra")
    arrow_stream.write(rows.where("seq % 5 = 4").coalesce(1), extra)
    os.rename(files_of(extra)[0], f"{path}/aaa-sorts-first{arrow_stream.SUFFIX}")
    take()
    take()
    assert same(spark.read.parquet(str(tmp_path / "out")), rows)


def test_a_file_moved_in_late_is_taken(spark, rows, path, tmp_path):
    slow = str(tmp_path / "slow")
    arrow_stream.write(rows.where("seq < 100").coalesce(1), slow)
    os.utime(files_of(slow)[0], (1, os.path.getmtime(files_of(slow)[0]) - 600))
    for step in range(2):
        if step:
            os.rename(files_of(slow)[0], f"{path}/late{arrow_stream.SUFFIX}")
        else:
            arrow_stream.write(rows.where("seq >= 100"), path)
        (arrow_stream.follow(spark, path).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination())
    assert same(spark.read.parquet(str(tmp_path / "out")), rows)


def test_a_manifest_knows_no_grace(spark, rows, path, tmp_path):
    """A file moved in two days after its time is taken, offsets keep their size, and a restart goes on."""
    def take():
        (arrow_stream.follow(spark, path, progress=str(tmp_path / "p")).writeStream.format("parquet")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination())

    slow = str(tmp_path / "slow")
    arrow_stream.write(rows.where("seq < 100").coalesce(1), slow)
    os.utime(files_of(slow)[0], (1, os.path.getmtime(files_of(slow)[0]) - 2 * 86_400))
    arrow_stream.write(rows.where("seq >= 100"), path)
    take()
    os.rename(files_of(slow)[0], f"{path}/late{arrow_stream.SUFFIX}")
    take()
    take()
    assert same(spark.read.parquet(str(tmp_path / "out")), rows)
    offsets = [open(tmp_path / "c" / "offsets" / n).read().splitlines()[-1] for n in ("0", "1")]
    assert [set(json.loads(o)) for o in offsets] == [{"taken"}] * 2


def follower(path, progress, **options):
    return arrow_stream.ManifestFollower(StructType([]), {"path": path, "progress": progress, **options})


def test_the_manifest_after_a_crash(spark, rows, path, tmp_path):
    """Files noted but never planned come first after a restart, and count against the limit."""
    arrow_stream.write(rows.repartition(5), path)
    progress = str(tmp_path / "p")
    options = {"files_per_trigger": "2"}
    first = follower(path, progress, **options)
    assert first.latestOffset() == {"taken": 2} == first.latestOffset()
    lost = follower(path, progress, **options)  # the first one ended before it planned
    assert lost.latestOffset() == {"taken": 2}
    planned = lost.partitions({"taken": 0}, {"taken": 2})
    assert lost.latestOffset() == {"taken": 4}
    again = follower(path, progress, **options)
    assert again.partitions({"taken": 0}, {"taken": 2}) == planned
    assert again.latestOffset() == {"taken": 4}
    rest = again.partitions({"taken": 2}, {"taken": 4})
    assert again.latestOffset() == {"taken": 5}
    last = again.partitions({"taken": 4}, {"taken": 5})
    assert sorted(s.path for s in planned + rest + last) == files_of(path)
    with pytest.raises(ValueError, match="not of this stream"):
        follower(path, str(tmp_path / "other")).partitions({"taken": 0}, {"taken": 5})


def test_entries_of_a_manifest_are_joined(tmp_path):
    log = arrow_stream.Manifest(str(tmp_path))
    for i in range(100):
        log.append([(f"/f{i}-{j}", j) for j in range(1 + i % 3)])
    assert len(os.listdir(tmp_path)) <= arrow_stream.Manifest.ENTRIES + 1
    read = arrow_stream.Manifest(str(tmp_path))
    assert read.files == [(f"/f{i}-{j}", j) for i in range(100) for j in range(1 + i % 3)] == log.files
    # an entry that a joined one already covers, left by a crash before it was deleted
    (tmp_path / "000000000003-000000000004.json").write_text('{"first": 3, "files": [["/f2-0", 0]]}')
    assert arrow_stream.Manifest(str(tmp_path)).files == log.files


def test_paysim_order_over_files_of_uneven_size(spark, tmp_path):
    head = ("step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,"
            "isFraud,isFlaggedFraud\n")
    sizes = {"part-0.csv": 3, "part-1.csv": 50_000, "part-2.csv": 10}
    count = 0
    for name, size in sizes.items():
        lines = [f"1,PAYMENT,1.0,C{count + i},0.0,0.0,M1,0.0,0.0,0,0\n" for i in range(size)]
        (tmp_path / name).write_text(head + "".join(lines))
        count += size
    width = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        got = read_paysim(spark, str(tmp_path))
        assert got.where("seq <> account").isEmpty() and got.count() == count
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", width)


def test_paysim_files_are_bounded_and_in_order(spark, sf_dir, tmp_path, monkeypatch):
    from pacewise.plans import tables

    monkeypatch.setattr(tables, "FILE_ROWS", 200, raising=False)
    monkeypatch.setattr(tables, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    got = tables.paysim_csv_rows(spark, sf_dir)
    total = got.count()
    files = spark.read.option("recursiveFileLookup", "true").csv(str(tmp_path / "paysim"), header=True)
    assert files.groupBy("_metadata.file_path").count().agg({"count": "max"}).first()[0] < total // 3
    want = [r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey").select("o_custkey").collect()]
    assert [r.account for r in got.orderBy("seq").collect()] == want


# --- index of record batches -------------------------------------------------------

from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual  # noqa: E402


def reader_of(spark, path, filters=(), width="4000"):
    """A reader as the planner makes it, and how many batches it reads for these filters."""
    schema = arrow_stream.read(spark, path).schema
    reader = arrow_stream.FilteringReader(schema, {"path": path, "split_bytes": width})
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return [b for split in reader.partitions() for b in reader.read(split)]


def test_batches_are_found_without_stepping(spark, rows, path, monkeypatch):
    arrow_stream.write(rows.coalesce(1), path, batch_size=64)
    monkeypatch.setattr(arrow_stream, "_message_length", None)  # a walk over headers would fail
    batches = reader_of(spark, path)
    assert len(batches) == -(-rows.count() // 64) and sum(b.num_rows for b in batches) == rows.count()


def test_batches_that_cannot_match_are_skipped(spark, rows, path):
    arrow_stream.write(rows.coalesce(1).sortWithinPartitions("seq"), path, batch_size=50)
    every = reader_of(spark, path)
    few = reader_of(spark, path, [GreaterThan(("seq",), 900), LessThanOrEqual(("seq",), 950)])
    assert len(few) <= 2 < len(every) == 20
    assert {s for b in few for s in b.column("seq").to_pylist()} >= set(range(901, 951))
    assert len(reader_of(spark, path, [In(("seq",), (3, 4, 777))])) == 2
    assert reader_of(spark, path, [EqualTo(("merchant",), "zzz")]) == []
    assert len(reader_of(spark, path, [EqualTo(("nested", "x"), 1)])) == 20


def test_filters_reach_the_source(spark, rows, path):
    arrow_stream.write(rows.repartitionByRange(2, "seq"), path, batch_size=50)
    spark.conf.set(arrow_stream.PUSHDOWN, "true")
    try:
        got = arrow_stream.read(spark, path).where("seq > 800 and account in (1, 2, 3) and amount < 100")
        assert same(got, rows.where("seq > 800 and account in (1, 2, 3) and amount < 100"))
        assert arrow_stream.read(spark, path).where("seq < 0").count() == 0
    finally:
        spark.conf.unset(arrow_stream.PUSHDOWN)


def test_values_without_order(spark, tmp_path):
    """NaN is larger than any number, nulls match nothing."""
    file = str(tmp_path / "odd.arrows")
    schema = pa.schema([("x", pa.float64()), ("i", pa.int32())])
    with pa.ipc.new_stream(file, schema) as out:
        for xs in ([1.0, 2.0], [float("nan"), 1.0], [None, None], [float("nan")] * 2):
            out.write_table(pa.table({"x": xs, "i": [1, None]}, schema))
    assert arrow_stream.build_index(spark, str(tmp_path)) == 1 and arrow_stream.build_index(spark, str(tmp_path)) == 0
    assert len(reader_of(spark, file, [GreaterThan(("x",), 5.0)])) == 2
    assert len(reader_of(spark, file, [LessThanOrEqual(("x",), 1.5)])) == 2
    assert len(reader_of(spark, file, [EqualTo(("x",), float("nan"))])) == 3
    assert len(reader_of(spark, file, [EqualTo(("i",), 1)])) == 4 and reader_of(spark, file, [EqualTo(("i",), 2)]) == []


def test_dictionary_files_are_split(spark, tmp_path):
    """Batches far into a dictionary-coded file, with dictionaries that are replaced on the way."""
    file = str(tmp_path / "coded.arrows")
    schema = pa.schema([("account", pa.int64()), ("code", pa.dictionary(pa.int8(), pa.string()))])
    with pa.ipc.new_stream(file, schema) as out:
        for k in range(12):
            codes = pa.array([f"x{k // 3}", f"y{k // 3}"] * 5).dictionary_encode().cast(schema.field("code").type)
            out.write_batch(pa.record_batch([pa.array(range(10 * k, 10 * k + 10)), codes], schema=schema))
    want = sorted((r.account, r.code) for r in arrow_stream.read(spark, file).collect())
    assert arrow_stream.build_index(spark, file) == 1
    reader = arrow_stream.ArrowStreamReader(arrow_stream.read(spark, file).schema, {"path": file, "split_bytes": "700"})
    parts = [[b.to_pylist() for b in reader.read(split)] for split in reader.partitions()]
    assert sum(bool(p) for p in parts) >= 3
    assert sorted((r["account"], r["code"]) for p in parts for b in p for r in b) == want


def test_an_index_of_other_content_is_not_used(spark, rows, path):
    arrow_stream.write(rows.coalesce(1), path, batch_size=64)
    file = files_of(path)[0]
    with open(file, "rb") as source:
        kept = pa.ipc.open_stream(source.read()).read_all().slice(0, 70)
    with pa.ipc.new_stream(file, kept.schema) as out:
        out.write_table(kept)
    assert arrow_stream.read(spark, path).count() == 70
    assert arrow_stream.build_index(spark, path) == 1 and sum(b.num_rows for b in reader_of(spark, path)) == 70


def test_the_sink_and_the_builder_agree(spark, rows, path):
    import pyarrow.parquet as pq

    arrow_stream.write(rows.coalesce(1), path, batch_size=64)
    index = arrow_stream.index_path(files_of(path)[0])
    written = pq.read_table(index)
    os.remove(index)
    assert arrow_stream.build_index(spark, path) == 1
    assert pq.read_table(index).equals(written) and written.num_rows == -(-rows.count() // 64)
