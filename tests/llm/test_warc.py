"""Packages: exact round trips, ZIP64 directories, range reads."""

import gzip
import io
import zipfile

import pytest

from pacewise.llm import warc
from pacewise.llm.warc import Package, PackageReader, parsed, record

SCHEMA = "page_id long, url string, html string, size string, first string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def test_round_trip(spark):
    rows = [(5, "http://a/1", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://a/2", None), (2, "http://x y\r\n", ""), (8, "u", "b" * 300_000),
            (7, "u", "b" * 300_000), (6, "u", "lines\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "<p>é</p>"), (3, None, "<p>é</p>")]
    got = {}
    for r in warc.round_trip(made(spark, rows)).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    first = {5: 3, 9: 2, 8: 7}
    for page, raw in payload.items():
        kind = "revisit" if page in first else "response"
        want = (len(raw), warc.digest_of(raw), kind, first.get(page))
        assert got[page] == [want] * (2 if page == 3 else 1)
    assert warc.round_trip(made(spark, [])).collect() == []


def test_content_comes_back(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 50)) for i in range(200)]
    packages = warc.write_packages(made(spark, rows))
    back = {r.page_id: r for r in warc.read_packages(packages).collect()}
    first = {}
    for i, url, html in rows:
        first.setdefault(html, i)
        assert back[i].url == url
        assert back[i].payload is None if first[html] != i else bytes(back[i].payload) == html.encode()
    assert sum(r.records for r in packages.collect()) == 200


def test_small_packages_and_ranges(spark, monkeypatch):
    rows = [(i, "u", f"{i} " * 2000) for i in range(60)]
    table = made(spark, rows)
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 10_000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 3000)
    assert {r.page_id for r in warc.round_trip(table).collect()} == set(range(60))


def package(n=3):
    made = Package()
    for i in range(n):
        made.add(record(i, f"u{i}", b"payload %d" % i, None), {"url": f"u{i}"})
    return made.content()


def test_directory_with_comment_and_zip64(monkeypatch):
    raw = package()
    plain = [(m.name, m.header, m.size) for m in PackageReader(io.BytesIO(raw), len(raw)).directory()]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    wide = package()
    assert b"PK\6\6" in wide and b"PK\6\6" not in raw
    reader = PackageReader(io.BytesIO(wide), len(wide))
    assert [(m.name, m.size) for m in reader.directory()] == [(n, s) for n, _, s in plain]
    for start, length in reader.ranges():
        assert parsed(gzip.decompress(wide[start:start + length]))["record_type"] == "response"
    out = io.BytesIO(raw)
    with zipfile.ZipFile(out, "a") as z:
        z.comment = b"a comment"
    again = out.getvalue()
    assert len(list(PackageReader(io.BytesIO(again), len(again)).ranges())) == 3


def test_only_ranges_are_read():
    raw = package(200)

    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            self.total += n
            return super().read(n)

    source = Counting(raw + b"")
    found = list(PackageReader(source, len(raw)).ranges())
    before = source.total
    reader = PackageReader(source, len(raw))
    start, length = found[137]
    assert parsed(gzip.decompress(reader.range(start, length)))["page_id"] == 137 and source.total - before == length


def test_broken_packages():
    with pytest.raises(ValueError):
        PackageReader(io.BytesIO(b"no zip"), 6).directory()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("indexes/index.cdxj", "x" * 100)
    with pytest.raises(ValueError, match="not stored"):
        list(PackageReader(out, len(out.getvalue())).ranges())
    bad = record(1, None, b"abc", None).replace(b"abc", b"abd")
    with pytest.raises(ValueError, match="digest"):
        parsed(bad)


def test_the_read_is_spread(spark):
    """Names and offsets are small, so the number of tasks must not follow the bytes that are shuffled."""
    rows = [(i, f"u{i}", f"<p>{i}</p>" * (i % 50)) for i in range(3000)]
    records = warc.read_packages(warc.write_packages(made(spark, rows)))
    assert records.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert records.count() == 3000


def test_schemes():
    assert warc._located("file:/tmp/x") == warc._located("file:///tmp/x")
    assert warc._located("s3a://b/k?region=x")[1] == "b/k" and warc._located("s3a://b/k?region=x")[0].type_name == "s3"


def test_as_many_members_as_16_bits_count():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", allowZip64=True) as z:
        z.writestr("a", b"x")
    raw = out.getvalue()
    end = raw.rfind(b"PK\5\6")
    entry = raw[raw.find(b"PK\1\2"):end]
    directory = entry * 65_535
    full = raw[:raw.find(b"PK\1\2")] + directory + raw[end:end + 8] + b"\xff\xff\xff\xff" + len(directory).to_bytes(4, "little") + raw[end + 16:]
    assert len(PackageReader(io.BytesIO(full), len(full)).directory()) == 65_535
