"""WARC records inside ZIP packages: written by tasks, read back by byte ranges without extraction.

A package holds members stored uncompressed: ``archive/data.warc.gz``, one gzip member per
record, and ``indexes/index.cdxj`` with the offset and length of every record. The
reader looks at the end of a package for the end-of-directory record (and the ZIP64 one where
there is one), reads the central directory, places its stored members, reads the index and
then only the ranges of records. A package is at most a few MB where this module writes it,
but reading splits the records of any package over tasks.

Records with equal payloads are stored once: the one with the least page id is a response, the
others are revisits that refer to it. Equal means equal length and SHA-1.

Packages go to the shared folder of the cluster. A task that runs again writes new files; only
the names in its result are read, so nothing is read twice.

Defined cases. A null html is an empty payload. A null url leaves the target out. A page with a
null id is a response, and nothing refers to it. Rows that repeat the least id are all responses.
Other columns are ignored; without pages there is no package and no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.llm.scale import small_side
from pacewise.session import reliable, shared_dir
from pacewise.sources.arrow_stream import qualified

PACKAGE_BYTES = 8 << 20
RANGE_BYTES = 4 << 20    # of a package that stay together on reading
TASK_BYTES = 64 << 20    # of packages that one task reads, about
LEAST_PAYLOAD = 0        # smaller payloads are never revisits
DATE = "1970-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

_RECORD = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
           "payload binary")


# --- records ---------------------------------------------------------------------------

def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of its payload, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Fields of one record. A response's digest and size come from its payload, a revisit's from its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(name.removeprefix("<urn:page:").rstrip(">")) if name not in (None, "<urn:page:>") else None
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and digest_of(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    size = len(payload) if response else int(
        next(line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "payload_digest": digest, "payload_bytes": size, "refers_to": number(fields.get("WARC-Refers-To")),
            "payload": payload if response else None}


# --- packages --------------------------------------------------------------------------

class Package:
    """A package under construction, in memory."""

    def __init__(self):
        self.data, self.index, self.records = io.BytesIO(), [], 0

    def add(self, raw: bytes, about: dict) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        entry = about | {"offset": self.data.tell(), "length": len(packed), "filename": DATA}
        self.index.append(f"{self.records:012d} {DATE} {json.dumps(entry)}")
        self.data.write(packed)
        self.records += 1

    def content(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            package.writestr(zipfile.ZipInfo(DATA), self.data.getvalue())
            package.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        return out.getvalue()


@dataclass
class Member:
    name: str
    header: int   # offset of the local header
    size: int
    method: int


class PackageReader:
    """Byte ranges of a package's stored members. ``source`` needs ``seek`` and ``read``; ``size`` is its length."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size

    def range(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        got = self.source.read(length)
        if len(got) != length:
            raise ValueError("package ends early")
        return got

    def directory(self) -> list[Member]:
        """Members by the central directory; the ZIP64 records are used where 32 bits do not do."""
        tail_at = max(0, self.size - (22 + 65_535 + 20))
        tail = self.range(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("not a ZIP package")
        count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            locator = tail[max(0, end - 20):end]
            if locator[:4] == b"PK\6\7":
                at, = struct.unpack("<Q", locator[8:16])
                mark, *_, count, length, start = struct.unpack("<4sQHHIIQQQQ", self.range(at, 56))
                if mark != b"PK\6\6":
                    raise ValueError("ZIP64 end of directory is missing")
            elif 0xFFFFFFFF in (length, start):  # 65,535 members alone need no ZIP64 record
                raise ValueError("ZIP64 locator is missing")
        return list(self._entries(self.range(start, length), count))

    @staticmethod
    def _entries(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if raw[at:at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, = struct.unpack("<H", raw[at + 10:at + 12])
            packed, size, name, extra, comment = struct.unpack("<IIHHH", raw[at + 20:at + 34])
            header, = struct.unpack("<I", raw[at + 42:at + 46])
            title = raw[at + 46:at + 46 + name].decode()
            more, end = at + 46 + name, at + 46 + name + extra
            while more + 4 <= end:
                kind, wide = struct.unpack("<HH", raw[more:more + 4])
                if kind == 1:  # 64-bit values, only of the fields that are full
                    values = iter(struct.unpack(f"<{wide // 8}Q", raw[more + 4:more + 4 + wide // 8 * 8]))
                    size = next(values) if size == 0xFFFFFFFF else size
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    header = next(values) if header == 0xFFFFFFFF else header
                more += 4 + wide
            yield Member(title, header, size, method)
            at = end + comment

    def place(self, member: Member) -> int:
        """Where a stored member's bytes begin."""
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{member.name} is not stored")
        head = self.range(member.header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("broken local header")
        name, extra = struct.unpack("<HH", head[26:30])
        return member.header + 30 + name + extra

    def ranges(self) -> Iterator[tuple[int, int]]:
        """Offset in the package and length of every indexed record."""
        members = {m.name: m for m in self.directory()}
        places: dict[str, int] = {}
        for name, member in members.items():
            if name.startswith("indexes/") and name.endswith(".cdxj"):
                for line in self.range(self.place(member), member.size).decode().splitlines():
                    entry = json.loads(line.split(" ", 2)[2])
                    file = entry["filename"]
                    if file not in places:
                        places[file] = self.place(members[file])
                    yield places[file] + entry["offset"], entry["length"]


# --- Spark -----------------------------------------------------------------------------

def decided(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Pages with ``refers_to``: null for a response, the response's id for a revisit."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", F.col("html"), F.sha1(payload).alias("h"), F.octet_length(payload).alias("size"))
    first = (keyed.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("h", "size")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    first = reliable(first.drop("copies"))
    return (keyed.join(small_side(first, 96), ["h", "size"], "left")
            .select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to")))


def _writer(folder: str):
    def run(batches):
        files, root = _located(folder)
        files.create_dir(root, recursive=True)
        package = Package()

        def closed():
            name = f"{root}/part-{uuid.uuid4().hex}.wacz"
            content = package.content()
            with files.open_output_stream(name) as out:
                out.write(content)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([len(content)], pa.int64()), pa.array([package.records], pa.int64())],
                names=["package", "bytes", "records"])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i) for i in range(4))):
                page, url, refers = page.as_py(), url.as_py(), refers.as_py()
                raw = record(page, url, (html.as_py() or "").encode(), refers)
                package.add(raw, {"url": url, "mime": "text/html", "status": "200"})
                if package.data.tell() > PACKAGE_BYTES:
                    yield closed()
                    package = Package()
        if package.records:
            yield closed()
    return run


def write_packages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages (page_id, url, html)`` and return ``(package, bytes, records)``, one row per package."""
    folder = qualified(pages.sparkSession, folder or shared_dir(pages.sparkSession, "packages"))
    return reliable(decided(pages).mapInArrow(_writer(folder), "package string, bytes long, records long"))


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name of a qualified path; the schemes of object stores in Hadoop's spelling too."""
    scheme, colon, rest = path.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + ("//" + rest if rest[:1] == "/" != rest[1:2] else rest))


def _opened(path: str):
    files, name = _located(path)
    return files.open_input_file(name)


def _ranges(batches):
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with _opened(path) as source:
                found = list(PackageReader(source, size).ranges())
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()),
                                              pa.array([f[1] for f in found], pa.int64())], names=["package", "start", "length"])


def _records(batches):
    names = [f.split()[0] for f in _RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    source = path = None
    try:
        for batch in batches:
            rows, held = [], 0
            for name, start, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if name != path:
                    if source is not None:
                        source.close()
                    source, path = _opened(name), name
                source.seek(start)
                rows.append(parsed(gzip.decompress(source.read(length))))
                held += len(rows[-1]["payload"] or b"")
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)
    finally:
        if source is not None:
            source.close()


def read_packages(packages: DataFrame) -> DataFrame:
    """Records of the packages of ``(package, bytes)``, each read by its range.

    The number of tasks follows the bytes of the packages, since the ranges that are shuffled say nothing about them.
    """
    spark = packages.sparkSession
    ranges = packages.select("package", "bytes").mapInArrow(_ranges, "package string, start long, length long")
    total = packages.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    # the records of one stretch of a package stay together and in order
    spread = (ranges.withColumn("stretch", F.expr(f"start div {RANGE_BYTES}")).repartition(tasks, "package", "stretch")
              .sortWithinPartitions("package", "start").select("package", "start", "length"))
    return spread.mapInArrow(_records, _RECORD)


def packages_in(spark: SparkSession, folder: str) -> DataFrame:
    """``(package, bytes)`` of the packages below a folder."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder)
            .select(F.col("path").alias("package"), F.col("length").alias("bytes")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, read the packages back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    return read_packages(write_packages(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
