"""Arrow IPC stream files as a Spark source, sink and stream.

``spark.read.format("arrow_stream").load(path)`` after :func:`register`. Large
files are split: a split holds the record batches that start inside it.

The sink leaves an index beside each file, in ``_index``: where every message lies, its rows, and the least
and greatest value per column. A task that reads a split takes the places of its batches from there,
skips those that no row of can meet the filters, and reads nothing else; batches of dictionary-coded files
come with the dictionaries before them. :func:`build_index` adds the index to files of other writers, one
task a file. A file without one is read by stepping over message headers from its start.

Filters reach the source if ``spark.sql.python.filterPushdown.enabled`` is set; Spark applies them to the rows in any case.
"""

from __future__ import annotations

import io
import json
import math
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter,
                                    GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
                                    WriterCommitMessage)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

FORMAT = "arrow_stream"
SUFFIX = ".arrows"
SUMMARY = "_SUCCESS"
INDEX = "_index"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

# Rows per record batch on writing, unless the option ``batch_size`` says otherwise.
BATCH_ROWS = 65_536
SPLIT_BYTES = 128 << 20
GRACE_SECONDS = 86_400


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowStreamSource)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    options.setdefault("push_filters", spark.conf.get(PUSHDOWN, "false"))
    return spark.read.format(FORMAT).options(**options).load(qualified(spark, path))


def follow(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The files under ``path`` as a stream; with ``progress``, a folder of this stream alone, by a manifest."""
    register(spark)
    if "progress" in options:
        options["progress"] = qualified(spark, options["progress"])
    return spark.readStream.format(FORMAT).options(**options).load(qualified(spark, path))


def write(df: DataFrame, path: str, batch_size: int = BATCH_ROWS, mode: str = "append") -> int:
    """Write stream files and return the number of rows written."""
    register(df.sparkSession)
    path = qualified(df.sparkSession, path)
    df.write.format(FORMAT).option("batch_size", str(batch_size)).mode(mode).save(path)
    system, root = _open(path)
    with system.open_input_stream(f"{root}/{SUMMARY}") as stream:
        return json.loads(stream.read())["rows"]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the cluster's default file system, if it has none."""
    if "://" in path or path.startswith("file:"):
        return path
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///")


def _files(path: str) -> list[pafs.FileInfo]:
    """Stream files under ``path``, or the file itself, ordered by name."""
    system, root = _open(path)
    info = system.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [info]
    found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))

    def hidden(f):
        return any(part[:1] in "_." for part in f.path[len(root):].strip("/").split("/"))

    return sorted((f for f in found if f.type == pafs.FileType.File and not hidden(f)),
                  key=lambda f: f.path)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class ArrowStreamSource(DataSource):
    """Options: ``path``, ``split_bytes``, ``batch_size``, ``push_filters``; of a stream ``progress``, ``files_per_trigger``, ``grace_seconds``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Arrow stream file under {self.options['path']}")
        system, _ = _open(self.options["path"])
        with system.open_input_file(files[0].path) as source:
            return from_arrow_schema(pa.ipc.read_schema(pa.ipc.read_message(source)))

    def reader(self, schema):
        # Spark refuses a reader that takes filters where the setting is off.
        pushes = str(self.options.get("push_filters", "false")).lower() == "true"
        return (FilteringReader if pushes else ArrowStreamReader)(schema, self.options)

    def streamReader(self, schema):
        if "progress" in self.options:
            return ManifestFollower(schema, self.options)
        if int(self.options.get("files_per_trigger", 0)):
            raise ValueError("files_per_trigger needs the option progress, a folder of this stream alone")
        return ArrowStreamFollower(schema, self.options)

    def writer(self, schema, overwrite):
        return ArrowStreamWriter(schema, self.options, overwrite)


def _splits(files: list[pafs.FileInfo], width: int) -> list[Split]:
    return [Split(f.path, start, min(start + width, f.size))
            for f in files for start in range(0, max(f.size, 1), width)]


class ArrowStreamReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.wanted = to_arrow_schema(schema)
        self.path = options["path"]
        self.width = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        return _splits(_files(self.path), self.width)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _read_split(self.path, partition, self.wanted)


class FilteringReader(ArrowStreamReader):
    """Skips record batches whose least and greatest values rule out every row."""

    def __init__(self, schema, options) -> None:
        super().__init__(schema, options)
        self.limits: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, tuple(_LIMITS)) and len(f.attribute) == 1:
                self.limits.append((f.attribute[0], _LIMITS[type(f)], f.value))
            yield f  # a batch that is read may hold other rows too

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _read_split(self.path, partition, self.wanted, self.limits)


class ArrowStreamFollower(DataSourceStreamReader):
    """Each file is read once, oldest first, whatever its name.

    An offset is the newest modification time taken and the names taken in the ``grace`` before it. A file
    is new if it is younger than that, or within the grace and not named, so a file that appears with a smaller name or
    that a slow job moved into place later is still read. One that appears with a time older than the grace
    (a day unless the option ``grace_seconds`` says otherwise) is not; :class:`ManifestFollower` takes these too.
    """

    def __init__(self, schema, options) -> None:
        self.wanted = to_arrow_schema(schema)
        self.path = options["path"]
        self.width = int(options.get("split_bytes", SPLIT_BYTES))
        self.grace = int(float(options.get("grace_seconds", GRACE_SECONDS)) * 1e9)

    def _there(self) -> list[pafs.FileInfo]:
        return sorted(_files(self.path), key=lambda f: (f.mtime_ns, f.path))

    def _has(self, offset: dict, file: pafs.FileInfo) -> bool:
        return file.mtime_ns <= offset["time"] - self.grace or file.path in offset["names"]

    def initialOffset(self) -> dict:
        return {"time": 0, "names": {}}

    def latestOffset(self) -> dict:
        files = self._there()
        time = max([0, *(f.mtime_ns for f in files)])
        return {"time": time, "names": {f.path: f.mtime_ns for f in files if f.mtime_ns > time - self.grace}}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return _splits([f for f in self._there() if self._has(end, f) and not self._has(start, f)], self.width)

    def commit(self, end: dict) -> None:
        """Nothing to release: files stay where they are."""

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _read_split(self.path, partition, self.wanted)


class ManifestFollower(DataSourceStreamReader):
    """Each file is read once, whatever its name and time, by a manifest in the folder ``progress``.

    The manifest lists the files taken, in the order in which they were taken, and is only appended to: an entry
    ``<first>-<end>.json`` holds the files of these numbers. An offset is the number of files taken, so its size does
    not grow, and a batch is a range of numbers, the same after any restart. The folder belongs to one stream, as its
    checkpoint does; a new stream needs a new one. ``files_per_trigger`` bounds a micro-batch.
    """

    def __init__(self, schema, options) -> None:
        self.wanted = to_arrow_schema(schema)
        self.path, self.progress = options["path"], options["progress"]
        self.width = int(options.get("split_bytes", SPLIT_BYTES))
        self.limit = int(options.get("files_per_trigger", 0))
        self.manifest: Manifest | None = None
        self.planned: int | None = None  # files that a micro-batch was planned for

    def _manifest(self) -> Manifest:
        if self.manifest is None:
            self.manifest = Manifest(self.progress)
            self.planned = self.manifest.planned()
        return self.manifest

    def initialOffset(self) -> dict:
        return {"taken": 0}

    def latestOffset(self) -> dict:
        manifest = self._manifest()
        new = sorted((f for f in _files(self.path) if f.path not in manifest.names), key=lambda f: (f.mtime_ns, f.path))
        # what was taken but not planned, before a crash, comes first
        room = max(0, self.limit - (len(manifest.files) - self.planned)) if self.limit else len(new)
        manifest.append([(f.path, f.size) for f in new[:room]])
        return {"taken": len(manifest.files)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        manifest = self._manifest()
        if end["taken"] > len(manifest.files):
            raise ValueError(f"{self.progress} lists {len(manifest.files)} files, the checkpoint {end['taken']}: not of this stream")
        if end["taken"] > self.planned:
            self.planned = end["taken"]
            manifest.note_planned(self.planned)
        return [Split(name, at, min(at + self.width, size)) for name, size in manifest.files[start["taken"]:end["taken"]]
                for at in range(0, max(size, 1), self.width)]

    def commit(self, end: dict) -> None:
        """Nothing to release: files stay where they are."""

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _read_split(self.path, partition, self.wanted)


class Manifest:
    """Numbered names and sizes of the files a stream took. Entries are joined into one when there are many."""

    ENTRIES = 32

    def __init__(self, folder: str) -> None:
        self.system, self.root = _open(folder)
        self.files: list[tuple[str, int]] = []
        for first, end, path in self._entries():
            if first > len(self.files):
                raise ValueError(f"an entry of the manifest before {path} is missing")
            if end > len(self.files):  # entries that a joined one covers say nothing new
                with self.system.open_input_stream(path) as source:
                    entry = json.loads(source.read())
                self.files += [tuple(f) for f in entry["files"][len(self.files) - entry["first"]:]]
        self.names = {name for name, _ in self.files}

    def _entries(self) -> list[tuple[int, int, str]]:
        found = self.system.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        bounds = [(re.fullmatch(r"(\d+)-(\d+)\.json", f.base_name), f.path) for f in found]
        # of entries with one beginning the longest first
        return sorted(((int(m[1]), int(m[2]), path) for m, path in bounds if m), key=lambda e: (e[0], -e[1]))

    def _put(self, name: str, content: dict) -> None:
        self.system.create_dir(self.root, recursive=True)
        with self.system.open_output_stream(f"{self.root}/_{name}") as sink:
            sink.write(json.dumps(content).encode())
        self.system.move(f"{self.root}/_{name}", f"{self.root}/{name}")

    def append(self, files: list[tuple[str, int]]) -> None:
        if not files:
            return
        first, end = len(self.files), len(self.files) + len(files)
        self._put(f"{first:012}-{end:012}.json", {"first": first, "files": files})
        self.files += files
        self.names |= {name for name, _ in files}
        entries = self._entries()
        if len(entries) > self.ENTRIES:
            self._put(f"{0:012}-{len(self.files):012}.json", {"first": 0, "files": self.files})
            for first, end, path in entries:
                if (first, end) != (0, len(self.files)):
                    self.system.delete_file(path)

    def planned(self) -> int:
        path = f"{self.root}/planned.json"
        if self.system.get_file_info(path).type != pafs.FileType.File:
            return 0
        with self.system.open_input_stream(path) as source:
            return json.loads(source.read())["files"]

    def note_planned(self, files: int) -> None:
        self._put("planned.json", {"files": files})


# --- index ----------------------------------------------------------------------

_LIMITS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


def _is_ordered(kind: pa.DataType) -> bool:
    """Types whose least and greatest values are kept."""
    return (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind)
            or pa.types.is_large_string(kind) or pa.types.is_date32(kind))


def _extent(column: pa.Array) -> tuple:
    """Least and greatest value; a NaN counts as larger than any number, as in Spark. Both null where all is null."""
    if pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
        numbers = column.filter(pc.invert(pc.is_nan(column)))
        return (pc.min_max(numbers)["min"].as_py() if numbers.null_count < len(numbers) else math.inf), math.inf
    found = pc.min_max(column)
    return found["min"].as_py(), found["max"].as_py()


class Index:
    """Rows about the messages of a file while they pass: dictionaries and record batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self.columns = [f for f in schema if _is_ordered(f.type)]
        self.rows: list[tuple] = []

    def dictionary(self, offset: int, length: int) -> None:
        self.rows.append((True, offset, length, 0, *[None] * (2 * len(self.columns))))

    def batch(self, offset: int, length: int, batch: pa.RecordBatch) -> None:
        extents = [v for f in self.columns for v in _extent(batch.column(batch.schema.get_field_index(f.name)))]
        self.rows.append((False, offset, length, batch.num_rows, *extents))

    def table(self, size: int) -> pa.Table:
        fields = [("dictionary", pa.bool_()), ("offset", pa.int64()), ("length", pa.int64()), ("rows", pa.int64())]
        fields += [(f"{which}.{f.name}", f.type) for f in self.columns for which in ("min", "max")]
        columns = [pa.array([r[i] for r in self.rows], kind) for i, (_, kind) in enumerate(fields)]
        return pa.table(columns, pa.schema(fields, {"size": str(size)}))


def index_path(file: str) -> str:
    folder, _, name = file.rpartition("/")
    return f"{folder}/{INDEX}/{name}.parquet"


def _load_index(system: pafs.FileSystem, file: str, size: int) -> pa.Table | None:
    """The index of a file; None if it has none, or one of other content."""
    path = index_path(file)
    if system.get_file_info(path).type != pafs.FileType.File:
        return None
    with system.open_input_file(path) as source:
        index = pq.read_table(source)
    return index if (index.schema.metadata or {}).get(b"size") == str(size).encode() else None


def _can_meet(least, greatest, relation: str, value) -> bool:
    """Whether a value between ``least`` and ``greatest`` may stand in this relation; nulls stand in none."""
    if relation == "in":
        return any(_can_meet(least, greatest, "=", v) for v in value)
    if least is None or value is None:
        return False
    if isinstance(value, float) and math.isnan(value):
        return True
    try:
        return {"=": least <= value <= greatest, ">": greatest >= value if greatest == math.inf else greatest > value,
                ">=": greatest >= value, "<": least < value, "<=": least <= value}[relation]
    except TypeError:  # values of another type: no statement
        return True


def batches_to_read(index: pa.Table, start: int, end: int, limits=()) -> list[int]:
    """Rows of the index: record batches that start in a range of bytes and may hold wanted rows."""
    wanted = [i for i, (d, at) in enumerate(zip(index["dictionary"].to_pylist(), index["offset"].to_pylist()))
              if not d and start <= at < end]
    for column, relation, value in limits:
        if f"min.{column}" in index.column_names:
            least, greatest = index[f"min.{column}"], index[f"max.{column}"]
            wanted = [i for i in wanted if _can_meet(least[i].as_py(), greatest[i].as_py(), relation, value)]
    return wanted


def build_index(spark: SparkSession, path: str) -> int:
    """Index the files under ``path`` that have no index yet, one task a file; the number of files indexed."""
    path = qualified(spark, path)
    system, _ = _open(path)
    missing = [(f.path, f.size) for f in _files(path) if _load_index(system, f.path, f.size) is None]
    if not missing:
        return 0

    def run(batches):
        system, _ = _open(path)
        for batch in batches:
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(file) as source:
                    index = _indexed(source)
                _write_index(system, index_path(file), index, size)
                yield pa.RecordBatch.from_arrays([pa.array([len(index.rows)], pa.int64())], names=["messages"])

    files = spark.createDataFrame(missing, "file string, size long").repartition(len(missing), "file")
    return files.mapInArrow(run, "messages long").count()


def _indexed(source: pa.NativeFile) -> Index:
    """Reads a whole file once, a message at a time."""
    reader = pa.ipc.open_stream(source)
    index, position = Index(reader.schema), 0
    places = []
    while (length := _message_length(source, position)) is not None:
        source.seek(position)
        places.append((pa.ipc.read_message(source).type, position, length))
        position += length
    source.seek(0)
    batches = iter(pa.ipc.open_stream(source))
    for kind, position, length in places:
        if kind == "dictionary":
            index.dictionary(position, length)
        elif kind == "record batch":
            index.batch(position, length, next(batches))
    return index


def _write_index(system: pafs.FileSystem, path: str, index: Index, size: int) -> None:
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex[:12]}"
    with system.open_output_stream(draft) as sink:
        pq.write_table(index.table(size), sink)
    system.move(draft, path)


# --- reading ----------------------------------------------------------------------

class _Messages(io.RawIOBase):
    """Some ranges of a file as one stream, read as they are asked for."""

    def __init__(self, source: pa.NativeFile, ranges: list[tuple[int, int]]) -> None:
        self.source, self.ranges, self.at = source, ranges, 0

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while self.ranges:
            offset, length = self.ranges[0]
            if self.at == length:
                self.ranges, self.at = self.ranges[1:], 0
                continue
            self.source.seek(offset + self.at)
            data = self.source.read(min(len(target), length - self.at))
            target[:len(data)] = data
            self.at += len(data)
            return len(data)
        return 0


def _read_split(path: str, split: Split, wanted: pa.Schema, limits=()) -> Iterator[pa.RecordBatch]:
    """The record batches whose message starts inside the split."""
    system, _ = _open(path)
    with system.open_input_file(split.path) as source:
        index = _load_index(system, split.path, source.size())
        if index is None:
            yield from _stepped(source, split, wanted)
            return
        rows = batches_to_read(index, split.start, split.end, limits)
        if not rows:
            return
        offsets, lengths = index["offset"].to_pylist(), index["length"].to_pylist()
        before = [i for i, d in enumerate(index["dictionary"].to_pylist()) if d and i < rows[-1]]
        ranges = [(0, min(offsets)), *((offsets[i], lengths[i]) for i in sorted([*before, *rows]))]
        for batch in pa.ipc.open_stream(io.BufferedReader(_Messages(source, ranges), 1 << 20)):
            yield _conformed(batch, wanted)


def _stepped(source: pa.NativeFile, split: Split, wanted: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a split of a file without an index, found by the headers of all messages before them."""
    size = source.size()
    schema = pa.ipc.read_schema(pa.ipc.read_message(source))
    if any(pa.types.is_dictionary(f.type) for f in schema):
        # Batches of a dictionary-coded file need what stands before them.
        if split.start == 0:
            source.seek(0)
            for batch in pa.ipc.open_stream(source):
                yield _conformed(batch, wanted)
        return
    position = source.tell()
    while position < min(split.end, size):
        length = _message_length(source, position)
        if length is None:
            return
        if position >= split.start:
            source.seek(position)
            yield _conformed(pa.ipc.read_record_batch(pa.ipc.read_message(source), schema), wanted)
        position += length


def _message_length(source: pa.NativeFile, position: int) -> int | None:
    """Bytes of the message at ``position``; None at the end of the stream.

    Fixed values of the format: a continuation marker of four 0xFF bytes, the length
    of the metadata as a 32-bit integer, then a flatbuffer table whose fourth field
    is the length of the body as a 64-bit integer.
    """
    source.seek(position)
    head = source.read(8)
    if len(head) < 8 or head[:4] != b"\xff\xff\xff\xff":
        return None
    metadata_length = int.from_bytes(head[4:8], "little")
    if metadata_length == 0:
        return None
    metadata = source.read(metadata_length)

    def number(at: int, width: int, signed: bool = False) -> int:
        return int.from_bytes(metadata[at:at + width], "little", signed=signed)

    table = number(0, 4)
    fields = table - number(table, 4, signed=True)
    body_slot = fields + 4 + 2 * 3
    offset = number(body_slot, 2) if number(fields, 2) > body_slot - fields else 0
    body_length = number(table + offset, 8, signed=True) if offset else 0
    return 8 + metadata_length + body_length


def _conformed(batch: pa.RecordBatch, wanted: pa.Schema) -> pa.RecordBatch:
    columns = [batch.column(f.name).cast(f.type) for f in wanted]
    return pa.RecordBatch.from_arrays(columns, schema=wanted)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class ArrowStreamWriter(DataSourceArrowWriter):
    """One file per task, staged apart and moved into place when the job commits.

    A task that is lost or runs twice leaves files in the staging folder only.
    """

    def __init__(self, schema, options, overwrite: bool) -> None:
        self.wanted = to_arrow_schema(schema)
        self.path = options["path"]
        self.overwrite = overwrite
        self.batch_rows = int(options.get("batch_size", BATCH_ROWS))
        if self.batch_rows < 1:
            raise ValueError("batch_size must be positive")
        self.job = uuid.uuid4().hex[:12]

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = _open(self.path)
        system.create_dir(self._staging(root), recursive=True)
        name = f"part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}{SUFFIX}"
        rows = 0
        with system.open_output_stream(f"{self._staging(root)}/{name}") as sink, \
                pa.ipc.new_stream(sink, self.wanted) as out:
            index = Index(self.wanted)
            for batch in _rebatched(iterator, self.wanted, self.batch_rows):
                # the message of the schema is written with the first batch
                begin = sink.tell() or len(self.wanted.serialize())
                out.write_batch(batch)
                index.batch(begin, sink.tell() - begin, batch)
                rows += batch.num_rows
        staged = f"{self._staging(root)}/{name}"
        with system.open_output_stream(f"{staged}.index") as sink:
            pq.write_table(index.table(system.get_file_info(staged).size), sink)
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        done = [m for m in messages if m is not None]
        before = _files(self.path) if self.overwrite else []
        for message in done:
            final = message.name.rsplit("-", 1)[0] + SUFFIX
            if message.rows or message is done[0]:
                system.create_dir(f"{root}/{INDEX}", recursive=True)
                # An index without its file does no harm; a file that appears has its index.
                system.move(f"{self._staging(root)}/{message.name}.index", index_path(f"{root}/{final}"))
                system.move(f"{self._staging(root)}/{message.name}", f"{root}/{final}")
        # The new files are in place before the old ones go; names hold the job, so none is overwritten.
        for old in before:
            system.delete_file(old.path)
            if system.get_file_info(index_path(old.path)).type == pafs.FileType.File:
                system.delete_file(index_path(old.path))
        if system.get_file_info(self._staging(root)).type != pafs.FileType.NotFound:
            system.delete_dir(self._staging(root))
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{SUMMARY}") as sink:
            sink.write(json.dumps({"rows": sum(m.rows for m in done), "files": len(done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        if system.get_file_info(self._staging(root)).type != pafs.FileType.NotFound:
            system.delete_dir(self._staging(root))


def _rebatched(batches: Iterator[pa.RecordBatch], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of exactly ``size``; the last one holds the rest."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        batch = _conformed(batch, schema)
        while count + batch.num_rows >= size:
            need = size - count
            held.append(batch.slice(0, need))
            yield _joined(held, schema)
            held, count, batch = [], 0, batch.slice(need)
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
    if held:
        yield _joined(held, schema)


def _joined(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches, schema).combine_chunks()
    return table.to_batches()[0]
