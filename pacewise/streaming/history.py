"""Partials of earlier micro-batches as a log of runs, in hash buckets of the account.

Each batch adds one run: its partials per (account, step), one file per bucket. ``fanout`` runs of one
level merge into one of the next, so a batch meets logarithmically many runs however many batches
there were, and opens only the buckets of its own accounts. What lies before every later row's window is
put out once as evicted and goes with the next merge of its run.

A batch leaves one small mark: the newest step so far, the step before which all is evicted, and the runs that the next batch
may read. It reads only the mark of the batch before it and never changes what that mark
names, so a batch that runs again gives the same result. Folders that a mark no longer names go one batch later.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.operators.velocity import HISTORY_SCHEMA, merge_partials
from pacewise.session import child_names, delete_path, read_text, write_text

BUCKETS = 64
FANOUT = 4

_RUN_SCHEMA = f"{HISTORY_SCHEMA}, run string, bucket int"


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    low: int
    high: int
    rows: int
    buckets: list[int]


@dataclass(frozen=True)
class Mark:
    batch: int
    high: int
    evicted_before: int | None = None
    runs: list[Run] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)


class StepHistory:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fanout: int = FANOUT) -> None:
        self.spark, self.root, self.buckets, self.fanout = spark, root, buckets, fanout

    def bucket_of(self, account: Column) -> Column:
        return F.pmod(F.xxhash64(account), F.lit(self.buckets)).cast("int")

    # --- marks ---------------------------------------------------------------

    def mark(self, before: int | None = None) -> Mark | None:
        """What the last batch, or the last one before a batch, left behind."""
        batches = [int(n.split(".")[0]) for n in child_names(self.spark, f"{self.root}/marks") if n[0].isdigit()]
        batches = [b for b in batches if before is None or b < before]
        if not batches:
            return None
        found = json.loads(read_text(self.spark, f"{self.root}/marks/{max(batches)}.json"))
        return Mark(**{**found, "runs": [Run(**r) for r in found["runs"]]})

    def _leave(self, mark: Mark, earlier: Mark | None) -> None:
        write_text(self.spark, f"{self.root}/marks/{mark.batch}.json", json.dumps(asdict(mark)))
        if earlier is None:
            return
        # The batch before is done for good: what it dropped, and marks older than its own, can go.
        for name in earlier.gone:
            delete_path(self.spark, self._folder(name))
        for name in child_names(self.spark, f"{self.root}/marks"):
            if name[0].isdigit() and int(name.split(".")[0]) < earlier.batch:
                delete_path(self.spark, f"{self.root}/marks/{name}")

    # --- runs ----------------------------------------------------------------

    def _folder(self, name: str) -> str:
        return f"{self.root}/runs/run={name}"

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], _RUN_SCHEMA)
        return self.spark.read.schema(_RUN_SCHEMA).option("basePath", f"{self.root}/runs").parquet(*paths)

    def _write(self, name: str, level: int, partials: DataFrame) -> Run | None:
        (partials.withColumn("bucket", self.bucket_of(F.col("account"))).repartition("bucket")
         .sortWithinPartitions("bucket", "account", "step").write.partitionBy("bucket").mode("overwrite").parquet(self._folder(name)))
        row = self._read([self._folder(name)]).agg(F.min("step"), F.max("step"), F.count(F.lit(1)), F.sort_array(F.collect_set("bucket"))).first()
        return Run(name, level, *row) if row[2] else None

    def _merged(self, name: str, runs: list[Run], keep_from: int | None) -> Run | None:
        held = self._read([self._folder(r.name) for r in runs])
        if keep_from is not None:
            held = held.where(F.col("step") >= keep_from)
        return self._write(name, max(r.level for r in runs) + 1, merge_partials(held))

    def past(self, mark: Mark, buckets: list[int], first_step: int) -> DataFrame:
        """Partials of these buckets from ``first_step`` on."""
        wanted = set(buckets)
        paths = [f"{self._folder(r.name)}/bucket={b}" for r in mark.runs if r.high >= first_step
                 for b in r.buckets if b in wanted]
        return self._read(paths).where(F.col("step") >= first_step).drop("run", "bucket")

    def read(self) -> DataFrame:
        """All partials that a later batch may still need."""
        mark = self.mark()
        if mark is None:
            return self._read([]).drop("run", "bucket")
        held = merge_partials(self._read([self._folder(r.name) for r in mark.runs]))
        return held if mark.evicted_before is None else held.where(F.col("step") >= mark.evicted_before)

    def leaving(self, mark: Mark, before: int) -> DataFrame | None:
        """Partials with a step below ``before`` that no earlier batch put out; None if there can be none."""
        if mark.evicted_before is not None and before <= mark.evicted_before:
            return None
        old = [r for r in mark.runs if r.low < before]
        if not old:
            return None
        held = self._read([self._folder(r.name) for r in old]).where(F.col("step") < before)
        if mark.evicted_before is not None:
            held = held.where(F.col("step") >= mark.evicted_before)
        return merge_partials(held)

    def add(self, batch: int, earlier: Mark | None, partials: DataFrame, evict_before: int | None) -> Mark:
        """Add a batch's partials, merge runs that are due, and leave the mark of the batch."""
        new = self._write(str(batch), 0, partials)
        held = list(earlier.runs) if earlier else []
        runs = [r for r in held if evict_before is None or r.high >= evict_before] + ([new] if new else [])
        level, made = 0, [new.name] if new else []
        while any(r.level >= level for r in runs):
            mine = [r for r in runs if r.level == level]
            if len(mine) >= self.fanout:
                merged = self._merged(f"{batch}-{level + 1}", mine, evict_before)
                runs = [r for r in runs if r.level != level] + ([merged] if merged else [])
                made.append(f"{batch}-{level + 1}")
            level += 1
        return self._marked(batch, earlier, evict_before, runs, held, made)

    def _marked(self, batch, earlier, evict_before, runs, held, made) -> Mark:
        names = {r.name for r in runs}
        before = [b for b in (evict_before, earlier.evicted_before if earlier else None) if b is not None]
        mark = Mark(batch, max([r.high for r in runs] + ([earlier.high] if earlier else [])), max(before, default=None),
                    runs, sorted({r.name for r in held} - names | set(made) - names))
        self._leave(mark, earlier)
        return mark

    def settle(self, mark: Mark, evict_before: int) -> Mark:
        """One run of all that is still needed, between batches; ``mark`` is the last one."""
        name = f"{mark.batch}-settled"
        merged = self._merged(name, mark.runs, evict_before) if mark.runs else None
        gone = [r.name for r in mark.runs] + mark.gone
        settled = Mark(mark.batch, mark.high, max(evict_before, mark.evicted_before or evict_before), [merged] if merged else [], gone)
        write_text(self.spark, f"{self.root}/marks/{mark.batch}.json", json.dumps(asdict(settled)))
        return settled
