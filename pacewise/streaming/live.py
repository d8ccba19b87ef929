"""Features and scores on a live stream, by the definition that serves tables.

Each micro-batch runs :func:`pacewise.operators.velocity.features` over its own rows
and the partials per (account, step) that earlier batches left. The partials are the
whole state: a log of runs in the shared folder (:mod:`pacewise.streaming.history`), at most ``window + lateness``
steps deep, one row per account and step however many rows there were. A batch reads
one mark and the buckets of its own accounts, so its cost does not grow with the number of batches.

Every batch also leaves one row of progress: rows in and late, partials held and put out, runs and files read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.functions.predicates import flag
from pacewise.operators.training import LogisticModel
from pacewise.operators.velocity import (HISTORY_SCHEMA, HOT_ROWS, WINDOW_STEPS, features,
                                         merge_partials, step_partials)
from pacewise.schema import SEQUENCED
from pacewise.streaming.batchlog import BatchLog
from pacewise.streaming.history import BUCKETS, Mark, StepHistory

ROW_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SEQUENCED.fields)
FEATURE_SCHEMA = (f"{ROW_SCHEMA}, velocity_count long, window_sum double, window_mean double, "
                  "window_max double, amount_over_mean double")
PROGRESS_SCHEMA = ("rows_in long, rows_late long, rows_out long, state_rows long, evicted_rows long, runs int, "
                   "files_read int, newest_step int")


class LiveFeatures:
    """A ``foreachBatch`` function; its state and output lie below ``root``.

    Rows with a step more than ``lateness`` (one window by default) below the largest step of earlier batches
    are late. They go to the late table and are counted, and have no effect on others.
    With a ``model``, rows also get a probability ``p`` and ``flagged``.
    """

    def __init__(self, spark: SparkSession, root: str, window: int = WINDOW_STEPS, lateness: int | None = None,
                 model: LogisticModel | None = None, threshold: float = 0.5,
                 hot_rows: int | None = HOT_ROWS, buckets: int = BUCKETS) -> None:
        self.window, self.lateness = window, window if lateness is None else lateness
        self.model, self.threshold, self.hot_rows = model, threshold, hot_rows
        scored = "" if model is None else ", p double, flagged boolean"
        self.output = BatchLog(spark, f"{root}/features", FEATURE_SCHEMA + scored)
        self.spark, self.history = spark, StepHistory(spark, f"{root}/history", buckets)
        self.evicted = BatchLog(spark, f"{root}/evicted", HISTORY_SCHEMA)
        self.progress = BatchLog(spark, f"{root}/progress", PROGRESS_SCHEMA)
        self.late = BatchLog(spark, f"{root}/late", ROW_SCHEMA)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(*SEQUENCED.names).persist()
        try:
            self._run(batch, batch_id)
        finally:
            batch.unpersist()

    def _run(self, batch: DataFrame, batch_id: int) -> None:
        mark = self.history.mark(batch_id)
        oldest = None if mark is None else mark.high - self.lateness
        is_late = F.lit(False) if oldest is None else F.col("step") < oldest
        bucket = F.when(~is_late, self.history.bucket_of(F.col("account")))
        size, late, low, buckets = batch.agg(F.count(F.lit(1)), F.count_if(is_late), F.min(F.when(~is_late, F.col("step"))),
                                             F.collect_set(bucket)).first()
        on_time = batch
        if late:
            self.late.write(batch_id, batch.where(is_late))
            on_time = batch.where(~is_late)
        files = evicted = 0
        if low is not None:
            # A batch smaller than one hot account has none.
            hot_rows = self.hot_rows if self.hot_rows and size >= self.hot_rows else None
            past = None
            if mark is not None:
                past = self.history.past(mark, buckets, low - self.window)
                files = len(past.inputFiles())
                # partials of the accounts in the batch only
                past = merge_partials(past.join(on_time.select("account").distinct(), "account", "left_semi"))
            self.output.write(batch_id, self._scored(features(on_time, self.window, past, hot_rows=hot_rows)))
            # No row from this batch on can reach further back. The bound uses only what
            # earlier batches saw, so this batch can still run again.
            bound = None if oldest is None else oldest - self.window
            evicted = self._evict(mark, bound, batch_id)
            mark = self.history.add(batch_id, mark, step_partials(on_time), bound)
        self._note(batch_id, size, late, evicted, files, mark)

    def _evict(self, mark: Mark | None, before: int | None, batch_id: int) -> int:
        """Put out the partials that no later row can reach."""
        leaving = None if mark is None or before is None else self.history.leaving(mark, before)
        if leaving is None:
            return 0
        self.evicted.write(batch_id, leaving)
        return self.spark.read.schema(HISTORY_SCHEMA).parquet(self.evicted.folder(batch_id)).count()

    def _note(self, batch_id: int, size: int, late: int, evicted: int, files: int, mark: Mark | None) -> None:
        held = mark.runs if mark else []
        row = (size, late, size - late, sum(r.rows for r in held), evicted, len(held), files, mark.high if mark else None)
        self.progress.write(batch_id, self.spark.createDataFrame([row], PROGRESS_SCHEMA).coalesce(1))

    def settle(self) -> None:
        """Between two runs of the stream: evict by the newest step of all batches, and merge what is held into one run."""
        mark = self.history.mark()
        if mark is None:
            return
        before = mark.high - self.lateness - self.window
        batch_id = -1 - mark.batch  # beside the batches of the stream
        evicted = self._evict(mark, before, batch_id)
        self._note(batch_id, 0, 0, evicted, 0, self.history.settle(mark, before))

    def _scored(self, featured: DataFrame) -> DataFrame:
        if self.model is None:
            return featured
        return self.model.score(featured).withColumn("flagged", flag(F.col("p"), self.threshold))

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Start the query; the default trigger takes all that is there and ends."""
        return (stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
