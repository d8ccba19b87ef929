"""Statistics and samples kept up to date along a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.operators.partials import PARTIAL_SCHEMA, finish, merge, partials
from pacewise.operators.sampling import SAMPLE_CAP, SAMPLE_KEY, SEED, bottom_k, merge_samples
from pacewise.streaming.batchlog import BATCH, BatchLog
from pacewise.streaming.live import ROW_SCHEMA


class RunningStats:
    """A ``foreachBatch`` function that leaves one partial per micro-batch."""

    def __init__(self, spark: SparkSession, root: str, value: str = "amount") -> None:
        self.value = value
        self.log = BatchLog(spark, f"{root}/stats", PARTIAL_SCHEMA)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.log.write(batch_id, partials(batch, self.value).coalesce(1))

    def result(self) -> DataFrame:
        return finish(merge(self.log.read()))


class RunningSample:
    """A ``foreachBatch`` function that keeps the sample of all rows seen so far.

    Batch n leaves the sample of batches 0 to n, so only the last folders are read.
    """

    def __init__(self, spark: SparkSession, root: str, k: int = SAMPLE_CAP, seed: int = SEED,
                 schema: str = ROW_SCHEMA) -> None:
        self.k, self.seed = k, seed
        self.log = BatchLog(spark, f"{root}/sample", f"{schema}, {SAMPLE_KEY} string")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        newer = bottom_k(batch, self.k, self.seed)
        older = self._at(batch_id - 1)
        self.log.write(batch_id, merge_samples(older, newer.select(*older.columns), self.k))
        if batch_id >= 2:
            self.log.drop(batch_id - 2)

    def _at(self, batch_id: int) -> DataFrame:
        rows = self.log.read()
        return rows.where(rows[BATCH] == batch_id).drop(BATCH)

    def result(self) -> DataFrame:
        rows = self.log.read()
        last = rows.agg(F.max(BATCH)).first()[0]
        return self._at(-1 if last is None else last)
