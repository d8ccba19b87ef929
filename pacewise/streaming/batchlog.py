"""What micro-batches leave behind: one folder per batch id below a shared root.

A batch that runs again writes the same folder again and reads only the folders of
earlier batches, so a replay after a failure gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.session import delete_path, path_exists

BATCH = "batch_id"


class BatchLog:
    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root, schema

    def write(self, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.folder(batch_id))

    def folder(self, batch_id: int) -> str:
        return f"{self.root}/{BATCH}={batch_id}"

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one, with their ``batch_id``."""
        schema = f"{self.schema}, {BATCH} long"
        if not path_exists(self.spark, self.root):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.root)
        return rows if before is None else rows.where(F.col(BATCH) < before)

    def drop(self, batch_id: int) -> None:
        delete_path(self.spark, self.folder(batch_id))
