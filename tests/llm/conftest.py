import pytest
from pyspark.sql import types as T

# Columns that operators use inside, as extra columns of the input.
CLASHES = ["doc", "n", "grp", "size", "rank", "begins", "bucket", "score"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHES]])


@pytest.fixture
def docs(spark):
    """A documents table from ``(doc_id, text[, lang[, source]])`` rows, with columns of clashing names."""
    def make(rows, partitions=3):
        full = [(*r, *[None] * (4 - len(r)), *["x"] * len(CLASHES)) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)
    return make
