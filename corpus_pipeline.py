"""A training corpus from raw documents: language, near duplicates, repeated strings, benchmark passages, mixture.

Every stage takes all that the one before it kept and writes its result as Parquet in the
shared folder of the cluster, where the next one reads it; nothing is carried over in memory.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.llm import decontaminate, jaccard, language, mixing, suffixes
from pacewise.session import shared_dir

LEAST_SCORE = 0.35  # of a language; below it the language is not clear
BATCH_BYTES = "4m"  # of texts that pass to or from Python at a time, on both sides of the pipe


def _in_small_batches(stage):
    """Bounds the Arrow batches of a stage by bytes, since 10,000 texts may be any size."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)
    return run


@_in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or between languages go."""
    model = language.fit(docs)
    columns = tuple(docs.columns)
    marked = language.predict(docs, model, columns, ("__lang", "__sure"))
    if not model.languages:  # nothing to learn from: no decision
        return docs
    return (marked.where((F.col("__lang") != language.UNKNOWN) & (F.col("__sure") >= LEAST_SCORE))
            .select(*columns))


@_in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each_group(docs)


@_in_small_batches
def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes or more that an earlier document holds."""
    return suffixes.without_repeats(docs)


@_in_small_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes."""
    return mixing.mixture_digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("decontaminate", drop_benchmark),
    ("mix_sources", mix_sources),
]

# The learned language model and byte-wise removal have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
