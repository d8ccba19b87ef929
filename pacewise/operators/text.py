"""Text features: embed each different text once, then look the result up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.operators.joins import join_dimension
from pacewise.schema import text_or_empty

TEXT_KEY = "text_key"
DIMENSIONS = 64

# Code points of a character triple are mixed by these factors, then reduced.
TRIPLE_FACTORS = (961, 31, 1)
TRIPLE_MODULUS = 65_521

# Texts that are laid end to end for one numpy pass.
TEXTS_AT_ONCE = 256

# An embedder takes a DataFrame (text_key, text) of different texts and adds
# an ``embedding`` column to it.
Embedder = Callable[[DataFrame], DataFrame]


def text_key(text: Column) -> Column:
    """A short key for a text of any length, so that joins do not carry the text."""
    return F.sha2(text_or_empty(text), 256)


def different_texts(df: DataFrame, column: str) -> DataFrame:
    """``(text_key, text)`` with one row per different text, null read as empty."""
    texts = df.select(text_or_empty(F.col(column)).alias("text")).distinct()
    return texts.select(text_key(F.col("text")).alias(TEXT_KEY), "text")


def hashed_trigrams(dimensions: int = DIMENSIONS) -> Embedder:
    """Unit vectors of hashed character triples of the whole lower-cased text.

    A text becomes its vector in the task that holds it: numpy over Arrow batches,
    no rows per triple and no shuffle. A text without triples has the zero vector.
    """
    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        parts = [_trigram_counts(texts.slice(i, TEXTS_AT_ONCE), dimensions)
                 for i in range(0, len(texts), TEXTS_AT_ONCE)]
        counts = np.concatenate(parts) if parts else np.zeros((0, dimensions))
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, norms, out=counts, where=norms > 0)
        return pa.FixedSizeListArray.from_arrays(unit.ravel(), dimensions).cast(pa.list_(pa.float64()))

    return from_udf(embed)


def _trigram_counts(texts: pa.Array, dimensions: int) -> np.ndarray:
    """Triples per (text, bucket), with a space before and after each text."""
    lowered = [f" {t} " for t in pc.utf8_lower(texts).to_pylist()]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    if len(points) < 3:
        return np.zeros((len(lowered), dimensions))
    mixed = sum(points[i:len(points) - 2 + i] * f for i, f in enumerate(TRIPLE_FACTORS))
    bucket = (mixed % TRIPLE_MODULUS) % dimensions
    within = owner[:-2] == owner[2:]
    cells = owner[:-2][within] * dimensions + bucket[within]
    counted = np.bincount(cells, minlength=len(lowered) * dimensions)
    return counted.reshape(len(lowered), dimensions).astype(np.float64)


def from_udf(function) -> Embedder:
    """An embedder from a pandas or arrow UDF that maps a text column to vectors."""
    return lambda texts: texts.withColumn("embedding", function(F.col("text")))


def embed_different(df: DataFrame, column: str, embedder: Embedder | None = None) -> DataFrame:
    """``(text_key, text, embedding)``: the embedder sees each different text once."""
    return (embedder or hashed_trigrams())(different_texts(df, column))


def pooled(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key as ``(key, vector)``, by mergeable sums inside the JVM."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(key).agg(vector_to_array(mean).alias("vector"))


def fuse(rows: DataFrame, column: str, scores: DataFrame, name: str = "text_similarity") -> DataFrame:
    """Add the score of each row's text; a text without a score fails the job.

    ``scores`` is ``(text_key, score)``.
    """
    keyed = rows.withColumn(TEXT_KEY, text_key(F.col(column)))
    found = join_dimension(keyed, scores.select(TEXT_KEY, F.col("score").alias("__score")), TEXT_KEY)
    missing = F.raise_error(F.concat(F.lit("no score for text: "), text_or_empty(F.col(column))))
    return found.select(*rows.columns, F.coalesce(
        F.col("__score").cast("double"), missing.cast("double")).alias(name))
