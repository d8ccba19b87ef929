"""A uniform sample of fixed size that does not depend on partitioning.

Each row gets a pseudo-random key from its ``seq``; the k rows with the smallest
keys are the sample. Samples merge: the sample of a union is the sample of the
union of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacewise.operators.velocity import WINDOW_STEPS, features
from pacewise.session import reliable

SAMPLE_CAP = 300_000
SEED = 7
SAMPLE_KEY = "sample_key"

# Rows of a bin that are sorted without a second histogram.
_SORTED = 1000

# Drawn keys of 8 bytes that may be broadcast.
BROADCAST_KEYS = 2_000_000

_DIGITS = 4  # hexadecimal digits of a key by which one histogram counts


def sample_key(seq: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), seq.cast("string")))


def bottom_k(df: DataFrame, k: int = SAMPLE_CAP, seed: int = SEED, seq: str = "seq") -> DataFrame:
    """A uniform sample of ``min(k, rows)`` rows without replacement.

    A histogram over the first 16 bits of the keys (65,536 counts at most) finds the bin of the k-th key, a second
    one over the next 16 bits, of this bin alone, the bin inside it if the first holds more than ``_SORTED`` rows. Only
    the rows up to that bin, k plus about one part in 2^32 of all, are sorted and merged.
    """
    keyed = df.withColumn(SAMPLE_KEY, sample_key(F.col(seq), seed))
    if (cut := _cut(df.select(sample_key(F.col(seq), seed).alias(SAMPLE_KEY)), k)) is None:
        return keyed
    return keyed.where(F.substring(SAMPLE_KEY, 1, len(cut)) <= cut).orderBy(SAMPLE_KEY, seq).limit(k)


def _cut(keys: DataFrame, k: int) -> str | None:
    """First digits of the k-th key; None if there are fewer keys."""
    prefix = ""
    for level in range(2):
        digits = F.substring(SAMPLE_KEY, 1 + level * _DIGITS, _DIGITS)
        counts = keys.where(F.col(SAMPLE_KEY).startswith(prefix)).groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, 0))  # 65,536 rows at most
        found = counts.withColumn("upto", upto).where(F.col("upto") >= k).orderBy("upto").first()
        if found is None:
            return None
        prefix, k = prefix + found["digits"], k - (found["upto"] - found["n"])
        if found["n"] <= _SORTED:
            break
    return prefix


def sampled_features(rows: DataFrame, k: int = SAMPLE_CAP, seed: int = SEED,
                     window: int = WINDOW_STEPS) -> DataFrame:
    """The sample of the feature table, without computing the whole feature table.

    A row is drawn by its ``seq`` alone, so rows are drawn first; features then need
    only the accounts of the drawn rows. The drawn keys are at most k pairs of numbers.
    """
    drawn = reliable(bottom_k(rows.select("account", "seq"), k, seed).select("account", "seq"))
    small = k <= BROADCAST_KEYS

    def keep(df: DataFrame, key: str) -> DataFrame:
        keys = drawn.select(key).distinct()
        return df.join(F.broadcast(keys) if small else keys, key, "left_semi")

    return keep(features(keep(rows, "account"), window), "seq")


def merge_samples(older: DataFrame, newer: DataFrame, k: int = SAMPLE_CAP, seq: str = "seq") -> DataFrame:
    """The sample of everything seen, from two samples of at most k rows each."""
    return older.unionByName(newer).orderBy(SAMPLE_KEY, seq).limit(k)
