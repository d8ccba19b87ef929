"""Area under the ROC curve by rank sums, without sorting rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.operators.ordering import running_totals
from pacewise.session import reliable


def area_under_roc(scored: DataFrame, score: str = "p", label: str = "isFraud") -> DataFrame:
    """One row ``(positives, negatives, auc)``; NaN where a class is missing.

    Rows become counts per score first, so a score that many rows share is one row
    of the running count. Rows of equal score count half, whatever their order.
    """
    counts = scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) != 1).alias("neg"))
    # What gives the scores, such as a feature pass, runs once; the counts are read again.
    counts = reliable(counts)
    placed = running_totals(counts, "score", {"below": F.col("neg")}, include_own=False)
    won = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2))
    sums = placed.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
        won.alias("won"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(
        "positives", "negatives",
        F.when(pairs > 0, F.col("won") / pairs).otherwise(F.lit(float("nan"))).alias("auc"))
