"""Features by keyed state: each account's recent steps live in Spark's state store.

The push form of the same window. Its state per account is one partial per step, at
most ``window + 1`` of them. Accounts are held and folded by hash bucket, since a call per
account costs far more than its rows. The state of a bucket is read and written whole when one
of its accounts has rows. The rows a bucket brings in one micro-batch are folded
in one task, so bound the intake of a micro-batch; for streams with very hot accounts
use :class:`pacewise.streaming.live.LiveFeatures`, which splits them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pacewise.functions.money import minor_units
from pacewise.operators.velocity import WINDOW_STEPS, feature_columns
from pacewise.schema import HOUR_SECONDS

BUCKETS = 1024
_STATE = "accounts array<{}>, sizes array<int>, steps array<int>, n array<long>, units array<long>, peaks array<double>"
_TOTALS = (("w_n", T.LongType()), ("w_units", T.LongType()), ("w_peak", T.DoubleType()))
NO_ACCOUNT = -1  # the bucket of rows without one
_WORK = ("__units", "__at", "__bucket")  # columns used for the work itself


def keyed_features(stream: DataFrame, window: int = WINDOW_STEPS, lateness: int | None = None,
                   unit_seconds: int = HOUR_SECONDS, decimals: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``stream`` and the five features, as a streaming DataFrame.

    ``stream`` has ``account, step, amount, seq`` and any other columns, which pass through, so that
    the result can be scored as that of a table. Rows more than ``lateness`` steps (one window by default)
    behind the newest step are refused by the watermark and counted in the progress of the query. An account
    idle for a window past that loses its state, at the latest when all of its bucket are. ``buckets`` must stay the same for a
    checkpoint.
    """
    taken = sorted({*_WORK, *(name for name, _ in _TOTALS)} & set(stream.columns))
    if taken:
        raise ValueError(f"column names used for the work itself: {taken}")
    slack = window if lateness is None else lateness
    timed = (stream.select("*", minor_units(F.col("amount"), decimals).alias(_WORK[0]),
                           F.timestamp_seconds(F.col("step").cast("long") * unit_seconds).alias(_WORK[1]),
                           F.when(F.col("account").isNull(), NO_ACCOUNT)
                           .otherwise(F.pmod(F.xxhash64("account"), F.lit(buckets))).cast("int").alias(_WORK[2]))
             .withWatermark(_WORK[1], f"{max(slack, 1) * unit_seconds} seconds"))
    out = T.StructType([*stream.schema.fields, *(T.StructField(name, kind) for name, kind in _TOTALS)])
    held = _STATE.format(stream.schema["account"].dataType.simpleString())
    folded = timed.groupBy(_WORK[2]).applyInPandasWithState(
        _fold(window, unit_seconds, stream.columns), out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return folded.select(*[F.col(f"`{c}`") for c in stream.columns], *feature_columns(decimals))


def _fold(window: int, unit_seconds: int, columns: list[str]):
    def fold(key, chunks, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        accounts, sizes, *held = state.get if state.exists else [[]] * 6
        rows = pd.concat(list(chunks)).sort_values(["step", "seq"], kind="stable")
        own = len(held[0])
        if key[0] == NO_ACCOUNT:
            known, whose = [None], np.zeros(own + len(rows), np.int64)
        else:
            of_rows = rows["account"].to_numpy()
            of_held = np.repeat(np.asarray(accounts, of_rows.dtype), np.asarray(sizes, np.int64))
            known, whose = np.unique(np.concatenate([of_held, of_rows]), return_inverse=True)
            known = known.tolist()
        step = np.concatenate([held[0], rows["step"]]).astype(np.int64)
        n = np.concatenate([held[1], np.ones(len(rows))]).astype(np.int64)
        units = np.concatenate([np.asarray(held[2], np.int64), rows["__units"].to_numpy(np.int64)])
        peak = np.concatenate([held[3], rows["amount"]]).astype(np.float64)

        # By account and step. What was held arrived earlier than any row of its step.
        order = np.lexsort((step, whose))
        position = np.empty_like(order)
        position[order] = np.arange(len(order))
        whose, step, n, units, peak = (v[order] for v in (whose, step, n, units, peak))
        low = int(step.min())
        reach = int(step.max()) - low + 1
        first = np.searchsorted(whose * reach + (step - low), whose * reach + np.maximum(step - window - low, 0))
        here = position[own:]
        total_n = np.concatenate([[0], np.cumsum(n)])
        total_units = np.concatenate([[0], np.cumsum(units)])
        yield rows[columns].assign(
            w_n=total_n[here] - total_n[first[here]], w_units=total_units[here] - total_units[first[here]],
            w_peak=range_max(peak, first[here], here))

        last = step[np.searchsorted(whose, whose, "right") - 1]  # of its account
        idle_at = (last + window + 1) * unit_seconds * 1000
        recent = np.flatnonzero((step >= last - window) & (idle_at > state.getCurrentWatermarkMs()))
        if not len(recent):
            state.remove()
            return
        whose, step = whose[recent], step[recent]
        starts = np.flatnonzero(np.r_[True, (whose[1:] != whose[:-1]) | (step[1:] != step[:-1])])
        stay, sizes = np.unique(whose[starts], return_counts=True)
        state.update((
            [known[i] for i in stay], sizes.tolist(), step[starts].tolist(),
            np.add.reduceat(n[recent], starts).tolist(),
            np.add.reduceat(units[recent], starts).tolist(),
            np.maximum.reduceat(peak[recent], starts).tolist()))
        state.setTimeoutTimestamp(max(int(idle_at.max()), state.getCurrentWatermarkMs() + 1))

    return fold


def range_max(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Largest of ``values[first[i]:end[i]]`` for each i; NaN, so null, where that is empty.

    Any range is covered by two of one power-of-two length; the maxima of all such ranges double in length from
    round to round.
    """
    out = np.full(len(first), np.nan)
    level = np.frexp(end - first)[1] - 1  # the power below the length; -1 for an empty range
    top, reach = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(top[first[at]], top[end[at] - reach])
        top = np.maximum(top[:-reach], top[reach:])
        reach *= 2
    return out
