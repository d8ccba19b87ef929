"""The velocity features: one definition for tables and for streams.

For a row of an account at step ``s`` the window holds the rows of that account
that arrived earlier and have ``step >= s - window``. Rows of step ``s`` itself
count if they arrived earlier; the row itself and later arrivals do not.

A row enters as a partial ``(n, units, peak)`` with ``n = 1``. A streaming caller
passes what earlier batches left behind as partials per (account, step), and the
same expressions run over both, so a batch and a stream cannot drift apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_STEPS = 24

FEATURES = ("velocity_count", "window_sum", "window_mean", "window_max", "amount_over_mean")

# Rows of one account that a single task may window by itself. Accounts above it
# are cut into pieces of about this size.
HOT_ROWS = 1_000_000

HISTORY_SCHEMA = "account long, step int, n long, units long, peak double"

# One row in this many is looked at to find such accounts.
_SIZE_SHARE = 64

_MORE_PIECES = 16

PARTIAL = ("n", "units", "peak")


def step_partials(rows: DataFrame, decimals: int = 2) -> DataFrame:
    """Mergeable partials per (account, step): what later rows need of these rows."""
    return rows.groupBy("account", "step").agg(
        F.expr("count(1) AS n"), F.expr(f"sum({_units(decimals)}) AS units"), F.expr("max(amount) AS peak"))


def merge_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy("account", "step").agg(
        F.expr("sum(n) AS n"), F.expr("sum(units) AS units"), F.expr("max(peak) AS peak"))


def features(rows: DataFrame, window: int = WINDOW_STEPS, history: DataFrame | None = None,
             decimals: int = 2, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``rows`` with the five feature columns added.

    ``rows`` has ``account, step, amount, seq`` and any other columns, which pass
    through. ``history`` holds partials of rows that arrived before all of them.

    Accounts up to ``hot_rows`` rows take one exchange and one sort. Larger ones
    take :func:`_split_totals`, where no group depends on the size of an account.
    ``hot_rows=None`` skips the look for such accounts.
    """
    if window < 1:
        raise ValueError("the window needs at least one step")
    taken = sorted({*PARTIAL, "live", "cut", "piece"} & set(rows.columns))
    if taken:
        raise ValueError(f"column names used for the work itself: {taken}")
    kept = _quoted(rows.columns)
    if history is None:
        # A row's partial is an expression over it, so nothing extra is shuffled.
        weights, source = ("1L", _units(decimals), "CAST(amount AS DOUBLE)"), rows
    else:
        weights = PARTIAL
        source = rows.selectExpr(
            "*", "1L AS n", f"{_units(decimals)} AS units", "CAST(amount AS DOUBLE) AS peak", "true AS live",
        ).unionByName(history.selectExpr("account", "step", *PARTIAL, "false AS live"),
                      allowMissingColumns=True)
        kept.append("live")

    if hot_rows is None:
        totals = _keyed_totals(source, kept, weights, window)
    else:
        # Both sides use the same broadcast: accounts to cut, with how to cut them.
        marked = source.join(F.broadcast(_hot_accounts(source, hot_rows)), "account", "left")
        totals = _keyed_totals(marked.where("cut IS NULL"), kept, weights, window).union(
            _split_totals(marked.where("cut IS NOT NULL"), kept, weights, window))

    live = totals if history is None else totals.where("live")
    return live.select(*rows.columns, *feature_columns(decimals))


def feature_columns(decimals: int = 2) -> list[Column]:
    """The features from the window totals ``w_n, w_units, w_peak`` and ``amount``."""
    total = f"(CAST(w_units AS DOUBLE) / {10 ** decimals}D)"
    mean = f"CASE WHEN w_n > 0 THEN {total} / w_n ELSE 0D END"
    # A mean of zero or less, and so an empty window, gives the ratio 1.
    ratio = f"CASE WHEN w_n > 0 AND w_units > 0 THEN amount / ({total} / w_n) ELSE 1D END"
    return [F.expr(f"w_n AS {FEATURES[0]}"), F.expr(f"{total} AS {FEATURES[1]}"),
            F.expr(f"{mean} AS {FEATURES[2]}"), F.expr(f"coalesce(w_peak, 0D) AS {FEATURES[3]}"),
            F.expr(f"{ratio} AS {FEATURES[4]}")]


def feature_vector(names: tuple[str, ...] = FEATURES) -> Column:
    return F.array(*[F.col(n).cast("double") for n in names])


def in_arrival_order(featured: DataFrame) -> DataFrame:
    return featured.orderBy("seq")


def _units(decimals: int) -> str:
    """The amount in whole minor units; as :func:`pacewise.functions.money.minor_units`, others fail the query."""
    scaled = f"(amount * {10 ** decimals}D)"
    return (f"CASE WHEN amount IS NULL OR abs({scaled} - rint({scaled})) <= 1e-6D + abs({scaled}) * 1e-13D "
            f"THEN CAST(rint({scaled}) AS BIGINT) "
            "ELSE CAST(raise_error(concat('amount is not whole in minor units: ', CAST(amount AS STRING))) AS BIGINT) END")


def _over(name: str, weights: Sequence[str], frame: str) -> list[str]:
    """The three window aggregates over one frame, as ``<name>_n`` and so on."""
    n, units, peak = weights
    return [f"sum({n}) OVER ({frame}) AS {name}_n", f"sum({units}) OVER ({frame}) AS {name}_units",
            f"max({peak}) OVER ({frame}) AS {name}_peak"]


def _added(*names: str) -> list[str]:
    """Totals over disjoint frames; greatest() skips empty ones."""
    def plus(part):
        return " + ".join(f"coalesce({n}_{part}, 0L)" for n in names)
    peaks = ", ".join(f"{n}_peak" for n in names)
    return [f"{plus('n')} AS w_n", f"{plus('units')} AS w_units", f"greatest({peaks}) AS w_peak"]


def _quoted(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _keyed_totals(source: DataFrame, kept: list[str], weights: Sequence[str], window: int) -> DataFrame:
    """Two disjoint frames per account: earlier steps, and earlier rows of the same step."""
    # Rows placed by account and sorted once by (account, step, seq) satisfy both
    # windows, whichever of them Catalyst puts first.
    placed = source.drop("cut").repartition("account").sortWithinPartitions("account", "step", "seq")
    framed = placed.selectExpr(
        "*", *_over("same", weights, f"PARTITION BY account, step ORDER BY seq {_BEFORE}"),
        *_over("past", weights, "PARTITION BY account ORDER BY step "
                                f"RANGE BETWEEN {window} PRECEDING AND 1 PRECEDING"))
    return framed.selectExpr(*kept, *_added("same", "past"))


def _hot_accounts(source: DataFrame, hot_rows: int) -> DataFrame:
    """``(account, cut)`` for accounts of about ``hot_rows`` rows or more.

    Sizes are estimated from the rows whose hashed ``seq`` falls in one of 64 classes,
    which is the same choice however often it is made. Which accounts are found steers
    the work and not the result. At most (all rows / hot_rows) accounts qualify, which
    bounds the broadcast. ``cut`` is where to start and how wide a piece of ``seq`` is.
    """
    share = min(_SIZE_SHARE, max(1, hot_rows // 64))
    sized = (source.where(f"pmod(xxhash64(seq), {share}L) = 0").groupBy("account").agg(
        F.expr(f"count(1) * {share}L AS size"), F.expr("min(seq) AS lo"), F.expr("max(seq) AS hi")))
    # Far more pieces than needed, so that uneven stretches of seq stay small too.
    width = f"greatest(1L, ceil((hi - lo + 1) / ceil(size * {_MORE_PIECES} / {hot_rows})))"
    return sized.where(f"size >= {hot_rows}").selectExpr(
        "account", f"struct(lo, CAST({width} AS BIGINT) AS width) AS cut")


def _split_totals(source: DataFrame, kept: list[str], weights: Sequence[str], window: int) -> DataFrame:
    """Window totals where an account is too large for one task.

    Rows are grouped by (account, step, piece of ``seq``). A row needs the earlier
    rows of its own group, the earlier groups of its step, and the earlier steps.
    The last two come from partials, which hold one row per group or step.
    """
    # History has no seq and precedes every piece.
    pieced = source.selectExpr(
        "*", "coalesce(greatest(0L, floor((seq - cut.lo) / cut.width)), -1L) AS piece")
    n, units, peak = weights
    cells = pieced.groupBy("account", "step", "piece").agg(
        F.expr(f"sum({n}) AS n"), F.expr(f"sum({units}) AS units"), F.expr(f"max({peak}) AS peak"))
    context = cells.selectExpr("account", "step", "piece", *_over(
        "cell", PARTIAL, f"PARTITION BY account, step ORDER BY piece {_BEFORE}"))
    context = context.join(_past_steps(merge_partials(cells), window), ["account", "step"])
    placed = pieced.selectExpr(*kept, "piece", *_over(
        "same", weights, f"PARTITION BY account, step, piece ORDER BY seq {_BEFORE}"))
    joined = placed.join(context, ["account", "step", "piece"])
    return joined.selectExpr(*kept, *_added("same", "cell", "past"))


def _past_steps(steps: DataFrame, window: int, spans: int = 8) -> DataFrame:
    """Totals of the ``window`` steps before each step, from one partial per step.

    The time axis is cut into blocks of ``spans`` windows, so a group holds at most
    ``window * (spans + 1)`` rows. The last window of a block is also handed to the
    next block, as context only.
    """
    length = window * spans
    own = f"floor(step / {length})"
    spread = steps.selectExpr("*", f"""explode(CASE WHEN pmod(step, {length}) >= {length - window}
        THEN array({own}, {own} + 1) ELSE array({own}) END) AS block""")
    framed = spread.selectExpr("*", *_over(
        "past", PARTIAL, f"PARTITION BY account, block ORDER BY step RANGE BETWEEN {window} PRECEDING AND 1 PRECEDING"))
    return framed.where(f"block = {own}").selectExpr(
        "account", "step", *[f"past_{c}" for c in PARTIAL])
