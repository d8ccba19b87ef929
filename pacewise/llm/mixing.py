"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot s has the point (s * G mod 2**31), with G = 2**31 over the golden ratio. Cumulative
targets cut the range of points into one interval per source, so the slots of a source are
spread evenly through the schedule and their number is its share within a few slots. Slots are
ranked per source. The documents of a source, shuffled by a hash of the id, form one stream of
words, repeated up to ``MOST_TIMES`` times and cut into blocks of equal size; the slot of rank r takes
block r. The plan is DataFrame expressions throughout.

Running totals are taken inside pieces of a source (ranges of the hash, ranges of slots), whose
totals are added up first, so no task holds a source.

Defined cases. A null text has no words and is never taken. A null source is a source of its own, last
in order. Rows that repeat an id are separate documents; among rows equal in id and size it is
undefined which is taken first, so the result is the same as a set of rows. Extra columns are ignored. With no
words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacewise.llm.scale import small_side
from pacewise.session import reliable

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 1024
LEAST_SLOTS = 1 << 14      # with few words, blocks are made smaller to have so many slots
POINTS = 1 << 31
GOLDEN = 1327217885        # POINTS over the golden ratio, made odd
CELL = 1 << 19             # points of one cell, by which slots find their source
PIECE_ROWS = 20_000        # documents of a source whose positions one task sums up
PIECE_SLOTS = 1 << 16


def sized(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, size, h)``: words of each text, and the hash that shuffles."""
    return documents.select(
        "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))


def targets(sizes: DataFrame) -> DataFrame:
    """``(src, source, source_size, target)`` from ``(source, source_size)``; one row per source.

    Targets fill up like water: min(cap, weight * level), where the level makes them sum to all words.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", "source_size", (F.row_number().over(order) - 1).alias("src"))
    weight = F.array(*[F.lit(w) for w in WEIGHTS])[F.col("src") % len(WEIGHTS)]
    capped = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * MOST_TIMES})
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    stepped = capped.withColumn(
        "level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    # past the first source that stays below its cap, the steps only fall
    level = F.coalesce(F.max(fits).over(everything), F.lit(0.0))
    return stepped.select("src", "source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def _summed(rows: DataFrame, group: str, piece: str, value, order: list) -> DataFrame:
    """``rows`` with ``start``: the sum of ``value`` over the rows of the group before it, by way of pieces."""
    pieces = rows.groupBy(group, piece).agg(F.sum(value).alias("__all"))
    earlier = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(group, piece, F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(small_side(reliable(pieces), 64), [group, piece])
            .withColumn("start", F.col("__base") + F.col("__in")).drop("__base", "__in", piece))


def schedule(aims: DataFrame, slots: int) -> DataFrame:
    """``(slot, src, rank)``: the source of each slot, and its rank among the slots of that source."""
    order = Window.orderBy("src")
    share = F.try_divide(F.sum("target").over(order), F.sum("target").over(Window.partitionBy()))
    upto = F.floor(F.coalesce(share, F.lit(0.0)) * POINTS).cast("long")
    bounds = aims.select("src", upto.alias("hi"), F.row_number().over(Window.orderBy(F.desc("src"))).alias("__last"))
    bounds = bounds.select("src", F.coalesce(F.lag("hi").over(order), F.lit(0)).alias("lo"),
                           F.when(F.col("__last") == 1, F.lit(POINTS)).otherwise(F.col("hi")).alias("hi"))
    cells = reliable(bounds.where("hi > lo")
                     .select("*", F.explode(F.expr(f"sequence(lo div {CELL}, (hi - 1) div {CELL})")).alias("cell")))
    spark = aims.sparkSession
    points = (spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % POINTS) * GOLDEN % POINTS).alias("point"))
              .withColumn("cell", F.expr(f"point div {CELL}")))
    chosen = (points.join(small_side(cells, 48), "cell").where("point >= lo and point < hi")
              .select("slot", "src", F.expr(f"slot div {PIECE_SLOTS}").alias("piece")))
    return _summed(chosen, "src", "piece", F.lit(1), ["slot"]).withColumnRenamed("start", "rank")


def mixed(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan of a mixture of ``documents (doc_id, text, source)``.

    First ``(src, start, doc_id, size, source_size, target)``, one row per document, where ``start`` is its place in
    the stream of its source; then ``(slot, src, rank, start, doc_id, begin, words)``, the parts of
    documents that fill each slot.
    """
    rows = reliable(sized(documents))
    aims = reliable(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    total = aims.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    words, count = total[0], rows.count()
    block = max(1, min(BLOCK_WORDS, words // LEAST_SLOTS))
    slots = words // block
    pieces = max(1, -(-count // PIECE_ROWS))
    at = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * pieces / F.lit(1 << 32)).cast("long")
    keyed = (rows.alias("r").join(small_side(aims, 128).alias("a"), F.col("r.source").eqNullSafe(F.col("a.source")))
             .select("doc_id", "size", "h", "src", "source_size", "target", at.alias("piece")))
    placed = reliable(_summed(keyed, "src", "piece", F.col("size"), ["h", "doc_id", "size"]).drop("h"))
    plan = reliable(schedule(aims, slots))
    taken = reliable(plan.groupBy("src").agg((F.max("rank") + 1).alias("slots")))
    parts = (placed.where("size > 0").join(small_side(taken, 48), "src")
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST_TIMES - 1))).alias("time"))
             .withColumn("from", F.col("time") * F.col("source_size") + F.col("start"))
             .withColumn("upto", F.least(F.col("from") + F.col("size"), F.col("slots") * block)).where("from < upto")
             .select("src", "start", "doc_id", "from", "upto",
                     F.explode(F.expr(f"sequence(from div {block}, (upto - 1) div {block})")).alias("rank")))
    filled = parts.join(plan, ["src", "rank"]).select(
        "slot", "src", "rank", "start", "doc_id",
        (F.greatest(F.col("from"), F.col("rank") * block) - F.col("from")).alias("begin"),
        (F.least(F.col("upto"), (F.col("rank") + 1) * block) - F.greatest(F.col("from"), F.col("rank") * block)).alias("words"))
    return placed, filled


def mixture_digest(documents: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row."""
    placed, filled = mixed(documents)
    taken = filled.groupBy("src", "start").agg(F.sum("words").alias("taken"))
    return placed.join(taken, ["src", "start"], "left").select(
        "doc_id", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))
