"""Quality rules whose cutoffs are certified on labelled documents.

Fixed base rules look at counts of the text. Six more rates get a cutoff for each stratum
(the language): documents above it are rejected. Labelled documents of good quality are the
holdout. For a cutoff that rejects k of n of them, the exact binomial probability of k or fewer
at the tolerated rate ``RISK`` is the p-value of "this cutoff rejects more than that". Cutoffs
are tested from lenient to strict and certified up to the first failure, so all certified
ones hold together; the level is divided by the number of strata and rules. Of the certified
cutoffs the one that pays best counts: bad documents rejected, less ``COST`` times the good
ones. Where none is certified, as with few labels, or none pays, the rule rejects nothing.

Everything is DataFrame expressions; counts per (stratum, rule, value) are all that is gathered,
``STEPS + 1`` values at most for each.

Defined cases. A null text has no words. A null language is a stratum of its own. Null labels
and null ids are not used for cutoffs; several labels of a document count as their least.
Repeated rows repeat. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacewise.llm.scale import small_side
from pacewise.session import reliable

RISK = 0.02          # tolerated share of good documents that a rule rejects in a stratum
LEVEL = 0.05         # chance that any certified cutoff exceeds it
COST = 5             # a good document rejected weighs as many bad ones
STEPS = 2000         # rates above count as this
MIN_WORDS = 50
MOST_REPEATED = 50   # percent of words in repeated three-word windows
RULES = ("symbols", "duplicate_lines", "repeats", "capitals", "marks", "word_length")

_SPACE = " \t\n\x0b\f\r"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""
    n = F.size(words) - 2
    windows = F.transform(F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c")),
                          lambda w, i: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        # in sorted order equal windows are neighbours
        hashes = F.transform(s, lambda x: x["h"])
        near = lambda h: F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(None).cast("long")), h).alias("p"),
                                      F.concat(F.slice(h, 2, F.size(h)), F.array(F.lit(None).cast("long"))).alias("q"))
        repeated = _let(hashes, lambda h: F.filter(F.slice(near(h), 1, F.size(h)), lambda z: F.coalesce(
            (z["x"]["h"] == z["p"]) | (z["x"]["h"] == z["q"]), (z["x"]["h"] == z["p"]), (z["x"]["h"] == z["q"]), F.lit(False))))
        at = F.sort_array(F.transform(repeated, lambda z: z["x"]["i"]))
        return _let(at, lambda a: F.aggregate(
            F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))),
            F.lit(0), lambda total, x: total + x))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(F.sort_array(windows), covered))


def measures(documents: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the columns ``keep``, and the counts of every text, which the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = documents.select(
        "doc_id", *keep,
        _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        F.length(text).alias("characters"), _without(text, _SPACE).alias("inked"), _without(text, "#*$%&|<>").alias("plain"),
        _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("small"), _without(text, "!").alias("calm"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("d"))
    long = lambda c: c.cast("long")
    return counted.select(
        "doc_id", *keep, long(F.col("w.n")).alias("n_words"), long(F.col("inked")).alias("word_chars"),
        long(F.col("characters") - F.col("plain")).alias("n_symbols"), long(F.col("d")).alias("n_dup_lines"),
        long(F.col("w.r")).alias("n_repeat_words"), long(F.col("characters") - F.col("small")).alias("n_capitals"),
        long(F.col("characters") - F.col("calm")).alias("n_marks"))


def _rates() -> Column:
    """``(rule, value)`` structs of a document; values are whole numbers from 0 to ``STEPS``."""
    def rate(count: str, base: str) -> Column:
        return F.when(F.col(base) > 0, F.least(F.lit(STEPS), F.floor(1000 * F.col(count) / F.col(base)))).otherwise(0).cast("int")

    values = {"symbols": rate("n_symbols", "word_chars"), "duplicate_lines": rate("n_dup_lines", "n_words"),
              "repeats": rate("n_repeat_words", "n_words"), "capitals": rate("n_capitals", "word_chars"),
              "marks": rate("n_marks", "n_words"),
              "word_length": F.when(F.col("n_words") > 0, F.least(F.lit(STEPS), F.floor(10 * F.col("word_chars") / F.col("n_words"))))
              .otherwise(0).cast("int")}
    return F.array(*[F.struct(F.lit(name).alias("rule"), values[name].alias("value")) for name in RULES])


def allowed(n: Column, level: Column) -> Column:
    """The most good documents of ``n`` that a certified cutoff may reject; -1 if not even none.

    The largest k with P(Bin(n, RISK) <= k) <= level. Terms are carried as logarithms; with very many
    documents the sum starts 12 standard deviations below the mean, where less than 1e-30 is left out.
    """
    n = n.cast("double")
    mean = n * RISK
    odds = F.log(F.lit(RISK / (1 - RISK)))
    start = F.when(mean < 1e6, F.lit(0.0)).otherwise(F.floor(mean - 12 * F.sqrt(mean)).cast("double"))
    stirling = lambda x: (x + 0.5) * F.log(x) - x + 1 / (12 * x)  # noqa: E731  # ln x! without its constant
    first = n * F.log(F.lit(1 - RISK)) + F.when(start == 0, F.lit(0.0)).otherwise(
        stirling(n) - stirling(start) - stirling(n - start) - 0.9189385332046727 + start * odds)
    zero = F.struct(first.alias("term"), F.lit(0.0).alias("sum"), (start - 1).alias("k"))
    step = lambda s, i: F.struct(
        (s["term"] + F.log((n - i) / (i + 1)) + odds).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum"),
        F.when(s["sum"] + F.exp(s["term"]) <= level, i.cast("double")).otherwise(s["k"]).alias("k"))
    return F.aggregate(F.sequence(start.cast("long"), F.least(n - 1, F.ceil(mean)).cast("long")), zero, step)["k"].cast("long")


def cutoffs(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """``(stratum, rule, cutoff)``: documents of the stratum with a greater value are rejected.

    ``measured`` has a column ``stratum`` beside the counts, ``labels`` is ``(doc_id, quality)``.
    """
    marked = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    tally = (measured.join(marked, "doc_id").select("stratum", "quality", F.explode(_rates()).alias("v"))
             .groupBy("stratum", F.col("v.rule").alias("rule"), F.col("v.value").alias("value"))
             .agg(F.sum(F.expr("int(quality = 1)")).alias("good"), F.sum(F.expr("int(quality <> 1)")).alias("bad")))
    tally = reliable(tally)
    sizes = tally.groupBy("stratum", "rule").agg(F.sum("good").alias("n"))
    tests = sizes.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("tests"))
    limits = (sizes.where("n > 0").join(F.broadcast(tests))  # one row
              .select("stratum", "rule", allowed(F.col("n"), F.lit(LEVEL) / F.col("tests")).alias("most")))
    # rejected by the cutoff: all values above it
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    scored = (tally.select("stratum", "rule", "value", F.coalesce(F.sum("good").over(above), F.lit(0)).alias("good"),
                           F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("bad"))
              .join(limits, ["stratum", "rule"]))
    gain = F.col("bad") - COST * F.col("good")
    return (scored.where((F.col("good") <= F.col("most")) & (gain > 0))
            .groupBy("stratum", "rule").agg(F.max_by("value", F.struct(gain, "value")).alias("cutoff")))


def judged(documents: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Every row's counts, ``base_failed`` and ``kept``; cutoffs are learned from ``labels``."""
    measured = reliable(measures(documents, stratum).withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))))
    learned = cutoffs(measured, labels)
    by_rule = reliable(learned.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"most_{r}") for r in RULES]))
    value = _rates()
    broken = F.lit(False)
    for i, rule in enumerate(RULES):
        broken = broken | F.coalesce(value[i]["value"] > F.col(f"most_{rule}"), F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (measured.join(small_side(by_rule, 256), "stratum", "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~broken).alias("kept")))
