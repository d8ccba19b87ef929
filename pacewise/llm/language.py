"""Language identification by words first, with backoff to character n-grams.

The model holds, per language, log frequencies of the commonest words and of character
n-grams of lengths 5 to 1. A known word is scored by its log frequency in each language; an
unseen word by its longest known n-grams: at each position of the word the longest known
n-gram counts, with a discount for every letter dropped. A text's prediction is the language
with the greatest sum over its words; the score is the softmax of mean word scores.

Words are runs of letters, lower case. The fit takes at most ``FIT_DOCUMENTS`` labelled
documents, chosen by a hash of the id; the tables keep ``MODEL_WORDS`` words and
``MODEL_GRAMS`` n-grams, which bounds the broadcast model.

Defined cases. A text that is null or has no letter gets ``und`` with score 0. Rows without a
language are not learned from. Without any labelled row every text gets ``und``. A null id is
held out by definition (its hash is null) and still predicted. Repeated rows repeat.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.llm.words import slices, tidy
from pacewise.session import reliable

UNKNOWN = "und"
FIT_DOCUMENTS = 100_000
MODEL_WORDS = 100_000
MODEL_GRAMS = 100_000
LONGEST = 5
DISCOUNT = math.log(0.4)
TASK_ENTRIES = 150_000   # counts a task holds before it hands them on
MEMO_WORDS = 200_000
CHUNK_CHARACTERS = 1 << 20

_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(column="doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def grams_of(word: str):
    """Character n-grams of a word with its borders, longest first at each position."""
    padded = f" {word} "
    for i in range(len(padded)):
        for n in range(min(LONGEST, len(padded) - i), 0, -1):
            yield padded[i:i + n]


@dataclass
class LanguageModel:
    """Rows of ``word_scores`` and ``gram_scores`` hold log frequencies, one column per language."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]      # the last row of gram_scores stands for an unknown letter
    gram_scores: np.ndarray

    def backoff(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words: mean over positions of the longest known n-gram, discounted."""
        rows, dropped, sizes, grams, unknown = [], [], [], self.grams, len(self.gram_scores) - 1
        for word in words:
            padded, before = f" {word} ", len(rows)
            length = len(padded)
            for i in range(length - 1):
                longest = min(LONGEST, length - i)
                for size in range(longest, 0, -1):
                    row = grams.get(padded[i:i + size])
                    if row is not None:
                        rows.append(row)
                        dropped.append(longest - size)
                        break
                else:
                    rows.append(unknown)
                    dropped.append(longest)
            sizes.append(len(rows) - before)
        scores = self.gram_scores[rows] + (np.array(dropped) * DISCOUNT)[:, None]
        sizes = np.array(sizes)
        return np.add.reduceat(scores, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]

    def predict(self, texts: list[str | None], memo: dict[str, int], table: np.ndarray):
        """Languages, scores, and the table of word scores; ``memo`` maps words to its rows."""
        split = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), table
        fresh = list({w for words in split for w in words if w not in memo})
        seen = [w for w in fresh if w in self.words]
        unseen = [w for w in fresh if w not in self.words]
        memo.update(zip(seen + unseen, range(len(table), len(table) + len(fresh))))
        if seen:
            table = np.concatenate((table, self.word_scores[[self.words[w] for w in seen]]))
        if unseen:
            table = np.concatenate((table, self.backoff(unseen)))
        sizes = np.array([len(words) for words in split], np.int64)
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        filled = np.flatnonzero(sizes)
        if len(filled):
            rows = np.fromiter((memo[w] for words in split for w in words), np.int64, int(sizes.sum()))
            counts = sizes[filled]
            mean = np.add.reduceat(table[rows], np.cumsum(counts) - counts, axis=0) / counts[:, None]
            best = mean.argmax(axis=1)
            sure = 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k, score in zip(filled.tolist(), best.tolist(), sure.tolist()):
                langs[i], scores[i] = self.languages[k], score
        return langs, scores, table


def _counts(batches):
    """Counts of words and n-grams per language; kind is 0 for words, else the length."""
    held: Counter = Counter()
    for batch in batches:
        for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.update((lang, word) for word in _LETTERS.findall((value.as_py() or "").lower()))
            if len(held) > TASK_ENTRIES:
                yield _count_batch(held)
                held = Counter()
    if held:
        yield _count_batch(held)


def _count_batch(held: Counter) -> pa.RecordBatch:
    keys = list(held)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                       pa.array(list(held.values()), pa.int64())], names=["lang", "item", "times"])


def _gram_counts(batches):
    held: Counter = Counter()
    for batch in batches:
        for lang, word, times in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for gram in grams_of(word):
                held[lang, gram] += times
            if len(held) > TASK_ENTRIES:
                yield _count_batch(held)
                held = Counter()
    if held:
        yield _count_batch(held)


def _top(counts: DataFrame, most: int) -> tuple[dict[str, dict[str, int]], dict[str, int]]:
    """Counts per language of the ``most`` commonest items, and each language's total over all items."""
    counts = reliable(counts)
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("times").alias("total")).collect()}
    items = counts.groupBy("item").agg(F.sum("times").alias("all")).orderBy(F.desc("all"), "item").limit(most)
    rows = counts.join(F.broadcast(items.select("item")), "item").toArrow().to_pydict()
    table: dict[str, dict[str, int]] = {}
    for lang, item, times in zip(rows["lang"], rows["item"], rows["times"]):
        table.setdefault(item, {})[lang] = times
    return table, totals


def fit(documents: DataFrame, most: int = FIT_DOCUMENTS) -> LanguageModel:
    """Learn from ``(doc_id, text, lang)`` rows with a language that are not held out."""
    usable = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    count = usable.count()
    if count > most:
        share = int(most / count * (1 << 30))
        usable = usable.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 30)) < share)
    words = reliable(usable.select("lang", "text").mapInArrow(tidy(_counts), "lang string, item string, times long")
                     .groupBy("lang", "item").agg(F.sum("times").alias("times")))
    # an unseen word is scored by grams learned from rare and common words alike: types, not tokens
    grams = (words.select("lang", "item", F.least(F.col("times"), F.lit(20)).alias("times"))
             .mapInArrow(tidy(_gram_counts), "lang string, item string, times long")
             .groupBy("lang", "item").agg(F.sum("times").alias("times")))
    word_table, word_totals = _top(words, MODEL_WORDS)
    gram_table, _ = _top(grams, MODEL_GRAMS)
    languages = sorted(word_totals)
    if not languages:
        return LanguageModel([], {}, np.zeros((0, 0)), {}, np.zeros((1, 0)))
    word_scores = np.array([[math.log((row.get(lang, 0) + 0.5) / (word_totals[lang] + 0.5 * len(word_table)))
                             for lang in languages] for row in word_table.values()]).reshape(-1, len(languages))
    by_length: dict[int, dict[str, int]] = {}
    for gram, row in gram_table.items():
        sums = by_length.setdefault(len(gram), dict.fromkeys(languages, 0))
        for lang, times in row.items():
            sums[lang] += times
    gram_scores = np.array([[math.log((row.get(lang, 0) + 0.5) / (by_length[len(gram)][lang] + 1000.0)) for lang in languages]
                            for gram, row in gram_table.items()]).reshape(-1, len(languages))
    floor = np.full((1, len(languages)), gram_scores.min() if gram_scores.size else -20.0)
    return LanguageModel(languages, {w: i for i, w in enumerate(word_table)}, word_scores,
                         {g: i for i, g in enumerate(gram_table)}, np.concatenate((gram_scores, floor)))


def predict(documents: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",),
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every row, then the predicted language of its text and the score, called ``names``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*[documents[f"`{c}`"] for c in keep], *(["text"] if "text" not in keep else []))
    at, width = rows.columns.index("text"), len(keep)
    fields = [*rows.schema.fields[:width], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]

    def run(batches):
        learned = shared.value
        memo: dict[str, int] = {}
        scores_of = np.zeros((0, len(learned.languages)))
        for batch in slices(batches):
            langs, scores, held, length = [], [], [], 0
            column = batch.column(at)
            for i, value in enumerate(column):
                held.append(value.as_py())
                length += len(held[-1] or "")
                if length > CHUNK_CHARACTERS or i == len(column) - 1:
                    if len(memo) > MEMO_WORDS:
                        memo, scores_of = {}, scores_of[:0]
                    some, sure, scores_of = learned.predict(held, memo, scores_of)
                    langs += some
                    scores += sure
                    held, length = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names[:width], *names])

    return rows.mapInArrow(tidy(run), T.StructType(fields))


def identified(documents: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row, with a model learned from the rows not held out."""
    model = fit(documents)
    return (predict(documents, model)
            .select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "lang_pred", "score"))
