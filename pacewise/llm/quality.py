"""Quality scores: kernel ridge by random Fourier features over text statistics, then isotonic calibration.

Statistics of a whole text are standardized; cosines of random projections of them
approximate a Gaussian kernel. Each task sums its part of the normal equations, Spark adds
the parts up, and the driver solves one small system. Fitted values become probabilities by
pool-adjacent-violators over counts of ``BINS`` bins.

The fit takes at most ``FIT_ROWS`` labelled rows, chosen by a hash of the id. Scores use the
text alone.

Defined cases. A null text is empty; an empty text has all statistics 0 and gets the score of
that point. Null labels are not learned from; several labels of a document count as their
least. A null id is held out. Without labelled rows every score is 0.5. Other columns are
ignored; repeated rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.llm.language import held_out
from pacewise.llm.words import chunks, word_hashes, word_spans
from pacewise.session import reliable

FIT_ROWS = 200_000
FEATURES = 256       # random Fourier features
WIDTH = 2.0          # of the kernel, in units of sqrt(statistics)
RIDGE = 1e-3         # per fitted row
BINS = 512
ACCEPT = 0.3
FIT_TASKS = 16

_SETS = (b"!", b"|", b"#*$%&<>", b".,;:?", bytes(range(65, 91)), bytes(range(48, 58)), b"\n", b"@/\\_=+~^`{}[]",
         bytes(range(0xC2, 0xF5)))
_KIND = np.full(256, 255, np.uint8)
for _i, _set in enumerate(_SETS):
    _KIND[list(_set)] = _i
NAMES = ("words", "length", "longest", "repeats", "distinct",
         "exclamations", "bars", "symbols", "stops", "capitals", "digits", "lines", "marks", "wide")


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    out = np.zeros((len(column), len(NAMES)))
    for first, end, data, offsets in chunks(column):
        starts, ends, at = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends, lower=False)
        sizes = ends - starts
        counts = np.diff(at)
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        n = counts[some].astype(float)
        cut = at[:-1][some]
        same = np.zeros(len(hashes))
        same[1:] = hashes[1:] == hashes[:-1]
        same[cut] = 0
        row = first + some
        out[row, 0] = np.log1p(n)
        out[row, 1] = np.add.reduceat(sizes, cut) / n
        out[row, 2] = np.log1p(np.maximum.reduceat(sizes, cut))
        out[row, 3] = np.log1p(200 * np.add.reduceat(same, cut) / n)
        order = np.lexsort((hashes, np.repeat(np.arange(end - first), counts)))
        repeated = np.zeros(len(hashes))
        repeated[1:] = hashes[order][1:] == hashes[order][:-1]
        repeated[cut] = 0
        out[row, 4] = 1 - np.add.reduceat(repeated, cut) / n
        kinds = _KIND[data]
        for k in range(len(_SETS)):
            total = np.r_[0, np.cumsum(kinds == k)]
            out[row, 5 + k] = np.log1p(200 * (total[offsets[1:]] - total[offsets[:-1]])[some] / n)
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    solution: np.ndarray | None = None
    steps: np.ndarray | None = None      # calibrated value of each bin of the raw score

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        waves = np.cos(z @ self.weights + self.phases) * np.sqrt(2 / max(1, len(self.phases)))
        return np.concatenate((np.ones((len(z), 1)), z, waves), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.solution

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.solution is None:
            return np.full(len(x), 0.5)
        return self.steps[bin_of(self.raw(x))]


def bin_of(raw: np.ndarray) -> np.ndarray:
    """Bins of fitted values, which lie about 0 to 1; values beyond go to the outer bins."""
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Non-decreasing means of the bins, by pooling adjacent violators; empty bins take the value to their left."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(counts):
        blocks.append([float(sums[i]), float(counts[i]), int(i)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
    out = np.full(len(counts), 0.5)
    for k, (s, c, first) in enumerate(blocks):
        out[(first if k else 0):] = s / c
    return out


def statistics_of(documents: DataFrame) -> DataFrame:
    """``(doc_id, x)`` for every row."""
    def run(batches):
        for batch in batches:
            values = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()),
                 pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * len(NAMES), values.ravel())],
                names=["doc_id", "x"])
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _sum_rows(table: pa.Table) -> pa.Table:
    rows = table.column("sums").combine_chunks()
    total = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(axis=0)
    return pa.table({"i": table.column("i")[:1], "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})


def fit(known: DataFrame, most: int = FIT_ROWS, seed: int = 7) -> QualityModel | None:
    """Fit ``(doc_id, x, label)`` rows; None if there are none."""
    count = known.count()
    if count == 0:
        return None
    if count > most:
        share = int(most / count * (1 << 30))
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) < share)
    known = reliable(known.repartition(FIT_TASKS, "doc_id"))
    moments = known.agg(F.count(F.lit(1)), *[f(F.col("x")[i]) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]).first()
    size, moments = moments[0], np.array(moments[1:], float)
    random = np.random.default_rng(seed)
    features = int(min(FEATURES, max(8, size // 10)))
    model = QualityModel(moments[0::2], np.maximum(moments[1::2], 1e-6),
                         random.normal(size=(len(NAMES), features)) / (WIDTH * np.sqrt(len(NAMES))),
                         random.uniform(0, 2 * np.pi, features))
    wide = 1 + len(NAMES) + features

    def sums(batches):
        total = np.zeros((wide, wide + 1))
        for batch in batches:
            basis = model.basis(_matrix(batch.column(0)))
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += basis.T @ np.concatenate((basis, label[:, None]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(wide), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         names=["i", "sums"])

    rows = (known.select("x", "label").mapInArrow(sums, "i int, sums array<double>")
            .groupBy("i").applyInArrow(_sum_rows, "i int, sums array<double>").orderBy("i").toArrow())
    system = rows.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(wide, wide + 1)
    ridge = np.eye(wide) * RIDGE * size
    ridge[0, 0] = 1e-9
    model.solution = np.linalg.solve(system[:, :wide] + ridge, system[:, wide])

    def bins(batches):
        n, y = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            at = bin_of(model.raw(_matrix(batch.column(0))))
            n += np.bincount(at, minlength=BINS)
            y += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), BINS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(n), pa.array(y)], names=["bin", "n", "y"])

    tally = (known.select("x", "label").mapInArrow(bins, "bin int, n long, y long")
             .groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect())
    n, y = np.zeros(BINS), np.zeros(BINS)
    for r in tally:
        n[r.bin], y[r.bin] = r.n, r.y
    model.steps = isotonic(n, y)
    return model


def quality_scores(documents: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``documents``; learned from ``labels (doc_id, quality)``."""
    described = reliable(statistics_of(documents))
    marked = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")))
    model = fit(described.join(marked, "doc_id").select("doc_id", "x", "label"))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            score = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return (described.mapInArrow(run, "doc_id long, score double")
            .select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "score",
                    (F.col("score") >= accept).cast("int").alias("predicted")))
