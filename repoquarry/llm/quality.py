"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text are standardised, mapped to random cosine features whose inner products approach
a Gaussian kernel, and fitted by ridge regression whose normal equations are sums over partitions. The
raw scores of rows kept out of the regression are calibrated by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.sums import summed
from repoquarry.llm.toxicity import is_held_out
from repoquarry.llm.words import Words, mix, slices
from repoquarry.sources.shared import materialize

# Cosine features, their seed, the widths of the kernels and the ridge.
FEATURES = 384
SEED = 20
WIDTHS = (2.0, 5.0)
RIDGE = 1.0
# Scores are calibrated on so many bins at most.
BINS = 2048

# Statistics need some thirty bytes of memory for each byte of text.
_SLICE = 1 << 20

# Classes of bytes: 1 upper case, 2 lower case, 3 digits, 4 sentence marks, 5 symbols, 6 beyond ASCII, 7 line ends.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:], _CLASS[10] = 1, 2, 3, 6, 7
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = 4 if chr(_c) in ".,;:'\"-()" else 5
STATISTICS = 24


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``STATISTICS`` numbers per text; a text without words has zeros for all shares."""
    words = Words(texts)
    hashes, out = words.hashes(), np.zeros((len(texts), STATISTICS))
    lengths = words.ends - words.starts
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    classes = _CLASS[joined]
    first, last = joined[words.starts] if len(hashes) else joined[:0], joined[words.ends - 1] if len(hashes) else joined[:0]
    marked = (_CLASS[last] == 5) if len(hashes) else np.zeros(0, bool)
    no_letters = np.ones(len(hashes), dtype=bool)
    if len(hashes):
        letters = np.concatenate(([0], np.cumsum((classes == 1) | (classes == 2) | (classes == 6))))
        upper = np.concatenate(([0], np.cumsum(classes == 1)))
        no_letters = letters[words.ends] == letters[words.starts]
        shouted = (upper[words.ends] - upper[words.starts] >= 2) & (lengths >= 2)
        repeats = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    for i in range(len(texts)):
        a, b = words.bounds[i], words.bounds[i + 1]
        n, size = b - a, len(texts[i])
        if n == 0:
            continue
        part, own = classes[words.text_starts[i] : words.text_starts[i] + size], hashes[a:b]
        counts = np.bincount(part, minlength=8)
        distinct, times = np.unique(own, return_counts=True)
        pairs = np.unique(mix(own[1:] ^ mix(own[:-1])), return_counts=True)[1] if n > 1 else np.ones(1)
        breaks = np.flatnonzero(part == 7)
        starts = np.searchsorted(words.starts[a:b], words.text_starts[i] + np.concatenate(([0], breaks)))
        starts = np.unique(starts[starts < n])
        lines = np.add.reduceat(own, starts)
        line_words = np.diff(np.append(starts, n))
        out[i] = [
            np.log1p(n),
            lengths[a:b].mean(),
            lengths[a:b].std(),
            np.log1p(lengths[a:b].max()),
            *(counts[1:8] / size),
            no_letters[a:b].mean(),
            marked[a:b].mean(),
            shouted[a:b].mean(),
            (repeats[a + 1 : b].mean() if n > 1 else 0.0),
            len(distinct) / n,
            times.max() / n,
            (pairs > 1).sum() / len(pairs),
            pairs.max() / max(1, n - 1),
            1 - len(np.unique(lines)) / len(lines),
            np.log1p(line_words.mean()),
            (lengths[a:b] >= 12).mean(),
            (_CLASS[first[a:b]] == 1).mean(),
            (_CLASS[last[a:b]] == 4).mean(),
        ]
    return out


@dataclass
class Quality:
    """Everything that turns statistics into a score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        return fourier((stats - self.mean) / self.scale)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.features(statistics(texts)) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def fourier(standard: np.ndarray) -> np.ndarray:
    draw = np.random.default_rng(SEED)
    directions = draw.standard_normal((STATISTICS, FEATURES)) / np.repeat(WIDTHS, FEATURES // len(WIDTHS))
    phases = draw.uniform(0, 2 * np.pi, FEATURES)
    # Far outliers would turn through many periods.
    out = np.cos(np.clip(standard, -8, 8) @ directions + phases) * np.sqrt(2.0 / FEATURES)
    return np.hstack([out, np.ones((len(out), 1))])


def isotonic(scores: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means of (sums / counts) over sorted scores: the centres of the blocks and their means."""
    blocks: list[list[float]] = []
    for x, s, n in zip(scores, sums, counts):
        blocks.append([x * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    centres = np.array([b[0] / b[2] for b in blocks])
    return centres, np.array([b[1] / b[2] for b in blocks])


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, part in slices(batch.column(1), _SLICE):
            found = pa.array([row.tobytes() for row in statistics(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), found], ["doc_id", "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, STATISTICS)


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> Quality:
    """Learns from all labelled texts outside of the held-out fold.

    Four fifths of them, by a hash of the id, enter the regression, the rest the calibration. Texts stay
    where they are: statistics join the labels, and only sums reach the driver: moments, one matrix of
    ``FEATURES`` squared, and at most ``BINS`` calibration bins. Without labels, or with one class only,
    every text has the score of that class (1.0 without any).
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
    known = known.agg(F.max("quality").cast("double").alias("target")).where(~is_held_out(F.col("doc_id"), folds, fold))
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_stats_rows, f"doc_id {kind}, stats binary")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    rows = materialize(
        stats.join(known, "doc_id").select("stats", "target", calibrates.alias("calibrates")), "quality-rows"
    )

    def moments(batches):
        total = np.zeros((1, 2 * STATISTICS + 1))
        for batch in batches:
            x = _matrix(batch.column(0))
            total += np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])
        return total

    sums = summed(rows, moments, 2 * STATISTICS + 1).sum(axis=0)
    n = max(1.0, sums[0])
    mean = sums[1 : STATISTICS + 1] / n
    scale = np.sqrt(np.maximum(sums[STATISTICS + 1 :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    width = FEATURES + 1

    def normal(batches):
        total = np.zeros((width, width + 1))
        for batch in batches:
            use = ~np.array(batch.column(2).to_pylist(), dtype=bool)
            if use.any():
                z = fourier((_matrix(batch.column(0))[use] - mean) / scale)
                y = np.array(batch.column(1).to_pylist())[use]
                total += z.T @ np.hstack([z, y[:, None]])
        return total

    equations = summed(rows, normal, width + 1)
    if not len(equations) or not equations.any():
        equations = np.zeros((width, width + 1))
    penalty = RIDGE * np.eye(width)
    penalty[-1, -1] = 1e-6
    weights = np.linalg.solve(equations[:, :-1] + penalty, equations[:, -1])
    model = Quality(mean, scale, weights, np.array([0.0]), np.array([0.0]))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.features(_matrix(batch.column(0))) @ model.weights if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(scores), batch.column(1)], ["raw", "target"])

    scored = rows.where("calibrates").mapInArrow(raw, "raw double, target double")
    bin_ = F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) + 0.5) / 2 * (BINS - 1))
    bins = scored.groupBy(bin_.alias("bin")).agg(
        F.avg("raw").alias("x"), F.sum("target").alias("s"), F.count("*").cast("double").alias("n")
    )
    found = sorted(bins.collect())
    if found:
        model.knots, model.values = isotonic(*(np.array([r[k] for r in found]) for k in ("x", "s", "n")))
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0]) if sums[0] else np.ones(2)
    return model


def score_quality(docs: DataFrame, model: Quality, folds: int = 4, fold: int = 2, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; a narrow job.

    Null and empty texts get the score of a text without words. Rows without an id are scored and not
    held out, repeated rows are scored each for themselves, other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2), _SLICE):
                ids = [batch.column(i).slice(first, len(part)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(model.scores(part))], ["doc_id", "held_out", "score"])

    held = is_held_out(F.col("doc_id"), folds, fold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: Quality, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``; a narrow job."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(part) for _, part in slices(batch.column(place), _SLICE)]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
