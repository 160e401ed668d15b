"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives, all other sampled texts count as unlabelled, whatever their label
says. With the share ``prior`` of toxic texts, the risk of a scorer g on the whole is
``prior * R+(positives) + R-(unlabelled) - prior * R-(positives)``; the last two terms estimate the risk
on clean texts and cannot be negative, so when an overfitting scorer makes them negative the step goes
the other way. The scorer is linear in hashed words and word beginnings, trained in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.words import NO_LETTERS, Words, slices
from repoquarry.sources.shared import materialize

BITS = 18
_PREFIXES = (4, 5, 6)
# Texts the scorer is fitted on: at most so many positives and so many unlabelled ones, by hash order.
MOST_POSITIVE = 6000
MOST_UNLABELLED = 16000
# Standard deviations by which the shares of a feature must differ, and fitted texts it must be in.
_DEVIATIONS = 4.0
_LEAST_TEXTS = 4


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct hashed features of each text."""
    words = Words(texts, NO_LETTERS)
    hashed = [words.hashes(), *(words.prefix_hashes(n) for n in _PREFIXES)]
    places = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in hashed], axis=1)
    return [np.unique(places[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:])]


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(other columns, text) to (other columns, features as little-endian 32-bit numbers)."""
    for batch in batches:
        others, texts = batch.columns[:-1], batch.columns[-1]
        for first, part in slices(texts):
            found = pa.array([f.astype("<i4").tobytes() for f in features(part)], pa.binary())
            rows = [c.slice(first, len(part)) for c in others]
            yield pa.RecordBatch.from_arrays([*rows, found], [*batch.schema.names[:-1], "features"])


@dataclass
class Scorer:
    """Weights of the features ``names``; all others weigh nothing."""

    names: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """From 0 to 1; a text without words has the score of the bias."""
        dense = np.zeros(1 << BITS)
        dense[self.names] = self.weights
        sums = np.array([dense[f].sum() for f in features(texts)], dtype=float)
        return 1.0 / (1.0 + np.exp(-np.clip(sums + self.bias, -50, 50)))


def telling(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int) -> np.ndarray:
    """Features whose share among positives differs from that among unlabelled texts beyond chance."""
    share = (positive + unlabelled) / max(1, n_positive + n_unlabelled)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(1, n_positive) + 1 / max(1, n_unlabelled)))
    apart = np.abs(positive / max(1, n_positive) - unlabelled / max(1, n_unlabelled))
    return np.flatnonzero((apart > _DEVIATIONS * spread) & (positive + unlabelled >= _LEAST_TEXTS))


def fit_nnpu(
    texts: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 0.35
) -> Scorer:
    """Fits the scorer by full-batch Adam on the non-negative risk with the logistic loss.

    Weights decay by ``decay`` over the number of positives: the fewer there are, the less is believed.
    """
    if not positive.any() or positive.all() or not 0 < prior < 1:
        # Nothing to tell texts apart by: every text has the same score.
        return Scorer(np.array([], int), np.array([]), 10.0 if positive.any() and positive.all() else -10.0)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    names, columns = np.unique(np.concatenate(texts), return_inverse=True)
    # The last weight is the bias.
    w = np.append(np.zeros(len(names)), np.log(prior / (1 - prior)))
    n_positive, n_unlabelled = positive.sum(), (~positive).sum()
    decay = decay / n_positive
    mean, square, total = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    # Steps against the clean risk come and go; the average over the last half is steadier than the end.
    averaged = steps // 2
    for step in range(1, steps + 1):
        g = np.bincount(rows, w[columns], len(texts)) + w[-1]
        toxic = 1.0 / (1.0 + np.exp(-np.clip(g, -50, 50)))
        as_clean = np.logaddexp(0, g)
        clean_risk = as_clean[~positive].mean() - prior * as_clean[positive].mean()
        # Slopes of the risk on clean texts, and of that on toxic ones.
        clean = np.where(positive, -prior / n_positive, 1.0 / n_unlabelled) * toxic
        pull = clean + np.where(positive, prior / n_positive, 0.0) * (toxic - 1.0) if clean_risk >= 0 else -clean
        gradient = np.append(np.bincount(columns, pull[rows], len(names)) + decay * w[:-1], pull.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        total += w if step > steps - averaged else 0.0
    w = total / averaged
    return Scorer(names, w[:-1], float(w[-1]))


def is_held_out(id_column: Column, folds: int, fold: int) -> Column:
    """Whether a row belongs to the fold that no label is learned from; rows without an id do not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Scorer:
    """Learns from ``labels`` (doc_id, toxic) outside of the held-out fold and from texts of any label.

    The fit uses at most ``MOST_POSITIVE`` texts labelled 1 and ``MOST_UNLABELLED`` texts whose labels
    are not looked at, both the first in order of a hash of the id. The prior is the share of 1 among
    all labels outside of the fold. Ids of the sample, counts per feature (2 ** ``BITS`` at most) and
    the telling features of the sample are all that the driver sees.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~is_held_out(F.col("doc_id"), folds, fold))
    prior = known.agg(F.avg("toxic")).head()[0] or 0.0
    order = F.xxhash64("doc_id", F.lit(17))
    learned = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), folds, fold))
    toxic = learned.join(known.where("toxic = 1"), "doc_id", "left_semi").distinct()
    positive = toxic.orderBy(order, "doc_id").limit(MOST_POSITIVE).withColumn("positive", F.lit(True))
    others = learned.distinct().orderBy(order, "doc_id").limit(MOST_UNLABELLED).withColumn("positive", F.lit(False))
    # At most MOST_POSITIVE + MOST_UNLABELLED numbers.
    sample = docs.join(F.broadcast(positive.unionByName(others)), "doc_id").select("positive", F.col("text").cast("string"))
    stored = materialize(sample.mapInArrow(feature_rows, "positive boolean, features binary"), "toxicity-sample")
    n = {r["positive"]: r["count"] for r in stored.groupBy("positive").count().collect()}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for is_positive, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[int(is_positive)][np.frombuffer(found, "<i4")] += 1
        seen = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[0][seen]), pa.array(sums[1][seen])], ["f", "u", "p"])

    summed = stored.mapInArrow(counts, "f bigint, u bigint, p bigint").groupBy("f").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    table = summed.toPandas()
    chosen = telling(table.p.to_numpy(float), table.u.to_numpy(float), n.get(True, 0), n.get(False, 0))
    names = np.sort(table.f.to_numpy(dtype=np.int64)[chosen])

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(f, "<i4") for f in batch.column(1).to_pylist()]
            kept = [f[np.isin(f, names)].tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], ["positive", "features"])

    fitted = stored.mapInArrow(narrowed, "positive boolean, features binary").toArrow()
    # Row order differs between runs; sums of the fit should not.
    rows = sorted(zip(fitted.column(0).to_pylist(), fitted.column(1).to_pylist()))
    texts = [np.frombuffer(f, "<i4") for _, f in rows]
    return fit_nnpu(texts, np.array([p for p, _ in rows], dtype=bool), float(prior))


def score_toxicity(docs: DataFrame, scorer: Scorer, folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; a narrow job.

    Null and empty texts get the score of a text without words. Rows without an id are scored and not
    held out, repeated rows are scored each for themselves, other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2)):
                found = pa.array(scorer.scores(part), pa.float64())
                ids = [batch.column(i).slice(first, len(part)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, found], ["doc_id", "held_out", "score"])

    held = is_held_out(F.col("doc_id"), folds, fold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
