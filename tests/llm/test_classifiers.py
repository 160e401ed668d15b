import numpy as np
import pytest
from odd_rows import DATA, documents, no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from repoquarry.llm import quality as q
from repoquarry.llm import toxicity as t

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")


@pytest.fixture(scope="module")
def toxic(larger):
    return t.fit_toxicity(*larger)


@pytest.fixture(scope="module")
def good(larger):
    return q.fit_quality(*larger)


def right(scored, labels, column):
    """Share of right predictions on the held-out fold, and that of the commonest label there."""
    rows = scored.join(labels, "doc_id").where("held_out").select(column, "predicted").toPandas()
    return (rows[column] == rows.predicted).mean(), max(rows[column].mean(), 1 - rows[column].mean())


def test_toxicity_beats_the_commonest_label(larger, toxic):
    accuracy, common = right(t.score_toxicity(larger[0], toxic), larger[1], "toxic")
    assert accuracy > common


def test_quality_is_nearly_right(larger, good):
    accuracy, common = right(q.score_quality(larger[0], good), larger[1], "quality")
    assert accuracy > max(common, 0.95)


def test_labels_of_the_held_out_folds_change_nothing(larger, toxic, good):
    docs, labels = larger
    for folds, fold, column, fit, model in ((5, 0, "toxic", t.fit_toxicity, toxic), (4, 2, "quality", q.fit_quality, good)):
        turned = F.when(t.is_held_out(F.col("doc_id"), folds, fold), 1 - F.col(column)).otherwise(F.col(column))
        again = fit(docs, labels.withColumn(column, turned))
        assert np.allclose(again.weights, model.weights)


def test_odd_rows_are_scored(odd_docs, no_docs, toxic, good):
    for scored in (t.score_toxicity(odd_docs, toxic), q.score_quality(odd_docs, good)):
        rows = scored.collect()
        assert len(rows) == odd_docs.count()
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
        by_id = {r.doc_id: r.score for r in rows}
        assert by_id[0] == by_id[1] and by_id[8] == by_id[9]
    assert t.score_toxicity(no_docs, toxic).count() == q.score_quality(no_docs, good).count() == 0
    kept = q.keep_quality(odd_docs, good)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()


def test_without_labels_or_texts(spark, documents, no_docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for few in (labels.where("false"), labels.withColumn("toxic", F.lit(None)).withColumn("quality", F.lit(None))):
        assert t.score_toxicity(documents, t.fit_toxicity(documents, few)).where("predicted = 1").count() == 0
        assert q.score_quality(documents, q.fit_quality(documents, few)).where("predicted = 0").count() == 0
    t.fit_toxicity(no_docs, labels)
    q.fit_quality(no_docs, labels)


def test_non_negative_risk_needs_no_clean_labels():
    draw = np.random.default_rng(1)
    # 300 toxic texts with a word of their own; half of them are confirmed, half among the unlabelled.
    texts = [np.unique([*draw.integers(0, 500, 20), *[900 + i % 3] * (i < 300)]) for i in range(3000)]
    positive = np.arange(3000) < 150
    counts = [np.bincount(np.concatenate([x for x, p in zip(texts, positive) if p == k]), minlength=1000) for k in (0, 1)]
    chosen = t.telling(counts[1].astype(float), counts[0].astype(float), 150, 2850)
    assert chosen.tolist() == [900, 901, 902]
    kept = [x[np.isin(x, chosen)] for x in texts]
    scorer = t.fit_nnpu(kept, positive, prior=0.1)
    dense = np.zeros(1 << t.BITS)
    dense[scorer.names] = scorer.weights
    marked = np.array([dense[x].sum() + scorer.bias > 0 for x in kept])
    assert marked[:300].all() and not marked[300:].any()


def test_isotonic_is_monotone_and_keeps_means():
    x, y = q.isotonic(np.arange(6.0), np.array([0, 3, 1, 2, 5, 4.0]), np.full(6, 5.0))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()
    assert y[-1] == 0.9 and y[0] == 0


def test_fourier_features_approach_the_kernel():
    draw = np.random.default_rng(2)
    x, y = draw.standard_normal((2, q.STATISTICS)) * 0.5
    z = q.fourier(np.stack([x, y]))[:, :-1]
    exact = np.mean([np.exp(-((x - y) ** 2).sum() / 2 / w**2) for w in q.WIDTHS])
    assert abs(z[0] @ z[1] - exact) < 0.15
