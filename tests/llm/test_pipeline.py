"""The corpus pipeline from end to end: every stage's stored rows against plain Python with the fitted models."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from odd_rows import DATA, documents, no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F
from test_duplicates import brute_documents
from tokenizers import Tokenizer

from repoquarry.llm import decontaminate, quality, secrets

NAMES = ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "bpe_encoding"]


def plain(name, docs, rows, labels, benchmark):
    """What a stage makes of ``rows``, which are those of ``docs``."""
    if name == "quality_classifier":
        model = quality.fit_quality(docs, labels)
        return [r for r in rows if model.scores([(r["text"] or "").encode()])[0] >= 0.7]
    if name == "minhash_near_dedup":
        first = {i: kept for i, _, _, kept in brute_documents({r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}.items())}
        return [r for r in rows if r["doc_id"] is None or first[r["doc_id"]]]
    if name == "benchmark_decontamination":
        matcher = decontaminate.Matcher(decontaminate.fit_space(docs), decontaminate.benchmark_items(benchmark))
        return [r for r in rows if not matcher.find([(r["text"] or "").encode()])]
    if name == "secret_scans":
        detector, out = secrets.fit_detector(docs), []
        for r in rows:
            hidden = np.zeros(len(r["text"] or ""), dtype=int)
            for a, b, _ in detector.spans([r["text"] or ""])[0]:
                hidden[a:b] = 1
            if hidden.any():
                text = secrets.redacted(r["text"], detector.spans([r["text"]])[0])
                assert text.replace("[SECRET]", "") == "".join(c for c, h in zip(r["text"], hidden) if not h)
                r = {**r, "text": text, "n_chars": len(text)}
            out.append(r)
        return out
    library, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        out.append((r["doc_id"], len(ids), *digests, ids))
    return out


def counted(rows):
    return Counter(repr(sorted(r.items()) if isinstance(r, dict) else r) for r in rows)


def run_and_compare(spark, monkeypatch, folder, docs, labels, benchmark):
    """Runs the pipeline; (rows before, rows after) of each stage that was checked."""
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{folder}/{name}.parquet")
    named = []
    monkeypatch.setattr(corpus_pipeline, "new_folder", lambda _, name: named.append(name) or f"{folder}/stage-{name}")
    result = corpus_pipeline.run(spark, str(folder))
    assert named == NAMES == [name for name, _ in corpus_pipeline.STAGES]
    before, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name in NAMES:
        after = spark.read.parquet(f"{folder}/stage-{name}")
        rows = [r.asDict() for r in before.collect()]
        if name == NAMES[-1]:
            found = [tuple(r) for r in result.collect()]
            found = [(*r[:4], np.frombuffer(bytes(r[4]), "<u4").tolist() if isinstance(r[4], (bytes, bytearray)) else list(r[4])) for r in found]
        else:
            assert after.columns == docs.columns
            found = [r.asDict() for r in after.collect()]
        assert counted(found) == counted(plain(name, before, rows, labels, benchmark)), name
        out[name] = rows, found
        before = after
    return out


@pytest.fixture
def tables(spark):
    return [spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("labels", "benchmark")]


def test_documents_through_all_stages(spark, monkeypatch, tmp_path, documents, tables):
    out = run_and_compare(spark, monkeypatch, tmp_path, documents, *tables)
    before, after = out["quality_classifier"]
    assert 0 < len(after) < len(before)
    assert out["bpe_encoding"][1]


def test_odd_documents_through_all_stages(spark, monkeypatch, tmp_path, documents, odd_docs, tables):
    item = max((r.text for r in tables[1].collect()), key=len)
    more = [
        (101, f"some words before {item} and after", None, "s", 7, 1, 0.5),
        (102, "login with password=Zk8Qw1xYt7Lm then go on", "en", "s", 7, 2, 0.5),
        (None, "no id but secret: Zk8Qw1xYt7LmPq9 here", "en", None, None, 3, None),
    ]
    usual = documents.withColumns({"doc_id": F.col("doc_id") + 1000, "size": F.lit(0).cast("long"), "score": F.lit(0.1)})
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema)).unionByName(usual.select(odd_docs.columns))
    # Without labels nothing is rejected, and every odd row reaches the later stages.
    out = run_and_compare(spark, monkeypatch, tmp_path, docs, tables[0].where("false"), tables[1])
    ids = [sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out[name][1] if (r["doc_id"] or 0) < 1000) for name in NAMES[:4]]
    # Both rows of the repeated document are a copy of an earlier one; one document holds an item.
    assert ids[0] == [-1, -1, *range(10), 9, 101, 102]
    assert ids[1] == [-1, -1, *range(9), 101, 102]
    assert ids[2] == ids[3] == [-1, -1, *range(9), 102]
    redacted = {r["doc_id"]: r for r in out["secret_scans"][1] if "[SECRET]" in (r["text"] or "")}
    assert redacted[102]["text"] == "login with [SECRET] then go on" and redacted[102]["n_chars"] == 30
    assert redacted[None]["n_chars"] == len(redacted[None]["text"])


def test_no_documents_through_all_stages(spark, monkeypatch, tmp_path, no_docs, tables):
    out = run_and_compare(spark, monkeypatch, tmp_path, no_docs, *tables)
    assert all(rows == found == [] for rows, found in out.values())
