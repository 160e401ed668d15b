"""Merkle manifests against a tree built in plain Python."""

import zlib
from hashlib import sha256

import pytest
from odd_rows import documents, no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from repoquarry.llm import merkle as m

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return joined("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([joined(last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append((leaf_of(r[c] for c in FIELDS), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for found in by_lang.values():
        found.sort(key=lambda p: (p[1].doc_id is not None, p[1].doc_id or 0, p[0]))
    trees = {x: tree_of([leaf for leaf, _ in by_lang[x]]) for x in langs}
    top = tree_of([trees[x][-1][0] for x in langs])
    out = []
    for number, lang in enumerate(langs):
        for place, (leaf, r) in enumerate(by_lang[lang]):
            node, proof = leaf, []
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                node = leaf_of((r.doc_id, r.source, r.lang, r.n_chars, lowered(r.text)))
            for levels, at in ((trees[lang], place), (top, number)):
                for level in levels[:-1]:
                    run, k = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    proof += run[:k] + run[k + 1 :]
                    node = joined(run[:k] + [node] + run[k + 1 :])
                    at //= 8
            root = top[-1][0]
            out.append((r.doc_id, leaf, trees[lang][-1][0], root, joined(proof), node, node == root))
    return sorted(out, key=repr)


def proved(docs, height=m.HEIGHT):
    fields = [F.col(c) for c in FIELDS[:-1]]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, m.digest_of(*fields, lower))
    return m.manifest(docs, m.digest_of(*fields, F.col("text")), tampered, height=height)


def result(found):
    proof = F.sha2(F.array_join("proof", ""), 256)
    columns = ["doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified"]
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_documents_against_plain_python(documents, height):
    """One, several and no further rounds of superblocks."""
    found = result(proved(documents, height))
    assert found == brute(documents.collect())
    assert 0 < sum(r[-1] for r in found) < len(found)


def test_many_trees(documents):
    """More trees than a superblock of the last tree has room for, most of a single row."""
    docs = documents.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")))
    assert result(proved(docs, 1)) == brute(docs.collect())
    single = docs.where("doc_id % 2 = 0")
    assert result(proved(single)) == brute(single.collect())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_one_tree(spark, n):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"Text {i}") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string")
    assert result(proved(docs, 1)) == brute(docs.collect())


def test_odd_documents(odd_docs, no_docs):
    found = proved(odd_docs, 1)
    assert result(found) == brute(odd_docs.collect())
    assert {r.lang for r in odd_docs.collect()} == {None}
    clashing = odd_docs.withColumnsRenamed({"size": "tree", "score": "node"}).withColumn("root", F.lit(1))
    assert result(proved(clashing, 1)) == result(found)
    assert proved(no_docs).count() == 0


def test_no_id_at_all(odd_docs):
    docs = odd_docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert result(proved(docs, 1)) == brute(docs.collect())


def test_stored_proofs_verify_without_the_table(documents):
    found = proved(documents, 1)
    root = m.folded(F.col("leaf"), F.col("proof"), F.col("places"))
    assert found.where(root != F.col("root")).count() == 0
    wrong = m.folded(F.sha2(F.col("leaf"), 256), F.col("proof"), F.col("places"))
    assert found.where(wrong == F.col("root")).count() == 0
