"""Line dedup: the filter against a set, the index against plain Python, inserted and deleted documents."""

import hashlib
import random

import numpy as np
import pytest
from odd_rows import documents, no_docs, odd_docs  # noqa: F401

from repoquarry.llm import lines as ls
from repoquarry.llm.cuckoo import Cuckoo


def digests(n, seed):
    draw = random.Random(seed)
    return [draw.randbytes(16) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 5, 3000, 20000])
def test_filter_holds_what_was_inserted(n):
    inside, outside = digests(n, 1), digests(5000, 2)
    made = Cuckoo.of(inside)
    assert not n or made.holds(inside).all()
    assert made.holds(outside).mean() < 0.001 and len(made) == n
    again = Cuckoo.from_bytes(made.to_bytes())
    assert (again.table == made.table).all()


def test_filter_forgets_what_was_removed():
    some, others = digests(8000, 3), digests(8000, 4)
    made = Cuckoo.of(some + others)
    made.remove(some)
    assert len(made) == 8000 and made.holds(others).all() and made.holds(some).mean() < 0.01
    assert made.insert(some) and made.holds(some + others).all()


def test_filter_with_equal_fingerprints_and_no_room():
    same = [bytes(8) + (5).to_bytes(6, "little") + b"\x01\x00"] * 8
    made = Cuckoo(np.zeros((64, 4), dtype="<u2"))
    assert made.insert(same) and len(made) == 8
    made.remove(same[:3])
    assert len(made) == 5 and made.holds(same[:1]).all()
    assert not made.insert(same[:4])
    assert not Cuckoo.planned(8).insert(digests(100, 5))


def brute(rows, min_docs=3):
    blank = " \t\n\x0b\x0c\r"

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))

    split = [(i, (text or "").split("\n")) for i, text in rows]
    held = {}
    for i, found in split:
        for k in {key(line) for line in found}:
            if len(k) >= 20:
                held.setdefault(k, []).append(-1 if i is None else i)
    out = []
    for i, found in split:
        own = -1 if i is None else i
        kept = [x for x in found if len(held.get(key(x), ())) < min_docs or own == max(held[key(x)])]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((i, len(found), len(found) - len(kept), digest))
    return sorted(out, key=repr)


def result(index, docs):
    return sorted(digested(index.deduplicated(docs)), key=repr)


def digested(kept):
    return [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()]


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def made_docs(spark, n=240, first=0, seed=7):
    """Documents of few lines: common ones, one in every third document, long and short ones, odd blanks."""
    draw = random.Random(seed)
    common = [f"line number {k} that many documents share" for k in range(30)] + ["é" * 19, "é" * 20, "short", "", "x" * 9000]
    rows = []
    for i in range(first, first + n):
        found = draw.choices(common, k=draw.randrange(1, 6)) + [f"a line of document {i} and no other"]
        found = [draw.choice(["{}", " \t{}\r", "{} \x0b"]).format(draw.choice([x, x.upper()])) for x in found]
        if i % 3 == 0:
            found.append("the line that a third of all rows have")
        draw.shuffle(found)
        rows.append((i, "\n".join(found)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_documents_against_plain_python(documents):
    docs = documents.select("doc_id", "text")
    index = ls.LineIndex.over(docs)
    expected = brute(plain(docs))
    assert any(r[2] for r in expected)
    assert result(index, docs) == expected
    assert sorted(digested(index.deduplicated_members(docs)), key=repr) == expected


def test_common_lines_are_shared_by_groups(spark, monkeypatch):
    monkeypatch.setattr(ls, "PROBE_ROWS", 16)
    docs = made_docs(spark)
    assert result(ls.LineIndex.over(docs), docs) == brute(plain(docs))


def test_inserting_in_batches_and_deleting_again(spark, monkeypatch):
    # So few lines a filter that filters are made anew and shards are cut as the index grows.
    monkeypatch.setattr(ls, "SHARD_LINES", 1)
    monkeypatch.setattr(ls, "_LEAST_BITS", 1)
    parts = [made_docs(spark, 60, first, seed=first) for first in (0, 60, 120)]
    grown = ls.LineIndex.over(parts[0])
    for part in parts[1:]:
        grown = grown.insert(part)
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert result(grown, every) == brute(plain(every))
    shrunk = grown.delete(parts[1].select("doc_id")).delete(spark.createDataFrame([(10**6,)], "doc_id long"))
    rest = parts[0].unionByName(parts[2])
    fresh = ls.LineIndex.over(rest)
    assert sorted(map(tuple, shrunk.counts.collect())) == sorted(map(tuple, fresh.counts.collect()))
    assert result(shrunk, rest) == result(fresh, rest) == brute(plain(rest))
    empty = shrunk.delete(rest.select("doc_id"))
    assert empty.counts.count() == 0 and empty.references.count() == 0
    assert sum(len(Cuckoo.from_bytes(r["filter"])) for r in empty.filters.collect()) == 0
    assert result(empty.insert(parts[1]), parts[1]) == brute(plain(parts[1]))


def test_new_documents_against_a_stored_index(spark, tmp_path):
    docs, new = made_docs(spark), made_docs(spark, 20, 1000, seed=11)
    ls.LineIndex.over(docs).save(str(tmp_path / "index"))
    index = ls.LineIndex.load(spark, str(tmp_path / "index"))
    known = brute(plain(docs))
    assert result(index, docs) == known
    # Only the index decides: of lines it knows well, the new documents' own ids are none it has seen.
    lines = {r.doc_id: r.n_dropped for r in index.deduplicated(new).collect()}
    assert sum(lines.values()) > 0


def test_odd_documents(odd_docs, no_docs):
    index = ls.LineIndex.over(odd_docs, min_docs=2)
    kept = index.deduplicated(odd_docs)
    assert kept.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    assert sorted(digested(kept), key=repr) == brute(plain(odd_docs), 2)
    by_id = {r.doc_id: r for r in kept.collect()}
    assert by_id[0].text is None and by_id[0].n_lines == 1 and by_id[1].n_lines == 1
    # Lines go from the smaller id; rows with the largest id, repeated here, keep them.
    assert by_id[8].n_dropped == 1 and by_id[8].text == "" and by_id[9].n_dropped == 0
    clashing = odd_docs.withColumnRenamed("size", "n_lines").withColumnRenamed("source", "lines")
    assert index.deduplicated(clashing).where("n_lines <> 1").count() == 0
    none = ls.LineIndex.over(no_docs)
    assert none.deduplicated(no_docs).count() == 0 and none.counts.count() == 0
    assert none.deduplicated(odd_docs).where("n_dropped > 0").count() == 0
    assert none.insert(odd_docs).counts.count() == index.counts.count()


def test_rows_without_ids(spark):
    text = "a line of more than twenty characters"
    rows = [(None, text), (None, text), (None, text + "\nother"), (4, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = ls.LineIndex.over(docs)
    assert result(index, docs) == brute(rows)
    nulls = docs.where("doc_id IS NULL")
    assert result(ls.LineIndex.over(nulls), nulls) == brute(rows[:3])
    assert index.delete(nulls.select("doc_id")).counts.head()["n"] == 1
