import math
import random

import numpy as np
import pytest
from odd_rows import DATA, documents, no_docs, odd_docs  # noqa: F401

from repoquarry.llm import embeddings as e
from repoquarry.llm import minhash as m
from repoquarry.llm.components import components


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def word_sets(rows):
    out = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
        out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def brute_documents(rows):
    sets = word_sets(rows)
    ids = sorted(sets)
    pairs = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[:n]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    named = classes(pairs, ids)
    return sorted((i, len(sets[i]), named[i], named[i] == i) for i in ids)


def near_copies(n, words=60, changed=2, seed=3):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(1000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(draw.randrange(changed + 1)):
            copy[draw.randrange(words)] = f"v{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    return rows


def test_documents_against_all_pairs(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in m.near_duplicates(documents).collect()) == brute_documents(rows)


def test_groups_larger_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(m, "TILE", 16)
    rows = near_copies(150, changed=3) + [(1000 + i, t) for i, t in near_copies(60, changed=4, seed=9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(tuple(r) for r in m.near_duplicates(df).collect()) == brute_documents(rows)


def test_odd_documents(odd_docs, no_docs):
    found = m.near_duplicates(odd_docs).collect()
    rows = {r.doc_id: tuple(r)[1:] for r in found}
    assert len(found) == odd_docs.count()
    assert rows[0] == (0, 0, True) and rows[1] == (0, 1, True) and rows[2] == (0, 2, True)
    assert rows[3] == (1, 3, True) and rows[4] == (1, 4, True)
    assert rows[8][1:] == (8, True) and rows[9][1:] == (8, False)
    assert rows[None][1:] == (None, False)
    assert m.near_duplicates(no_docs).count() == 0
    kept = m.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == list(range(9))


def test_all_signatures_within_the_guarantee_meet():
    draw = np.random.default_rng(4)
    one = draw.integers(0, 1 << 16, m.LENGTH).astype("<u2")
    for _ in range(200):
        other = one.copy()
        places = draw.choice(m.LENGTH, 2 * m.CHUNKS - 1, replace=False)
        other[places] += 1
        keys = m.index_keys(np.stack([one, other]))
        shared = np.flatnonzero(keys[0] == keys[1])
        far, first = m.first_place(one[None], other[None])
        assert len(shared) and far[0] == len(places) and first[0] == shared[0]


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, 6)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {n for edge in edges for n in edge}
    assert {r.node: r.component for r in found} == classes(edges, nodes)
    assert len(found) == len(nodes)


def brute_vectors(rows, threshold=0.93):
    links, pairs = {i: 0 for i, *_ in rows}, []
    for n, (i, x, k) in enumerate(rows):
        for j, y, other in rows[:n]:
            if k is None or k != other or not usable(x) or not usable(y) or len(x) != len(y):
                continue
            x, y = np.array(x, float), np.array(y, float)
            if x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    named = classes(pairs, list(links))
    return sorted((i, links[i], named[i], named[i] == i) for i in links)


def usable(x):
    return x is not None and len(x) > 0 and None not in x and all(map(math.isfinite, x)) and any(x)


SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


@pytest.mark.parametrize("bucket", [2048, 8])
def test_vectors_against_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(e, "BUCKET", bucket)
    monkeypatch.setattr(e, "TILE", 16)
    draw = np.random.default_rng(6)
    rows = []
    for i in range(160):
        x = draw.standard_normal(16)
        if i % 4:
            x = np.array(rows[-1][1]) + x * 0.05 * np.linalg.norm(rows[-1][1])
        x = rows[0][1] if i % 10 == 9 else x.astype("float32").tolist()
        rows.append((i, x, i // 40 % 3, 0, "c"))
    found = e.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in found.collect()) == brute_vectors([r[:3] for r in rows])


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1, 0, ""),
        (1, [2.0, 0.0], 1, 0, ""),
        (2, [1.0, 0.0], 2, 0, ""),
        (3, [1.0, 0.0], None, 0, ""),
        (4, None, 1, 0, ""),
        (5, [], 1, 0, ""),
        (6, [0.0, 0.0], 1, 0, ""),
        (7, [float("nan"), 1.0], 1, 0, ""),
        (8, [float("inf"), 1.0], 1, 0, ""),
        (9, [None, 1.0], 1, 0, ""),
        (10, [1.0, 0.0, 0.0], 1, 0, ""),
        (11, [1.0], 1, 0, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in e.near_duplicates(df).collect()) == brute_vectors([r[:3] for r in rows])
    repeated = spark.createDataFrame([rows[0], rows[0], (None, [1.0, 0.0], 1, 0, "")], SCHEMA)
    assert sorted(map(str, e.near_duplicates(repeated).collect())) == sorted(
        ["Row(vec_id=0, n_links=1, component_id=0, kept=True)"] * 2
        + ["Row(vec_id=None, n_links=0, component_id=None, kept=False)"]
    )
    assert e.near_duplicates(df.where("false")).count() == 0


def test_estimates_are_unbiased_and_within_bounds():
    draw = np.random.default_rng(8)
    x, y = e.units(draw.standard_normal((2, 64)))
    estimates = []
    for k in range(400):
        turn = e.rotation(64, k)
        code = np.where(x @ turn > 0, 1, -1) / 8
        estimates.append(code @ (y @ turn) / (code @ (x @ turn)))
    assert abs(np.mean(estimates) - x @ y) < 4 * np.std(estimates) / 20
    i, j = e.close_pairs(np.stack([x, y, x * 3]), 0.99)
    assert list(zip(i, j)) == [(0, 2)]


@pytest.mark.parametrize("d", [2, 16, 64, 300])
def test_codes_decide_like_all_cosines(d):
    draw = np.random.default_rng(d)
    base = e.units(draw.standard_normal((40, d)))
    near = np.repeat(base, 20, axis=0)
    noise = draw.standard_normal(near.shape) * draw.uniform(0, 0.8, (len(near), 1)) / math.sqrt(d)
    vectors = (near + noise) * draw.uniform(0.1, 9, (len(near), 1))
    unit = e.units(vectors)
    close = np.triu(unit @ unit.T >= 0.93, 1)
    codes = e.encode(unit)
    linked, undecided = (np.triu(m, 1) for m in e.decide(codes, codes, 0.93))
    assert not (linked & ~close).any() and not (close & ~linked & ~undecided).any()
    i, j = e.close_pairs(vectors, 0.93)
    assert np.array_equal(np.argwhere(close), np.stack([i, j], axis=1))
    if d >= 64:
        assert undecided.sum() < 0.5 * close.sum() and linked.sum() > 0.5 * close.sum()


def test_pairs_at_the_threshold_outlast_the_bound():
    draw = np.random.default_rng(12)
    for d in (16, 64, 256):
        x, z = (e.units(draw.standard_normal((20000, d))) for _ in range(2))
        z = e.units(z - np.einsum("ij,ij->i", x, z)[:, None] * x)
        y = 0.9301 * x + math.sqrt(1 - 0.9301**2) * z
        for first in range(0, len(x), 500):
            one, other = (e.encode(part[first : first + 500]) for part in (x, y))
            linked, undecided = e.decide(one, other, 0.93)
            assert (np.diag(linked) | np.diag(undecided)).all()


def test_vectors_of_a_label_above_a_bucket(spark):
    draw = np.random.default_rng(2)
    base = draw.standard_normal((1500, 24))
    vectors = np.concatenate([base, base + 0.2 * draw.standard_normal(base.shape), base[:700] + 0.3 * draw.standard_normal((700, 24))])
    rows = [(i, x, 1, 0, "c") for i, x in enumerate(vectors.astype("float32").tolist())]
    unit = e.units(np.array([x for _, x, *_ in rows]))
    close = unit @ unit.T >= 0.93
    np.fill_diagonal(close, False)
    found = {r.vec_id: r for r in e.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows) > e.BUCKET
    assert [found[i].n_links for i in range(len(rows))] == close.sum(axis=1).tolist()
    named = classes(np.argwhere(np.triu(close)).tolist(), range(len(rows)))
    assert {i: r.component_id for i, r in found.items()} == named


@pytest.mark.parametrize("kind", ["float", "double"])
def test_lists_with_nulls_between_others(spark, kind):
    lists = [[1.0, 2.0], None, [], [3.0, None], [2.0, 4.0], [0.0, -0.0], [float("nan"), 1.0], [1.0, 2.0]]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(lists)], f"vec_id long, embedding array<{kind}>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in e.near_duplicates(df.coalesce(1)).collect()}
    assert found == {0: (2, 0), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (2, 0), 5: (0, 5), 6: (0, 6), 7: (2, 0)}
