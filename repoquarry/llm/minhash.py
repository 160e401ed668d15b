"""MinHash near-duplicates by a multi-index Hamming join of signatures.

A signature has ``CHUNKS * WIDTH`` components of 16 bits; two components are equal with the Jaccard
similarity of the sets as probability. The distance of two signatures is the number of components that
differ. Each chunk is entered into an index under every form with one component left out, so two
signatures meet if some chunk differs in at most one component; by the pigeonhole principle that holds
for every pair at a distance up to ``2 * CHUNKS - 1``. What meets is compared on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.components import components
from repoquarry.llm.groups import sorted_groups
from repoquarry.llm.words import Words, constants, mix, shingles, slices
from repoquarry.sources.shared import materialize

CHUNKS = 10
WIDTH = 8
LENGTH = CHUNKS * WIDTH
# Pairs at 85 % similarity differ in 12 components on average, with a deviation of 3.2; pairs beyond
# this distance are not compared once more.
FARTHEST = 28
# Members of a bucket that one task compares with as many others.
TILE = 256
SHINGLE = 5
# A link needs this share, in percent, of common shingles.
PERCENT = 85
_STEP = 2048


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each of the ``LENGTH`` minima over a set of hashes."""
    factors, shifts = constants(LENGTH, 1)[:, None], constants(LENGTH, 2)[:, None]
    low = np.full(LENGTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), _STEP):
        low = np.minimum(low, (found[None, i : i + _STEP] * factors + shifts).min(axis=1))
    return (mix(low) >> np.uint64(48)).astype("<u2")


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """``LENGTH`` keys per signature: every chunk with every one of its components left out."""
    parts = signatures.astype(np.uint64).reshape(-1, CHUNKS, WIDTH) * constants(LENGTH, 3).reshape(CHUNKS, WIDTH)
    without = parts.sum(axis=2, keepdims=True, dtype=np.uint64) - parts
    return mix(without.reshape(-1, LENGTH) + constants(LENGTH, 4)).view(np.int64)


def first_place(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, first common index place) of signatures row by row; a place of ``LENGTH`` is none."""
    differ = (left != right).reshape(-1, CHUNKS, WIDTH)
    wrong = differ.sum(axis=2)
    meets = wrong <= 1
    chunk = meets.argmax(axis=1)
    rows = np.arange(len(chunk))
    place = chunk * WIDTH + np.where(wrong[rows, chunk] == 1, differ[rows, chunk].argmax(axis=1), 0)
    return wrong.sum(axis=1), np.where(meets.any(axis=1), place, LENGTH)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts)
    hashes = words.hashes()
    return [np.unique(shingles(hashes[a:b], SHINGLE)) for a, b in zip(words.bounds[:-1], words.bounds[1:])]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, part in slices(batch.column(1)):
            sets = shingle_sets(part)
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signed = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(part)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(marks, pa.binary()),
                    pa.array(signed, pa.binary()),
                ],
                ["doc_id", "n_shingles", "mark", "signature"],
            )


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            keys = index_keys(_signatures(part.column(1)))
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), LENGTH)))
            places = pa.array(np.tile(np.arange(LENGTH, dtype=np.int32), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), places, ids], ["key", "place", "id"])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, LENGTH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, part in slices(batch.column(1)):
            found = pa.array([s.tobytes() for s in shingle_sets(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), found], ["id", "shingles"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose full sets are similar enough."""
    for batch in batches:
        kept = []
        for left, right in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(side.as_buffer(), "<u8") for side in (left, right))
            if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                kept.append(False)
                continue
            common = len(x) + len(y) - len(np.union1d(x, y))
            kept.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that are links."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_compared, f"a {kind}, b {kind}")


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a tile that are in different components, near enough, and not met at an earlier place.

    Shingles that no other member has lie outside of every intersection and inside of every union, so
    they bound the similarity of a pair from above; pairs whose bound is too low are not links.
    """

    for table in sorted_groups(batches, 4):
        if len(table) < 2:
            continue
        component, block, own, shared = (
            np.array(table.column(c).to_pylist()) for c in ("component", "block", "own", "shared")
        )
        low, high, place = (table.column(c)[0].as_py() for c in ("low", "high", "place"))
        marks = _signatures(table.column("signature"))
        i, j = np.nonzero(component[:, None] != component[None, :])
        use = i < j if low == high else (block[i] == low) & (block[j] == high)
        i, j = i[use], j[use]
        most, least = np.minimum(shared[i], shared[j]), own[i] + own[j] + np.maximum(shared[i], shared[j])
        use = 100 * most >= PERCENT * least
        i, j = i[use], j[use]
        far, first = first_place(marks[i], marks[j])
        use = (far <= FARTHEST) & (first == place)
        ids = table.column("id")
        sides = [ids.take(pa.array(k[use])).combine_chunks() for k in (i, j)]
        yield pa.RecordBatch.from_arrays(sides, ["a", "b"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            found = np.frombuffer(batch.column(1)[row].as_py(), "<i8")
            ids = batch.column(0).slice(row, 1).take(pa.array(np.zeros(len(found), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found)], ["id", "shingle"])


def _own_shingles(sets: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """(id, own, shared): how many shingles of a set no other, and some other, of the sets of ``ids`` has."""
    chosen = sets.join(ids, "id", "left_semi")
    seen = chosen.mapInArrow(_exploded, f"id {kind}, shingle bigint").groupBy("shingle")
    single = seen.agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    own = single.groupBy("id").agg(F.count("*").alias("own"))
    sizes = chosen.select("id", (F.length("shingles") / 8).cast("bigint").alias("size"))
    counted = sizes.join(own, "id", "left").select("id", F.coalesce("own", F.lit(0)).alias("own"), "size")
    return counted.select("id", "own", (F.col("size") - F.col("own")).alias("shared"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Texts with equal shingle sets are one class, represented by its smallest id. Members of a bucket of
    the index are first compared with the bucket's smallest id; where that leaves several components in
    a bucket, pairs across components are compared in tiles of ``TILE`` members, each at the first
    place where it meets, unless shingles of their own already keep them below the threshold. So links
    within a large group are not enumerated, and no pair that could still join two components is left out.

    A text with fewer words than a shingle is one shingle; null texts and texts without words have an
    empty set, no links and their own id. Rows without an id are not linked and have no component.
    Rows that share an id count as one document. Other columns do not matter; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, n_shingles bigint, mark binary, signature binary"
    signed = materialize(texts.mapInArrow(_signed, schema), "signatures")
    whole = signed.where("mark IS NOT NULL AND doc_id IS NOT NULL")
    classes = whole.groupBy("mark").agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature"))
    classes = materialize(classes, "classes")
    keys = classes.select("id", "signature").mapInArrow(_indexed, f"key bigint, place int, id {kind}")
    buckets = keys.groupBy("key", "place").agg(F.min("id").alias("lead"), F.count("*").alias("members")).where("members > 1")
    members = materialize(keys.join(buckets, ["key", "place"]), "buckets")

    met = members.select("id").distinct()
    sets = texts.join(met, texts.doc_id == met.id, "left_semi").mapInArrow(_sets, f"id {kind}, shingles binary")
    sets = materialize(sets, "sets")
    stars = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(_linked(stars, sets, kind), "links")
    joined = components(links)

    again = members.where("members > 2").join(joined, F.col("id") == F.col("node"), "left")
    again = again.select("key", "place", "members", "lead", "id", F.coalesce("component", "id").alias("component"))
    open_ = again.where("id <> lead").groupBy("key", "place").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    open_ = open_.where("x <> y").select("key", "place")
    blocks = F.ceil(F.col("members") / TILE).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    opened = materialize(again.join(open_, ["key", "place"]), "open-buckets")
    own = _own_shingles(sets, opened.where("id <> lead").select("id").distinct(), kind)
    tiled = opened.where("id <> lead").join(classes.select("id", "signature"), "id").join(own, "id")
    tiled = tiled.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    parts = ["key", "place", "low", "high"]
    tiled = tiled.select(
        "key",
        "place",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "id",
        "component",
        "own",
        "shared",
        "signature",
    )
    dealt = tiled.repartition(*parts).sortWithinPartitions(*parts)
    across = dealt.mapInArrow(_apart, f"a {kind}, b {kind}")
    more = _linked(across, sets, kind)
    final = components(materialize(links.unionByName(more), "links"))

    named = classes.join(final, F.col("id") == F.col("node"), "left")
    named = named.select("mark", F.coalesce("component", "id").alias("component_id"))
    found = whole.join(named, "mark").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("mark IS NULL OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return found.unionByName(alone).withColumn("kept", _same("doc_id", "component_id"))


def _same(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) == F.col(b), F.lit(False))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, but one document of each group of near-duplicates only."""
    dropped = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
