"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector x is rotated at random, once, and stored as the signs o of its coordinates with the
correction factor f = <o, x> (o scaled to length one). <o, y> / f is an unbiased estimate of <x, y>; its
error is sqrt((1 - f^2) / f^2) * sqrt(1 - <x, y>^2) times one coordinate of a random unit vector of d - 1
dimensions. y itself is stored as one byte a coordinate with the length of its rounding error, which
bounds what rounding changes. Tiles hold these codes only. Pairs whose bound stays below the threshold
are done; of the others the product of the bytes, with certain bounds, links or rejects most; what is
left is recomputed from the vectors, which are fetched for it. Signs of further rotations also place
vectors in buckets, so that only vectors with a common bucket are estimated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.components import components
from repoquarry.llm.groups import sorted_groups
from repoquarry.llm.process import kept
from repoquarry.sources.shared import materialize

# Buckets hold about so many vectors of a label, blocks at most about so many, and a tile is two blocks.
BUCKET = 2048
TILE = 2048
# Rows of a tile estimated at a time.
SLICE = 128
# Chance that a pair exactly at the threshold shares no bucket. Closer pairs are missed more rarely.
MISS = 1e-5
# Width of the confidence bound in standard deviations of the estimate of a pair at the threshold: about
# one such pair in 10**9 is lost, closer ones more rarely.
CONFIDENCE = 6.0
# Rounding of products in single precision.
_ROUNDING = 1e-5
# So many labels above ``BUCKET`` vectors are sent to all tasks; more are joined.
_SENT_LABELS = 100_000
# Pairs recomputed at a time.
_CHUNK = 4096
_SEED = 77


def tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for a label of ``n`` vectors: buckets of about ``BUCKET`` and the ``MISS`` wanted."""
    bits = max(0, math.ceil(math.log2(max(1, n) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - agree))


def rotation(d: int, number: int) -> np.ndarray:
    """The ``number``-th random rotation of ``d`` dimensions; the first one is kept in the process."""

    def make() -> np.ndarray:
        draw = np.random.default_rng([_SEED, d, number]).standard_normal((d, d))
        q, r = np.linalg.qr(draw)
        return q * np.sign(np.diag(r))

    return make() if number else kept(("rotation", d), make)


def sign_codes(unit: np.ndarray, bits: int, count: int) -> np.ndarray:
    """``count`` codes of ``bits`` sign bits per vector, from as many rotations as that takes."""
    n, d = unit.shape
    if bits == 0:
        return np.zeros((n, count), dtype=np.int64)
    signs = [unit @ rotation(d, 1 + i) > 0 for i in range(-(-bits * count // d))]
    signs = np.hstack(signs)[:, : bits * count].reshape(n, count, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass(frozen=True)
class Codes:
    """Binary codes of unit vectors: packed signs, correction factors, bytes, their scales and errors."""

    d: int
    signs: np.ndarray
    factor: np.ndarray
    levels: np.ndarray
    scale: np.ndarray
    slack: np.ndarray

    def of(self, rows: np.ndarray) -> Codes:
        parts = (self.signs, self.factor, self.levels, self.scale, self.slack)
        return Codes(self.d, *(part[rows] for part in parts))


def encode(unit: np.ndarray) -> Codes:
    """What is stored of unit vectors: d / 8 + d + 24 bytes each."""
    d = unit.shape[1]
    turned = unit @ rotation(d, 0)
    positive = turned > 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(d)
    scale = np.abs(turned).max(axis=1) / 127
    levels = np.rint(turned / scale[:, None]).astype(np.int8)
    slack = np.linalg.norm(turned - levels * scale[:, None], axis=1)
    return Codes(d, np.packbits(positive, axis=1), factor, levels, scale, slack)


def decide(left: Codes, right: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked, undecided) as boolean matrices; all other pairs are below ``threshold``."""
    d = left.d
    signs = np.unpackbits(left.signs, axis=1, count=d).astype(np.float32) * 2 - 1
    rounded = right.levels.astype(np.float32)
    estimate = (signs @ rounded.T) * right.scale / (left.factor[:, None] * math.sqrt(d))
    spread = np.sqrt(np.maximum(1 - left.factor**2, 0)) / left.factor * math.sqrt(max(0.0, 1 - threshold**2))
    error = CONFIDENCE * spread[:, None] / math.sqrt(max(1, d - 1)) + right.slack / left.factor[:, None] + _ROUNDING
    open_pairs = estimate + error >= threshold
    linked = np.zeros_like(open_pairs)
    rows, columns = (np.flatnonzero(open_pairs.any(axis=k)) for k in (1, 0))
    if len(rows):
        at = np.ix_(rows, columns)
        finer = (left.levels[rows].astype(np.float32) @ rounded[columns].T) * np.outer(left.scale[rows], right.scale[columns])
        x, y = left.slack[rows][:, None], right.slack[columns]
        certain = x + y + x * y + _ROUNDING
        linked[at] = open_pairs[at] & (finer - certain >= threshold)
        open_pairs[at] &= (finer + certain >= threshold) & ~linked[at]
    return linked, open_pairs


def confirmed(vectors: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of rows ``i`` and ``j``, in double precision, reaches ``threshold``."""
    unit = units(vectors)
    found = np.zeros(len(i), dtype=bool)
    for first in range(0, len(i), _CHUNK):
        p, q = i[first : first + _CHUNK], j[first : first + _CHUNK]
        exact = np.einsum("ij,ij->i", unit[p], unit[q])
        # Rounding of units must not decide a pair at the threshold.
        for k in np.flatnonzero(np.abs(exact - threshold) < 1e-12):
            x, y = vectors[p[k]], vectors[q[k]]
            exact[k] = x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y))
        found[first : first + _CHUNK] = exact >= threshold
    return found


def close_pairs(vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of ``vectors`` with cosine >= ``threshold``, by codes and recomputation."""
    codes = encode(units(vectors))
    linked, undecided = (np.triu(m, 1) for m in decide(codes, codes, threshold))
    i, j = np.nonzero(undecided)
    linked[i, j] = confirmed(vectors, i, j, threshold)
    return np.nonzero(linked)


def _prepared(item: str):
    """Vectors as bytes of ``item`` numbers, null where they cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(2)
            numbers = given.flatten().to_numpy(zero_copy_only=False).astype(item) + np.dtype(item).type(0)
            lengths = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            some = lengths > 0
            good = np.zeros(len(lengths), dtype=bool)
            if some.any():
                with np.errstate(over="ignore", invalid="ignore"):
                    norms = np.add.reduceat(numbers.astype("<f8") ** 2, (ends - lengths)[some])
                good[some] = np.isfinite(norms) & (norms > 0)
            data, width = numbers.tobytes(), np.dtype(item).itemsize
            cuts = zip(good.tolist(), ((ends - lengths) * width).tolist(), (ends * width).tolist())
            out = pa.array([data[x:y] if fine else None for fine, x, y in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["vec_id", "label", "v"])

    return run


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that already connect what all pairs connect: every node and the smallest one it reaches."""
    nodes, places = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = places[: len(i)], places[len(i) :]
    low = np.arange(len(nodes))
    while len(a):
        x, y = low[a], low[b]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, low[low]):
            low = low[low]
        apart = low[a] != low[b]
        a, b = a[apart], b[apart]
    joined = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[low[joined]], nodes[joined]


def near_duplicates(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding, label).

    Vectors with equal labels and a cosine of at least ``threshold`` are linked; ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reachable. Equal vectors are one
    class with a count, known by its digest, so copies of any number cost one row.

    Codes are made once per class and stored. Bits per bucket follow the size of the label and the
    number of tables follows from them and ``MISS``. A bucket is dealt out in tiles of two blocks of
    ``TILE`` codes, whatever its size; a pair counts in the first table that brings it together. Tiles
    return counts, a spanning forest, and the members of undecided pairs with a bit per partner; never
    pairs. Vectors are sent only for these members, to be recomputed within their tile. The work within
    a group of n mutual near copies is n^2 / 2 estimates, which exact counts of links need.

    Null labels, null ids, and vectors that are null, empty, zero or hold null or non-finite numbers
    link with nothing: n_links 0 and their own id. Vectors of different lengths do not link. Repeated
    rows count as different vectors. Other columns do not matter; an empty table gives no rows.
    """
    kind = rows.schema["vec_id"].dataType.simpleString()
    label = rows.schema["label"].dataType.simpleString()
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    item, number = ("<f4", "float") if single else ("<f8", "double")
    plain = rows.select("vec_id", "label", F.col("embedding").cast(f"array<{number}>"))
    read = plain.mapInArrow(_prepared(item), f"vec_id {kind}, label {label}, v binary")
    digest = F.unhex(F.sha2("v", 256)).alias("digest")
    prepared = materialize(read.select("*", digest, F.length("v").alias("width")), "vectors")
    links = prepared.where("digest IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    same = ["label", "width", "digest"]
    classes = links.groupBy(same).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    sizes = links.groupBy("label", "width").agg(F.count_distinct("digest").alias("size")).where(f"size > {BUCKET}")
    sizes = materialize(sizes, "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= _SENT_LABELS else sizes
    placed = classes.join(sizes, ["label", "width"], "left").withColumn("size", F.coalesce("size", F.lit(1).cast("bigint")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
            for width, size in {*zip(widths.tolist(), counts.tolist())}:
                part = batch.filter(pa.array((widths == width) & (counts == size)))
                unit = units(_vectors(part.column(6), item))
                buckets = sign_codes(unit, *tables(size, threshold))
                codes = encode(unit)
                made = [
                    _packed(codes.signs),
                    pa.array(codes.factor),
                    _packed(codes.levels),
                    pa.array(codes.scale),
                    pa.array(codes.slack),
                    _packed(buckets.astype("<i8")),
                    pa.array(buckets.tolist(), pa.list_(pa.int64())),
                ]
                columns = [part.column(i) for i in (0, 1, 2, 4, 5, 6)]
                yield pa.RecordBatch.from_arrays([*columns, *made], ["label", "width", "digest", "id", "n", "v", *_CODES, "buckets"])

    schema = (
        f"label {label}, width int, digest binary, id {kind}, n bigint, v binary, signs binary, factor double,"
        " levels binary, scale double, slack double, codes binary, buckets array<bigint>"
    )
    keys = placed.select("label", "width", "digest", "size", "id", "n", "v").mapInArrow(keyed, schema)
    keys = materialize(keys.withColumn("class", F.monotonically_increasing_id()), "codes")
    bucket = ["label", "width", "t", "code"]
    spread = keys.drop("v", "digest").select("*", F.posexplode("buckets").alias("t", "code")).drop("buckets")
    full = spread.groupBy(bucket).agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    blocks = F.ceil(F.col("in_bucket") / TILE).cast("int")
    block = F.pmod(F.xxhash64("class"), blocks).cast("int")
    tiled = spread.join(full, bucket).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiled = tiled.select(
        F.xxhash64(*bucket, F.least("block", "other"), F.greatest("block", "other")).alias("tile"),
        *bucket,
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "id",
        "n",
        "class",
        *_CODES,
    )
    parts = ["tile", *bucket, "low", "high"]
    dealt = tiled.repartition(*parts).sortWithinPartitions(*parts)
    estimated = dealt.mapInArrow(_tiles(threshold), f"a {kind}, b {kind}, links bigint, {_OPEN}")
    estimated = materialize(estimated, "links")
    fetched = estimated.where("partners IS NOT NULL").join(keys.select("class", "id", "n", "v"), "class")
    tile = ["t", "low", "high", "first"]
    fetched = fetched.select(*tile, "place", "id", "n", "partners", "v").repartition(*tile).sortWithinPartitions(*tile, "place")
    recomputed = materialize(fetched.mapInArrow(_exact(threshold, item), f"a {kind}, b {kind}, links bigint"), "links")
    linked = estimated.where("partners IS NULL").select("a", "b", "links").unionByName(recomputed)
    counts = linked.where("links IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(linked.where("b IS NOT NULL").select("a", "b"))
    result = keys.select(*same, "id", "n").join(counts, "id", "left").join(joined, F.col("id") == F.col("node"), "left")
    known = result.select(
        *same,
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    alone = prepared.where("digest IS NULL OR label IS NULL OR vec_id IS NULL").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    every = links.select("vec_id", *same).join(known, same).select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


_CODES = ["signs", "factor", "levels", "scale", "slack", "codes"]
# A member of undecided pairs: its tile, its place there and one bit per partner in a later place.
_OPEN = "t int, low int, high int, first bigint, place int, class bigint, partners binary"
_OPEN_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
_OPEN_NAMES = [field.split()[0] for field in _OPEN.split(", ")]


def _vectors(column, item: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), item).reshape(len(column), -1).astype("<f8")


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _unpacked(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 7):
            yield from _tile(table, threshold)

    return run


def _tile(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Counts of links per class, a spanning forest, and the members of undecided pairs of one tile."""
    signs, levels = _unpacked(table.column("signs"), "u1"), _unpacked(table.column("levels"), "i1")
    factor, scale, slack = (table.column(k).to_numpy() for k in ("factor", "scale", "slack"))
    held = Codes(levels.shape[1], signs, factor, levels, scale, slack)
    codes = _unpacked(table.column("codes"), "<i8")
    block = table.column("block").to_numpy()
    t, low, high = (table.column(k)[0].as_py() for k in ("t", "low", "high"))
    rows, columns = np.flatnonzero(block == low), np.flatnonzero(block == high)
    if not len(rows) or not len(columns):
        return
    right, found = held.of(columns), ([], [])
    for first in range(0, len(rows), SLICE):
        part = rows[first : first + SLICE]
        for pairs, list_of in zip(decide(held.of(part), right, threshold), found):
            i, j = np.nonzero(np.triu(pairs, first + 1) if low == high else pairs)
            i, j = part[i], columns[j]
            new = ~(codes[i, :t] == codes[j, :t]).any(axis=1) if t else np.ones(len(i), dtype=bool)
            list_of.append(np.stack([i[new], j[new]]))
    found = [np.concatenate(pairs, axis=1) for pairs in found]
    kind = table.schema.field("id").type
    if len(found[0][0]):
        batch = _links(table.column("id").to_pylist(), table.column("n").to_numpy(), *found[0], kind)
        nothing = [pa.nulls(batch.num_rows, k) for k in _OPEN_TYPES]
        yield pa.RecordBatch.from_arrays([*batch.columns, *nothing], [*batch.schema.names, *_OPEN_NAMES])
    i, j = found[1]
    if len(i):
        members, places = np.unique(np.concatenate([i, j]), return_inverse=True)
        i, j = places[: len(i)], places[len(i) :]
        bits = np.zeros((len(members), len(members)), dtype=bool)
        bits[i, j] = True
        owners = table.column("class").to_numpy()[members]
        count = len(members)
        # A class lies in one bucket of a table, so the smallest one names the tile.
        same = [pa.array([k] * count, kind) for k, kind in zip((t, low, high, int(owners.min())), _OPEN_TYPES)]
        own = [pa.array(np.arange(count, dtype=np.int32)), pa.array(owners), _packed(np.packbits(bits, axis=1))]
        empty = [pa.nulls(count, kind), pa.nulls(count, kind), pa.nulls(count, pa.int64())]
        yield pa.RecordBatch.from_arrays([*empty, *same, *own], ["a", "b", "links", *_OPEN_NAMES])


def _exact(threshold: float, item: str):
    """Undecided pairs of every tile, recomputed from the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 4):
            bits = np.unpackbits(_unpacked(table.column("partners"), "u1"), axis=1, count=len(table))
            i, j = np.nonzero(bits)
            right = confirmed(_vectors(table.column("v"), item), i, j, threshold)
            if right.any():
                kind = table.schema.field("id").type
                yield _links(table.column("id").to_pylist(), table.column("n").to_numpy(), i[right], j[right], kind)

    return run


def _links(ids: list, n: np.ndarray, i: np.ndarray, j: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """Counts of links and a spanning forest of linked pairs."""
    links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
    some = np.flatnonzero(links)
    low, node = _forest(i, j)
    a = [ids[k] for k in some] + [ids[k] for k in low]
    b = [None] * len(some) + [ids[k] for k in node]
    counted = links[some].astype(int).tolist() + [None] * len(node)
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(counted, pa.int64())], ["a", "b", "links"])
