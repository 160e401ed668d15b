"""Merkle manifests of tables: leaves, roots and proofs, made by an exchange of subtrees.

Every tree is cut at a fixed height into superblocks of ``8 ** height`` leaves. A superblock is reduced
to its top node; the tops are the leaves of the next round, until each tree has one node, its subroot,
and the subroots are the leaves of a last tree. On the way back the nodes of a superblock are cogrouped
with what its top needs from outside: the task finishes the local reduction, joins the inner part of
every proof to the outer one and, for the rows themselves, folds the leaf that is to be verified.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.operators.ranking import laid_out_in_ranges
from repoquarry.sources.shared import materialize

ARITY = 8
# Levels of a superblock above its leaves, of which it so has 4,096 at most.
HEIGHT = 4
_DIGEST = 64


def digest_of(*columns: Column) -> Column:
    """Digest of some columns of a row: each is ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [c.cast("string") for c in columns]
    coded = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*coded), 256)


def folded(leaf: Column, proof: Column, places: Column) -> Column:
    """The root that a leaf and its proof lead to; verifies stored proofs without the table."""

    def up(node: Column, step: Column) -> Column:
        others, before = step["proof"], step["places"] * _DIGEST
        return F.sha2(F.concat(F.substring(others, F.lit(1), before), node, F.substring(others, before + 1, F.length(others))), 256)

    return F.aggregate(F.arrays_zip(places.alias("places"), proof.alias("proof")), leaf, up)


def _joined(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(nodes: list[str], height: int, whole: bool) -> list[list[str]]:
    """All levels of a superblock from its leaves to its top.

    One that is a ``whole`` tree ends as soon as one node remains; one of several has ``height`` levels
    above its leaves, however few these are.
    """
    levels = [nodes]
    while len(levels[-1]) > 1 or (not whole and len(levels) <= height):
        last = levels[-1]
        levels.append([_joined(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return levels


def manifest(
    rows: DataFrame,
    leaf: Column,
    claimed: Column | None = None,
    id_column: str = "doc_id",
    tree_column: str = "lang",
    height: int = HEIGHT,
) -> DataFrame:
    """(id, leaf, subroot, root, proof, places, folded_root, verified) of every row.

    Rows with equal ``tree_column`` are the leaves of a tree, in order of the id; rows with equal ids are
    ordered by ``leaf``. While several nodes remain, every 8 neighbours become one. The subroots of all
    trees, ordered by the bytes of ``tree_column`` with null first, are the leaves of a last tree.
    ``proof`` has a text for every level up to the root: the digests of the other nodes of the run from
    left to right; ``places`` is the place of the row's own node in each run. ``folded_root`` is the root
    that follows from ``claimed``, or from ``leaf`` where it is null, and the proof.

    Digests are made where the rows are read; only (tree, id, digests) is moved. Positions come from
    stored ranges, so a tree may own any share of the rows, and no group exceeds ``8 ** height`` rows.
    Each further round is smaller by that factor and stored; the driver plans as many rounds as that
    takes and holds none of the nodes.

    Null ids come first; rows without a tree form one of their own. Repeated rows are a leaf each. A
    tree of one row has its leaf as subroot, and the subroot of the only tree is the root. An empty table
    gives no rows. Other columns of ``rows`` do not matter, whatever their names are.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    tree = F.col(f"`{tree_column}`").cast("string")
    claim = F.lit(None).cast("string") if claimed is None else claimed
    leaves = rows.select(
        # A text that is never null and sorts as wanted.
        F.coalesce(F.concat(F.lit("="), tree), F.lit("")).alias("tree"),
        F.col(f"`{id_column}`").alias("id"),
        leaf.alias("node"),
        claim.alias("claimed"),
    )
    # Stored, as laying out in ranges reads its input twice and digests take most of the time.
    leaves = _numbered(materialize(leaves, "merkle-digests"), "id")
    # Digits of a number stay as they are in pandas, whatever else is null.
    leaves = materialize(leaves.withColumn("id", F.col("id").cast("string")), "merkle-leaves")
    inner = _rounds(leaves, height)
    subroots = inner[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    outer = _rounds(materialize(_numbered(subroots, "name"), "merkle-subroots"), height)

    nothing = [F.array().cast("array<string>").alias("proof"), F.array().cast("array<int>").alias("places")]
    paths = outer[-1].select("tree", F.col("pos").alias("block"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"), *nothing)
    for nodes in reversed(outer[:-1]):
        paths = _above(_found(nodes, paths, height), "tree", "pos")
    # The last tree's leaves are the tops of the others.
    named = outer[0].select("name", "node", F.col("pos").alias("block")).join(paths.drop("tree", "subroot"), "block")
    named = named.withColumns({"pos": F.lit(0).cast("bigint"), "subroot": F.col("node")})
    paths = _above(named, "name", "pos")
    for nodes in reversed(inner[1:-1]):
        paths = _above(_found(nodes, paths, height), "tree", "pos")
    if len(inner) == 1:
        # Every tree is a single row.
        found = inner[0].join(paths, "tree").select("id", "node", "subroot", "root", "proof", "places", folded(F.coalesce("claimed", "node"), F.col("proof"), F.col("places")).alias("folded_root"))
    else:
        found = _found(inner[0], paths, height)
    return found.select(
        F.col("id").cast(kind).alias(id_column),
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        "proof",
        "places",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _numbered(nodes: DataFrame, order: str) -> DataFrame:
    """Adds ``pos``, the place in the tree from 0 by (``order``, node), and ``size``, the tree's nodes."""
    # Rows that are equal in all of it may stand in any order, but need not share a range.
    tied = nodes.withColumn("tie", F.struct("node", F.monotonically_increasing_id().alias("row")))
    ranged = laid_out_in_ranges(tied, "tree", order, "tie")
    counts = ranged.groupBy("tree", "_range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree",
        "_range",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    )
    inside = Window.partitionBy("tree", "_range").orderBy(order, "tie")
    placed = ranged.withColumn("pos", F.row_number().over(inside) - 1).join(offsets, ["tree", "_range"])
    return placed.withColumn("pos", F.col("pos") + F.col("before")).drop("tie", "_range", "before")


def _rounds(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` and the tops of their superblocks, round by round until each tree has one node."""
    rounds = [nodes]
    while nodes.where("size > 1").limit(1).count():
        reduced = _blocks(nodes.select("tree", "pos", "node", "size"), height).applyInPandas(_top(height), _TOP)
        nodes = materialize(reduced, "merkle-tops")
        rounds.append(nodes)
    return rounds


_TOP = "tree string, pos bigint, node string, size bigint"


def _blocks(nodes: DataFrame, height: int):
    return nodes.withColumn("block", F.expr(f"pos div {ARITY**height}")).groupBy("tree", "block")


def _top(height: int):
    def reduce(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        tree, block = key
        size = int(nodes["size"].iloc[0])
        levels = levels_of(nodes.sort_values("pos")["node"].tolist(), height, size <= ARITY**height)
        return pd.DataFrame({"tree": [tree], "pos": [block], "node": levels[-1], "size": [-(-size // ARITY**height)]})

    return reduce


def _above(paths: DataFrame, tree: str, pos: str) -> DataFrame:
    """Paths of the nodes of a round, stored as those of the superblocks of the round below."""
    columns = [F.col(tree).alias("tree"), F.col(pos).alias("block"), "subroot", "root", "proof", "places"]
    return materialize(paths.select(*columns), "merkle-paths")


_FOUND = (
    "tree string, pos bigint, id string, node string, subroot string, root string, "
    "proof array<string>, places array<int>, folded_root string"
)


def _found(nodes: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """The whole path of every node: superblocks meet the path of their top."""
    extra = [c if c in nodes.columns else F.lit(None).cast("string").alias(c) for c in ("id", "claimed")]
    inside = _blocks(nodes.select("tree", "pos", "node", "size", *extra), height)
    return inside.cogroup(paths.groupBy("tree", "block")).applyInPandas(_finish(height), _FOUND)


def _finish(height: int):
    def finish(key: tuple, nodes: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        outer = paths.iloc[0]
        above = list(outer["proof"]), [int(p) for p in outer["places"]]
        leaves = nodes["node"].tolist()
        levels = levels_of(leaves, height, int(nodes["size"].iloc[0]) <= ARITY**height)
        others = [_others(level) for level in levels[:-1]]
        proofs, places, roots = [], [], []
        for i, (leaf, claim) in enumerate(zip(leaves, nodes["claimed"])):
            proof, at = [], []
            for level in others:
                proof.append(level[i])
                at.append(i % ARITY)
                i //= ARITY
            proofs.append(proof + above[0])
            places.append(at + above[1])
            roots.append(_fold(claim if isinstance(claim, str) else leaf, proofs[-1], places[-1]))
        return pd.DataFrame(
            {
                "tree": nodes["tree"].tolist(),
                "pos": nodes["pos"].tolist(),
                "id": nodes["id"].tolist(),
                "node": leaves,
                "subroot": outer["subroot"],
                "root": outer["root"],
                "proof": proofs,
                "places": places,
                "folded_root": roots,
            }
        )

    return finish


def _others(level: list[str]) -> list[str]:
    """For every node of a level, the other nodes of its run."""
    out = []
    for first in range(0, len(level), ARITY):
        run = level[first : first + ARITY]
        out.extend("".join(run[:k] + run[k + 1 :]) for k in range(len(run)))
    return out


def _fold(node: str, proof: list[str], places: list[int]) -> str:
    for others, place in zip(proof, places, strict=True):
        before = place * _DIGEST
        node = sha256((others[:before] + node + others[before:]).encode()).hexdigest()
    return node
