"""Directory listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.paths import basename, depth, tree_key
from repoquarry.operators.files import with_directories
from repoquarry.operators.ranking import first_per_key

# Marks of a cut and of an empty listing.
TRUNCATED = "... (truncated)"
EMPTY = "(empty or invalid repository)"


def tree_lines(
    files: DataFrame,
    max_entries: int = 500,
    directories: DataFrame | None = None,
    repositories: DataFrame | None = None,
) -> DataFrame:
    """Indented listing of every repository: (repo_id, pos, line).

    Within a directory its files come first, then its sub-directories. A listing that reaches
    ``max_entries`` lines ends with a mark. ``repositories`` adds those without any entry,
    ``directories`` those without any file.

    A directory's first file follows it with only directories in between, so the first n lines use
    only the first n files: files are cut first, and each repository keeps a bounded number of rows.
    """
    order = [tree_key(F.col("path"), F.col("is_dir"))]
    leaves = files.select("repo_id", "path", F.lit(False).alias("is_dir"))
    if directories is not None:
        leaves = leaves.unionByName(directories.select("repo_id", "path", F.lit(True).alias("is_dir")))
    leaves = first_per_key(leaves, ["repo_id"], order, max_entries, spread=["path"]).drop("rank")
    entries = first_per_key(with_directories(leaves), ["repo_id"], order, max_entries, rank="pos")

    name = basename(F.col("path"))
    shown = F.when(F.col("is_dir"), F.concat(F.lit("- "), name, F.lit("/"))).otherwise(name)
    indent = depth(F.col("path"))
    line = F.struct(F.col("pos"), F.concat(F.repeat(F.lit("  "), indent), shown).alias("line"))
    mark = F.struct((F.col("pos") + 1).alias("pos"), F.lit(TRUNCATED).alias("line"))
    listed = entries.select(
        "repo_id", F.inline(F.when(F.col("pos") == max_entries, F.array(line, mark)).otherwise(F.array(line)))
    )
    if repositories is None:
        return listed
    every = repositories.select("repo_id").distinct().join(listed, "repo_id", "left")
    return every.select(
        "repo_id", F.coalesce("pos", F.lit(1)).alias("pos"), F.coalesce("line", F.lit(EMPTY)).alias("line")
    )


def tree_text(lines: DataFrame) -> DataFrame:
    """The listing of every repository as one text; lines are bounded by the listing's limit."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("repo_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("tree"))
