"""Text summaries of file records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.paths import walk_key
from repoquarry.operators.ranking import first_per_key

# Wording of the summaries.
NO_FILES = "(no files parsed)"
MORE_FILES = "... and %d more files"
LANGUAGE = " | Language: "
SKIPPED = "  Skipped: "
ERROR = "  Error: "
TEXT_LABELS = {"functions": "  Functions: ", "classes": "  Classes: ", "imports": "  Imports: "}
BULLET_LABELS = {"functions": "  - functions: ", "classes": "  - classes: ", "imports": "  - imports: "}
BADGES = {"skipped": "(skipped)", "error": "(error)"}


def in_walk_order() -> list[Column]:
    return [walk_key(F.col("path"))]


def named(names: Column, label: str, n: int) -> Column:
    """``label`` and the first ``n`` names, or null without names."""
    return F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(F.slice(names, 1, n), ", ")))


def text_summaries(records: DataFrame, names: int = 10) -> DataFrame:
    """Multi-line summary of every file record: (repo_id, path, summary)."""
    found = F.concat_ws("\n", *[named(F.col(kind), label, names) for kind, label in TEXT_LABELS.items()])
    details = (
        F.when(F.col("skipped").isNotNull(), F.concat(F.lit(SKIPPED), F.col("skipped")))
        .when(F.col("error").isNotNull(), F.concat(F.lit(ERROR), F.col("error")))
        .when(found != "", found)
    )
    head = F.concat(F.col("path"), F.lit(LANGUAGE), F.col("language"))
    return records.select("repo_id", "path", F.concat_ws("\n", head, details).alias("summary"))


def shown_summaries(summaries: DataFrame, k: int = 15) -> DataFrame:
    """First ``k`` summaries of every repository and a closing line that counts the rest."""
    shown = first_per_key(summaries, ["repo_id"], in_walk_order(), k, rank="pos", spread=["path"])
    rest = summaries.groupBy("repo_id").agg((F.count("*") - k).alias("rest")).where("rest > 0")
    more = rest.select("repo_id", F.lit(k + 1).alias("pos"), more_line(F.col("rest")).alias("summary"))
    return shown.select("repo_id", "pos", "summary").unionByName(more)


def more_line(rest: Column) -> Column:
    return F.format_string(MORE_FILES, rest)


def bullet_lines(names: int = 6) -> Column:
    """Lines that describe one file record."""
    status = F.col("status")
    badge = F.when(status == "skipped", BADGES["skipped"]).when(status == "error", BADGES["error"]).otherwise("")
    head = F.format_string("- %s [%s] %s", "path", "language", badge)
    return F.array_compact(F.array(head, *[named(F.col(kind), label, names) for kind, label in BULLET_LABELS.items()]))


def bullet_summaries(records: DataFrame, limit: int = 20, names: int = 6) -> DataFrame:
    """The first ``limit`` file records of every repository as bullets: (repo_id, summary)."""
    described = records.select("repo_id", "path", bullet_lines(names).alias("lines"))
    shown = first_per_key(described, ["repo_id"], in_walk_order(), limit, spread=["path"])
    blocks = F.array_sort(F.collect_list(F.struct("rank", "lines")))
    listed = shown.groupBy("repo_id").agg(F.flatten(F.transform(blocks, lambda b: b["lines"])).alias("lines"))
    rest = records.groupBy("repo_id").agg((F.count("*") - limit).alias("rest"))
    more = F.when(F.col("rest") > 0, more_line(F.col("rest")))
    return listed.join(rest, "repo_id").select(
        "repo_id", F.concat_ws("\n", F.array_join("lines", "\n"), more).alias("summary")
    )
