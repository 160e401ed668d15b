"""Guards over whole repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.numbers import mib_text
from repoquarry.operators.stats import repo_sizes

# Fixed value: reason for rejecting a repository.
REPOSITORY_TOO_LARGE = "Repository too large: %s MB. Maximum allowed: %s MB."


def oversize_repositories(files: DataFrame, max_bytes: int) -> DataFrame:
    """(repo_id, bytes, error) of repositories above the limit; ``.git`` counts."""
    reason = F.format_string(REPOSITORY_TOO_LARGE, mib_text(F.col("bytes")), mib_text(F.lit(max_bytes)))
    return repo_sizes(files).where(F.col("bytes") > max_bytes).withColumn("error", reason)


def within_limit(files: DataFrame, too_large: DataFrame, drop_git: bool = True) -> DataFrame:
    """Files, directories or names of all repositories but ``too_large``; without ``.git`` as clones are kept.

    ``too_large`` holds one row per refused repository. Pass it as a stored table where ``files``
    carry contents: Spark then knows its size and broadcasts it while it is below its threshold, so
    contents are not shuffled. Above it the join shuffles, and adaptive execution splits hot keys.
    """
    if drop_git:
        files = files.where(~F.startswith("path", F.lit(".git/")) & (F.col("path") != ".git"))
    return files.join(too_large.select("repo_id"), "repo_id", "left_anti")
