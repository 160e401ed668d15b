"""Statistics per repository and across the corpus."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.functions.languages import LANGUAGE_BY_EXTENSION, PARSEABLE_LANGUAGES, Extensions, language_of
from repoquarry.functions.numbers import kib
from repoquarry.functions.paths import walk_key
from repoquarry.operators.files import code_files, parseable_files, viewer_files
from repoquarry.operators.ranking import first_per_key


def repo_stats(records: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """Files considered, scanned, skipped and failed per repository; ``repositories`` adds those without any."""
    state = F.col("status")
    found = records.groupBy("repo_id").agg(
        F.count("*").alias("total_considered"),
        F.count_if(state == "scanned").alias("scanned"),
        F.count_if(state == "skipped").alias("skipped"),
        F.count_if(state == "error").alias("errors"),
    )
    if repositories is None:
        return found
    return repositories.select("repo_id").distinct().join(found, "repo_id", "left").fillna(0)


def repo_counts(records: DataFrame) -> DataFrame:
    """``repo_stats`` and the files per language, in one pass over ``records``.

    (repo_id, total_considered, scanned, skipped, errors, languages), the last a list of (language,
    n_files) by name. The corpus is counted per (repository, language) first, so only such counts meet.
    """
    state, names = F.col("status"), {"scanned": "scanned", "skipped": "skipped", "errors": "error"}
    by_name = records.groupBy("repo_id", "language").agg(
        F.count("*").alias("n_files"), *[F.count_if(state == value).alias(name) for name, value in names.items()]
    )
    return by_name.groupBy("repo_id").agg(
        F.sum("n_files").alias("total_considered"),
        *[F.sum(name).alias(name) for name in names],
        F.array_sort(F.collect_list(F.struct("language", "n_files"))).alias("languages"),
    )


def count_totals(records: DataFrame) -> DataFrame:
    """Files by repository, language and status, with their totals: (repo_id, language, status, level, n_files).

    Totals of a repository's languages, of a repository, of every (language, status) and of the corpus
    come from one grouping over the finest counts, not over files. A total has nulls in the columns it runs over, and
    ``level`` tells it from a null in the data: 0 none, 1 status, 3 language and status, 4 repository, 7 all.
    An empty table gives no rows.
    """
    keys = ["repo_id", "language", "status"]
    finest = records.groupBy(*keys).agg(F.count("*").alias("n"))
    sets = [keys, keys[:2], keys[:1], keys[1:], []]
    level = F.grouping_id(*keys).cast("int").alias("level")
    return finest.groupingSets(sets, *keys).agg(level, F.sum("n").alias("n_files"))


def total_considered(
    files: DataFrame, languages: Iterable[str] = PARSEABLE_LANGUAGES, extensions: Extensions = LANGUAGE_BY_EXTENSION
) -> DataFrame:
    """Number of file records per repository, from paths alone; ``languages`` are those that are read."""
    return parseable_files(files, languages, extensions).groupBy("repo_id").agg(F.count("*").alias("total_considered"))


def by_language(
    files: DataFrame, languages: Iterable[str] = PARSEABLE_LANGUAGES, extensions: Extensions = LANGUAGE_BY_EXTENSION
) -> DataFrame:
    """Files per language, skipped and failed ones included, from paths alone."""
    return (
        parseable_files(files, languages, extensions)
        .groupBy("repo_id", language_of(F.col("path"), extensions=extensions).alias("language"))
        .agg(F.count("*").alias("n_files"))
    )


def language_distribution(languages: DataFrame) -> DataFrame:
    """Languages of every repository in display order: most files first."""
    by_files = Window.partitionBy("repo_id").orderBy(F.desc("n_files"), F.asc("language"))
    return languages.withColumn("rank", F.row_number().over(by_files))


def language_list(
    files: DataFrame, languages: Iterable[str] = PARSEABLE_LANGUAGES, extensions: Extensions = LANGUAGE_BY_EXTENSION
) -> DataFrame:
    """Distinct languages of every repository as one text."""
    names = F.array_sort(F.collect_set(language_of(F.col("path"), extensions=extensions)))
    return parseable_files(files, languages, extensions).groupBy("repo_id").agg(F.array_join(names, ", ").alias("languages"))


def largest_files(files: DataFrame, k: int = 5, extensions: Extensions = LANGUAGE_BY_EXTENSION) -> DataFrame:
    """The ``k`` largest code files of every repository, in any supported language."""
    order = [F.desc("bytes"), walk_key(F.col("path"))]
    sized = code_files(files, extensions).select("repo_id", "path", "bytes")
    return first_per_key(sized, ["repo_id"], order, k, spread=["path"]).select(
        "repo_id", "rank", "path", "bytes", kib(F.col("bytes")).alias("kb")
    )


def file_counts(
    files: DataFrame, languages: Iterable[str] = PARSEABLE_LANGUAGES, extensions: Extensions = LANGUAGE_BY_EXTENSION
) -> DataFrame:
    """Code files listed by the viewer and files analysed, per repository."""
    listed = viewer_files(files, extensions).groupBy("repo_id").agg(F.count("*").alias("code_files"))
    analysed = total_considered(files, languages, extensions).withColumnRenamed("total_considered", "analysed_files")
    joined = listed.join(analysed, "repo_id", "full")
    return joined.select("repo_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("code_files", "analysed_files")])


def import_usage(records: DataFrame) -> DataFrame:
    """Files and repositories that import each module.

    A file counts once per module: repeats are removed inside its row, so no shuffle holds paths.
    """
    return (
        records.select("repo_id", F.explode(F.array_distinct("imports")).alias("module"))
        .groupBy("module", "repo_id")
        .agg(F.count("*").alias("files"))
        .groupBy("module")
        .agg(F.sum("files").alias("n_files"), F.count("*").alias("n_repos"))
    )


def repo_sizes(files: DataFrame) -> DataFrame:
    """Total size per repository."""
    return files.groupBy("repo_id").agg(F.sum("bytes").alias("bytes"))
