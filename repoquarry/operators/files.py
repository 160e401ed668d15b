"""Projections and filters over ``files(repo_id, path, bytes, content)``.

Operators that need no text read no ``content``; the column may be absent for them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.languages import (
    LANGUAGE_BY_EXTENSION,
    PARSEABLE_LANGUAGES,
    Extensions,
    ends_like_code,
    is_code,
    is_parseable,
    language_of,
)
from repoquarry.functions.numbers import OVERSIZE, kib_text
from repoquarry.functions.paths import ancestors, raw_suffix, walk_key
from repoquarry.functions.text import decode_utf8, universal_newlines
from repoquarry.operators.ranking import first_per_key


def code_files(files: DataFrame, extensions: Extensions = LANGUAGE_BY_EXTENSION) -> DataFrame:
    """Files with one of the supported extensions, in any case."""
    return files.where(is_code(F.col("path"), extensions))


def parseable_files(
    files: DataFrame, languages: Iterable[str] = PARSEABLE_LANGUAGES, extensions: Extensions = LANGUAGE_BY_EXTENSION
) -> DataFrame:
    """Files in a language that symbols are extracted from."""
    return files.where(is_parseable(F.col("path"), languages, extensions))


def with_language(
    files: DataFrame, default: str = "unknown", extensions: Extensions = LANGUAGE_BY_EXTENSION
) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path"), default, extensions))


def oversize_mark(size: Column, max_file_bytes: int) -> Column:
    return F.when(size > max_file_bytes, F.lit(OVERSIZE))


def tag_oversize(files: DataFrame, max_file_bytes: int) -> DataFrame:
    return files.withColumn("skipped", oversize_mark(F.col("bytes"), max_file_bytes))


def scan_cap(files: DataFrame, max_files: int, directories: DataFrame | None = None) -> DataFrame:
    """The first ``max_files`` entries of every repository in walk order: (repo_id, path, is_dir, rank).

    Directories count as entries, also those only implied by a file's path. A directory comes right
    before its contents, so every directory among the first n entries belongs to one of the first n
    files. Files are therefore cut before directories are derived, and the rest stays small.
    """
    leaves = files.select("repo_id", "path", F.lit(False).alias("is_dir"))
    if directories is not None:
        leaves = leaves.unionByName(directories.select("repo_id", "path", F.lit(True).alias("is_dir")))
    order = [walk_key(F.col("path"))]
    leaves = first_per_key(leaves, ["repo_id"], order, max_files, spread=["path"]).drop("rank")
    return first_per_key(with_directories(leaves), ["repo_id"], order, max_files)


def with_directories(leaves: DataFrame) -> DataFrame:
    """``leaves(repo_id, path, is_dir)`` and every directory above them, each once, in one pass."""
    own = F.array(F.struct("path", "is_dir"))
    above = F.transform(ancestors(F.col("path")), lambda d: F.struct(d.alias("path"), F.lit(True).alias("is_dir")))
    return leaves.select("repo_id", F.inline(F.concat(own, above))).distinct()


def cap_ends(files: DataFrame, max_files: int, directories: DataFrame | None = None) -> DataFrame:
    """The last file, in walk order, that the scan cap keeps of every repository: (repo_id, end)."""
    kept = scan_cap(files, max_files, directories).where(~F.col("is_dir"))
    return kept.groupBy("repo_id").agg(F.max(walk_key(F.col("path"))).alias("end"))


def before_end(files: DataFrame, ends: DataFrame) -> DataFrame:
    """Files up to the ``end`` of their repository. One short row per repository joins the files."""
    return files.join(ends, "repo_id").where(walk_key(F.col("path")) <= F.col("end")).select(*files.columns)


def capped(files: DataFrame, max_files: int | None, directories: DataFrame | None = None) -> DataFrame:
    """Files among the first ``max_files`` entries of their repository; all files if None."""
    return files if max_files is None else before_end(files, cap_ends(files, max_files, directories))


def viewer_files(files: DataFrame, extensions: Extensions = LANGUAGE_BY_EXTENSION) -> DataFrame:
    """Code files of the viewer: extensions are compared with case, and nothing is capped."""
    return files.where(ends_like_code(F.col("path"), extensions))


def file_metrics(files: DataFrame, extensions: Extensions = LANGUAGE_BY_EXTENSION) -> DataFrame:
    """Size, extension and number of code files shown beside each code file."""
    shown = viewer_files(files, extensions).select("repo_id", "path", "bytes")
    totals = shown.groupBy("repo_id").agg(F.count("*").alias("total_files"))
    extension = raw_suffix(F.col("path"))
    return shown.join(totals, "repo_id").select(
        "repo_id",
        "path",
        F.concat(kib_text(F.col("bytes"), 2), F.lit(" KB")).alias("size_text"),
        F.when(extension == "", "Unknown").otherwise(F.upper(F.substring(extension, 2, 2**31 - 1))).alias("extension"),
        "total_files",
    )


def previews(
    files: DataFrame, preview_chars: int = 500 * 1024, extensions: Extensions = LANGUAGE_BY_EXTENSION
) -> DataFrame:
    """Text of every code file; of files above the limit in bytes, that many leading characters."""
    text = universal_newlines(decode_utf8(F.col("content")))
    head = F.when(F.col("bytes") > preview_chars, F.substring(text, 1, preview_chars)).otherwise(text)
    language = language_of(F.col("path"), "text", extensions)
    return viewer_files(files, extensions).select("repo_id", "path", language.alias("language"), head.alias("preview"))
