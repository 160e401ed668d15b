"""File records: one row of symbols per parseable file, and the long index over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.languages import UNKNOWN, is_parseable, language_of
from repoquarry.functions.symbols import REGEX_EXTRACTORS, Extractor, python_symbols
from repoquarry.functions.text import decode_utf8
from repoquarry.operators.files import oversize_mark
from repoquarry.operators.manifests import is_manifest
from repoquarry.options import ScanOptions

KINDS = ["functions", "classes", "imports"]


def file_records(
    files: DataFrame, options: ScanOptions = ScanOptions(), extractors: dict[str, Extractor] = REGEX_EXTRACTORS
) -> DataFrame:
    """Symbols of every file in Python or a language of ``extractors``, in one pass and without a shuffle.

    Extensions of a language are those of ``options``; a language without one is an error, as no file
    could be in it. Content above the size limit is dropped by its size before it is decoded. Python files go to the
    Arrow job as bytes, all others to regular expressions as text.
    """
    return _extracted(files.where(_is_read(options, extractors)), options, extractors).drop("manifest")


def records_and_manifests(
    files: DataFrame, options: ScanOptions = ScanOptions(), extractors: dict[str, Extractor] = REGEX_EXTRACTORS
) -> DataFrame:
    """File records and, as further rows with ``manifest`` content, possible manifests.

    For a job that needs both, this reads all contents once instead of twice. Store the result, then
    split it with ``records_of`` and ``manifests_of``.
    """
    wanted = _is_read(options, extractors) | is_manifest(F.col("path"), options.strip_top_level)
    return _extracted(files.where(wanted), options, extractors)


def records_of(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("language") != UNKNOWN).drop("manifest")


def manifests_of(scanned: DataFrame) -> DataFrame:
    """Possible manifests as files(repo_id, path, content)."""
    return scanned.where(F.col("manifest").isNotNull()).select("repo_id", "path", F.col("manifest").alias("content"))


def _is_read(options: ScanOptions, extractors: dict[str, Extractor]) -> Column:
    languages = ["python", *extractors]
    if unreached := set(languages) - set(options.extensions.values()):
        raise ValueError(f"no extension names {', '.join(sorted(unreached))}")
    return is_parseable(F.col("path"), languages, options.extensions)


def _extracted(files: DataFrame, options: ScanOptions, extractors: dict[str, Extractor]) -> DataFrame:
    language = F.col("language")
    skipped = oversize_mark(F.col("bytes"), options.max_file_bytes)
    manifest = F.when(is_manifest(F.col("path"), options.strip_top_level), F.col("content"))
    # A manifest may have the extension of a language that is not read.
    named = F.when(_is_read(options, extractors), language_of(F.col("path"), extensions=options.extensions))
    routed = files.select(
        "repo_id",
        "path",
        "bytes",
        F.coalesce(named, F.lit(UNKNOWN)).alias("language"),
        skipped.alias("skipped"),
        F.when(skipped.isNull(), F.col("content")).alias("kept"),
        manifest.alias("manifest"),
    )
    split = routed.select(
        "repo_id",
        "path",
        "bytes",
        "language",
        "skipped",
        "manifest",
        F.when(language == "python", F.col("kept")).alias("raw"),
        F.when(language.isin(list(extractors)), decode_utf8(F.col("kept"))).alias("source"),
    )
    columns = {kind: F.when(language == "python", F.col(f"python.{kind}")) for kind in KINDS}
    for extractor in dict.fromkeys(extractors.values()):
        spoken = [name for name, e in extractors.items() if e is extractor]
        for kind, names in extractor(F.col("source")).items():
            columns[kind] = columns[kind].when(language.isin(spoken), names)
    return (
        split.withColumn("python", python_symbols(F.col("raw"), options.extended_python))
        .select(
            "repo_id",
            "path",
            "language",
            *[_never_null(columns[kind]).alias(kind) for kind in KINDS],
            F.col("python.error").alias("error"),
            "skipped",
            "bytes",
            "manifest",
        )
        .withColumn("status", status())
    )


def _never_null(names: Column) -> Column:
    return F.coalesce(names, F.array().cast("array<string>"))


def status() -> Column:
    """``skipped``, ``error`` or ``scanned``; an empty mark counts as none."""
    return (
        F.when(F.coalesce(F.col("skipped"), F.lit("")) != "", "skipped")
        .when(F.coalesce(F.col("error"), F.lit("")) != "", "error")
        .otherwise("scanned")
    )


def symbol_index(records: DataFrame) -> DataFrame:
    """One row per symbol: (repo_id, path, language, kind, pos, name)."""
    found = F.concat(_labelled("functions", "function"), _labelled("classes", "class"), _labelled("imports", "import"))
    return records.select("repo_id", "path", "language", F.inline(found))


def _labelled(kind: str, label: str) -> Column:
    return F.transform(
        kind, lambda name, pos: F.struct(F.lit(label).alias("kind"), pos.alias("pos"), name.alias("name"))
    )
