"""The whole job: files of many repositories to tables of records, statistics, listings and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.functions.paths import walk_key
from repoquarry.functions.symbols import REGEX_EXTRACTORS, Extractor
from repoquarry.operators.files import before_end, cap_ends
from repoquarry.operators.guards import oversize_repositories, within_limit
from repoquarry.operators.manifests import is_manifest, root_manifests
from repoquarry.operators.records import manifests_of, records_and_manifests, records_of, symbol_index
from repoquarry.operators.report import INSTRUCTIONS, prompts, repo_profiles, reports
from repoquarry.operators.requests import unique_names
from repoquarry.operators.stats import by_language, import_usage, largest_files, repo_stats
from repoquarry.operators.tree import tree_lines
from repoquarry.options import ReportOptions, ScanOptions
from repoquarry.sources.archives import (
    accepted_uploads,
    directories_of,
    files_of,
    list_folder,
    listed_uploads,
    refused_entries,
    repositories_of,
    shown_uploads,
)
from repoquarry.sources.ranges import opened_entries

# Arrow batches for jobs whose rows are whole files or whole archives; Spark also limits their bytes.
SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def ingest(
    spark: SparkSession, folder: str, options: ScanOptions = ScanOptions(), every_name: bool = False
) -> DataFrame:
    """Entries of all archives below ``folder``, each under a repository name of its own.

    Names and refusals by name or size come from the listing alone; a refused upload takes no name.
    Names are joined to the listing, and only then are archives opened, so no join moves contents.
    The folder is listed once, in tasks. ``every_name`` also takes what Spark's file sources leave out:
    empty files and names that start with ``_`` or ``.``.
    """
    listed = list_folder(spark, folder)
    uploads = listed_uploads(listed) if every_name else shown_uploads(listed)
    named = unique_names(accepted_uploads(uploads, options), arrival="modificationTime", tie="path")
    return opened_entries(named, options).unionByName(refused_entries(uploads, options), allowMissingColumns=True)


def analyze(
    files: DataFrame,
    folder: str,
    generated_at: datetime,
    options: ScanOptions = ScanOptions(),
    report: ReportOptions = ReportOptions(),
    directories: DataFrame | None = None,
    instructions: str = INSTRUCTIONS,
    repositories: DataFrame | None = None,
    extractors: dict[str, Extractor] = REGEX_EXTRACTORS,
) -> dict[str, DataFrame]:
    """Write every table below ``folder`` and return them by name.

    ``files`` should be a stored table. Contents are read once, for records and manifests together;
    everything else works on names, sizes and the tables written before. ``repositories`` names all
    repositories, so those without a file get a listing, statistics and a report too; by default
    ``files`` and ``directories`` give them. ``extractors`` name the languages read beside Python, in records
    and in statistics alike, and ``options.extensions`` the files that are in them.
    """
    spark, languages = files.sparkSession, ["python", *extractors]

    def stored(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    too_large = stored("refused_repositories", oversize_repositories(files, options.max_extract_bytes))
    kept = within_limit(files, too_large, options.drop_git)
    listing = stored("listing", kept.select("repo_id", "path", "bytes"))
    if directories is not None:
        directories = stored("directories", within_limit(directories, too_large, options.drop_git))
    if repositories is None:
        known = files if directories is None else files.select("repo_id").unionByName(directories.select("repo_id"))
        repositories = known.select("repo_id")
    named = repositories.select("repo_id").distinct()
    every = stored("repositories", named.join(too_large.select("repo_id"), "repo_id", "left_anti"))
    considered = listing
    if options.max_files is not None:
        ends = stored("scan_ends", cap_ends(listing, options.max_files, directories))
        considered = stored("considered", before_end(listing, ends))
        # What lies beyond the cap is not parsed; manifests are looked up in the whole repository.
        manifest = is_manifest(F.col("path"), options.strip_top_level)
        kept = kept.join(ends, "repo_id", "left").where(manifest | (walk_key(F.col("path")) <= F.col("end"))).drop("end")
    scanned = stored("scanned", records_and_manifests(kept, options, extractors))
    manifests = root_manifests(manifests_of(scanned), listing if options.strip_top_level else None)
    records = stored("file_records", records_of(scanned))
    profiles = stored("profiles", repo_profiles(listing, records, manifests, report, considered, every, options.extensions))
    return {
        "repositories": every,
        "refused_repositories": too_large,
        "listing": listing,
        "file_records": records,
        "manifests": manifests,
        "profiles": profiles,
        "symbol_index": stored("symbol_index", symbol_index(records)),
        "import_usage": stored("import_usage", import_usage(records)),
        "repo_stats": stored("repo_stats", repo_stats(records, every)),
        "by_language": stored("by_language", by_language(considered, languages, options.extensions)),
        "largest_files": stored("largest_files", largest_files(considered, report.largest_files, options.extensions)),
        "tree": stored("tree", tree_lines(listing, report.tree_entries, directories, every)),
        "reports": stored("reports", reports(profiles, generated_at, report)),
        "prompts": stored("prompts", prompts(profiles, instructions, report)),
    }


def analyze_archives(
    spark: SparkSession,
    source: str,
    folder: str,
    generated_at: datetime,
    options: ScanOptions = ScanOptions(),
    report: ReportOptions = ReportOptions(),
    every_name: bool = False,
) -> dict[str, DataFrame]:
    """``analyze`` for a folder of archives; also writes the extracted entries and the rejections."""
    ingest(spark, source, options, every_name).write.mode("overwrite").parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")
    tables = analyze(
        files_of(entries),
        folder,
        generated_at,
        options,
        report,
        directories_of(entries),
        repositories=repositories_of(entries),
    )
    tables["refused_archives"] = entries.where(F.col("error").isNotNull()).select("repo_id", "path", "error")
    return tables
