"""Statistics that are kept as repositories arrive.

A batch adds small aggregates of its own repositories: files by language and status, and files by imported
module. They can be added up, so the statistics of all repositories follow from them without reading a
record again. A repository that comes again replaces what it had brought before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REPOSITORIES = "repo_id string, batch bigint"
_FILES = "repo_id string, language string, status string, n_files bigint, batch bigint"
_IMPORTS = "repo_id string, module string, n_files bigint, batch bigint"


def add_statistics(records: DataFrame, repositories: DataFrame, folder: str, batch: int) -> None:
    """Write the aggregates of a batch of whole repositories, given by their records and names.

    Batches are numbered in order of arrival. A batch that is written again replaces itself, so a job that
    failed can be repeated. Rows written grow with the languages and modules of the batch, not with its
    files. Repositories without any file or record are known too; records of others are left out.
    """
    known = repositories.select("repo_id").where("repo_id IS NOT NULL").distinct()
    own = records.join(known, "repo_id", "left_semi")
    files = own.groupBy("repo_id", "language", "status").agg(F.count("*").alias("n_files"))
    modules = own.select("repo_id", F.explode(F.array_distinct("imports")).alias("module"))
    imports = modules.groupBy("repo_id", "module").agg(F.count("*").alias("n_files"))
    for name, part in (("files", files), ("imports", imports), ("repositories", known)):
        part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def _latest(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Aggregates of each repository's last batch."""
    arrived = spark.read.schema(_REPOSITORIES).parquet(f"{folder}/repositories")
    last = arrived.groupBy("repo_id").agg(F.max("batch").alias("batch"))
    return spark.read.schema(schema).parquet(f"{folder}/{name}").join(last, ["repo_id", "batch"])


def maintained_repo_stats(spark: SparkSession, folder: str) -> DataFrame:
    """``stats.repo_stats`` of all repositories that have arrived, those without files included."""
    files = _latest(spark, folder, "files", _FILES)

    def files_of(status: str):
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n_files"))), F.lit(0))

    found = files.groupBy("repo_id").agg(
        F.sum("n_files").alias("total_considered"),
        files_of("scanned").alias("scanned"),
        files_of("skipped").alias("skipped"),
        files_of("error").alias("errors"),
    )
    every = spark.read.schema(_REPOSITORIES).parquet(f"{folder}/repositories").select("repo_id").distinct()
    return every.join(found, "repo_id", "left").fillna(0)


def maintained_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """``stats.by_language`` of all repositories that have arrived."""
    files = _latest(spark, folder, "files", _FILES)
    return files.groupBy("repo_id", "language").agg(F.sum("n_files").alias("n_files"))


def maintained_import_usage(spark: SparkSession, folder: str) -> DataFrame:
    """``stats.import_usage`` of all repositories that have arrived."""
    imports = _latest(spark, folder, "imports", _IMPORTS)
    return imports.groupBy("module").agg(F.sum("n_files").alias("n_files"), F.count("*").alias("n_repos"))
