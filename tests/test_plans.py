"""Physical plans: what is read, what is shuffled, what runs in Python."""

import re
from pathlib import Path

import pytest
from conftest import SF_DIR, plan, rows
from pyspark.sql import functions as F

from repoquarry.functions.tables import register
from repoquarry.operators import files as fo
from repoquarry.operators import guards, manifests, stats, tree
from repoquarry.operators.records import file_records, records_and_manifests, symbol_index
from repoquarry.operators.summaries import bullet_summaries
from repoquarry.plans import fixtures as fx
from repoquarry.sources import archives as ar
from repoquarry.sources.directories import list_directories, read_contents


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A stored table, so that the plans show what the scan reads."""
    folder = str(tmp_path_factory.mktemp("files") / "t")
    data = [("r", f"src/f{i}.py", 10, bytearray(b"x = 1")) for i in range(20)]
    spark.createDataFrame(data, "repo_id string, path string, bytes bigint, content binary").write.parquet(folder)
    return spark.read.parquet(folder)


def read_schemas(df):
    return set(re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().executedPlan().toString().replace("\n", " ")))


def exchanges(df):
    return [line for line in plan(df).splitlines() if re.search(r"\bExchange\b", line)]


METADATA_ONLY = {
    "scan_cap": lambda f: fo.scan_cap(f, 20),
    "tree": lambda f: tree.tree_lines(f, 20),
    "by_language": stats.by_language,
    "total_considered": stats.total_considered,
    "largest_files": stats.largest_files,
    "language_list": stats.language_list,
    "file_counts": stats.file_counts,
    "file_metrics": fo.file_metrics,
    "repo_sizes": stats.repo_sizes,
    "oversize_repositories": lambda f: guards.oversize_repositories(f, 1),
}


@pytest.mark.parametrize("name", METADATA_ONLY)
def test_content_is_not_read(files, name):
    schemas = read_schemas(METADATA_ONLY[name](files))
    assert schemas
    assert not any("content" in schema for schema in schemas)


@pytest.mark.parametrize(
    "build",
    [file_records, lambda f: symbol_index(file_records(f)), fo.previews, fo.code_files, fo.with_language],
)
def test_row_local_operators_do_not_shuffle(files, build):
    assert exchanges(build(files)) == []


def test_statistics_read_no_symbols(files):
    text = plan(stats.repo_stats(file_records(files)))
    assert "regexp_extract_all" not in text
    assert len(exchanges(stats.repo_stats(file_records(files)))) == 1


def test_python_files_are_parsed_once(files):
    records = file_records(files)
    for df in (records, records.where(F.col("status") == "error"), symbol_index(records.where("language = 'python'"))):
        assert plan(df).count("ArrowEvalPython") == 1


def test_records_and_manifests_read_contents_once(files):
    text = plan(records_and_manifests(files))
    assert text.count("FileScan") == 1
    assert text.count("ArrowEvalPython") == 1
    assert exchanges(records_and_manifests(files)) == []


def test_archives_are_listed_once(spark):
    archives = spark.createDataFrame([("a.zip", 1, bytearray(b"x"))], "path string, length bigint, content binary")
    for df in (ar.rejected_archives(archives), ar.with_verdict(archives), ar.extracted(archives)):
        assert plan(df).count("ArrowEvalPython") == 1
        assert exchanges(df) == []


@pytest.mark.parametrize(
    "build",
    [
        lambda f: stats.largest_files(f, 5),
        lambda f: stats.largest_files(f, 300),
        lambda f: stats.largest_files(f, 5000),
        lambda f: bullet_summaries(file_records(f), 20),
        lambda f: fo.scan_cap(f, 20),
        lambda f: tree.tree_lines(f, 500),
    ],
)
def test_hot_keys_are_cut_in_shares_for_every_number_of_rows(files, build):
    text = plan(build(files))
    assert ("WindowGroupLimit" in text and ", Partial" in text) or "5000" in text
    assert re.search(r"Exchange hashpartitioning\(repo_id#\d+L?, _w0#\d+L?, ", text)


def test_directory_work_is_not_merged_by_the_size_of_its_rows(spark):
    roots = spark.createDataFrame([("r", str(Path(__file__).parent))], "repo_id string, root string")
    text = plan(read_contents(list_directories(roots, tasks=7), tasks=9))
    assert "REPARTITION_BY_NUM" in text and ", 9)" in text


def test_manifest_names_reach_the_scan(files):
    text = plan(manifests.root_manifests(files))
    assert re.search(r"PushedFilters: \[[^\]]*In\(path", text)


def test_size_filter_reaches_the_scan(files):
    assert "LessThanOrEqual(bytes,5)" in plan(files.where(F.col("bytes") <= 5))


def test_refused_repositories_are_broadcast_so_contents_stay_in_place(spark, files, tmp_path):
    guards.oversize_repositories(files, 1).write.parquet(str(tmp_path / "t"))
    kept = guards.within_limit(files, spark.read.parquet(str(tmp_path / "t")))
    text = plan(kept)
    assert "BroadcastHashJoin" in text
    assert "hashpartitioning" not in text


def test_no_pattern_of_the_library_gathers_all_rows(files):
    """No plan needs a single partition or a product of rows."""
    for build in METADATA_ONLY.values():
        text = plan(build(files))
        assert "SinglePartition" not in text
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_table_functions_are_native_generators(spark):
    register(spark)
    files = spark.createDataFrame([("a.js", "class A {}")], "path string, content string")
    text = "SELECT path, s.*, l.* FROM {files}, LATERAL code_symbols(path, content) s, LATERAL head_lines(content, 3) l"
    shown = plan(spark.sql(text, files=files))
    assert "Generate inline" in shown and "Generate posexplode" in shown
    assert "Python" not in shown and "Join" not in shown


def test_uploads_are_made_few_rows_at_a_time(spark):
    """Arrow batches would hold up to 10,000 texts and their archives in a worker."""
    made = plan(fx.archives(spark, SF_DIR))
    assert "BatchEvalPython" in made and "ArrowEvalPython" not in made
    chosen = fx.archives(spark, SF_DIR, "path RLIKE '[149][.]'")
    assert plan(chosen).index("BatchEvalPython") < plan(chosen).index("RLIKE")
    expected = fx.archives(spark, SF_DIR).where("path RLIKE '[149][.]'")
    assert chosen.count() > 0 and rows(chosen, "path", "length") == rows(expected, "path", "length")
