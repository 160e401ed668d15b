"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.functions import numbers, paths, symbols, text, urls
from repoquarry.functions.languages import extension_table, language_of
from repoquarry.functions.tables import register
from repoquarry.operators import files as fo
from repoquarry.operators import guards, imports, layout, manifests, report, requests, stats, summaries, tree
from repoquarry.operators.records import file_records, symbol_index
from repoquarry.options import ReportOptions, ScanOptions
from repoquarry.plans import fixtures as fx
from repoquarry.plans.analysis import ingest
from repoquarry.schemas import EXTRACTED
from repoquarry.sources import archives as ar
from repoquarry.sources import ranges
from repoquarry.sources.blobs import write_blobs
from repoquarry.sources.directories import list_directories, read_contents
from repoquarry.sources.shared import materialize, new_folder
from repoquarry.streaming.ingest import archive_stream, ingest_new_archives
from repoquarry.streaming.statistics import (
    add_statistics,
    maintained_by_language,
    maintained_import_usage,
    maintained_repo_stats,
)

SCAN = ScanOptions(
    max_upload_bytes=fx.MAX_UPLOAD_BYTES, max_extract_bytes=fx.MAX_EXTRACT_BYTES, max_file_bytes=fx.MAX_FILE_BYTES
)
# Upload sizes are another guard's matter where members are judged.
MEMBERS = ScanOptions(max_extract_bytes=fx.MAX_EXTRACT_BYTES)
GENERATED_AT = datetime(2026, 1, 2, 3, 4, 5)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _records(spark, sf):
    return file_records(fx.files(spark, sf), SCAN)


def _joined(names):
    return F.array_join(names, ",")


# Sources and guards


# Subfolders that uploads are spread over, as one task lists a folder.
SUBFOLDERS = 256


def _write_uploads(archives, folder):
    inside = F.concat_ws("/", F.pmod(F.xxhash64("path"), F.lit(SUBFOLDERS)), "path")
    write_blobs(archives.withColumn("path", inside), folder).agg(F.sum("bytes")).collect()


@query
def s1_archive_scan(spark, sf):
    folder = new_folder(spark, "uploads")
    _write_uploads(fx.archives(spark, sf), folder)
    name = paths.basename(F.col("path")).alias("archive")
    whole = F.octet_length("content") == F.col("length")
    read = ar.read_archives(spark, folder).select(name, "length", whole.alias("whole"), F.lit("").alias("error"))
    refused = ar.refused_uploads(ar.list_uploads(spark, folder))
    unread = [F.lit(0).cast("bigint").alias("length"), F.lit(False).alias("whole")]
    return read.unionByName(refused.select(name, *unread, "error"))


@query
def s2_upload_guard(spark, sf):
    refused = ar.upload_rejection(F.col("path"), F.col("length"), SCAN)
    return fx.archives(spark, sf).select("path", F.coalesce(refused, F.lit("")).alias("error"))


@query
def s3_archive_members(spark, sf):
    listed = ar.with_members(fx.archives(spark, sf), MEMBERS)
    members = listed.select(F.col("path").alias("archive"), F.inline("members"))
    return members.withColumn("bytes", F.col("bytes").cast("bigint"))


@query
def s4_path_guard(spark, sf):
    listed = ar.with_members(fx.archives(spark, sf), MEMBERS).where(F.col("members").isNotNull())
    return listed.select(F.col("path").alias("archive"), ar.has_unsafe_path(F.col("members")).alias("unsafe"))


@query
def s5_zip_bomb_guard(spark, sf):
    listed = ar.with_members(fx.archives(spark, sf), MEMBERS).where(F.col("members").isNotNull())
    size = ar.declared_bytes(F.col("members"))
    return listed.select(
        F.col("path").alias("archive"), size.cast("bigint").alias("declared"), (size > MEMBERS.max_extract_bytes).alias("too_large")
    )


@query
def s6_bad_archives(spark, sf):
    return ar.rejected_archives(fx.archives(spark, sf), MEMBERS)


@query
def s7_extracted_files(spark, sf):
    entries = ar.extracted(fx.archives(spark, sf), MEMBERS)
    return ar.files_of(entries).select("repo_id", "path", "bytes", F.md5("content").alias("digest"))


def _uploaded(spark, sf):
    """Uploads as files, listed: (repo_id, path, length)."""
    folder = new_folder(spark, "uploads")
    _write_uploads(fx.archives(spark, sf), folder)
    uploads = ar.list_uploads(spark, folder)
    return uploads.select(paths.stem(F.col("path")).alias("repo_id"), "path", "length")


@query
def s3_members_by_range(spark, sf):
    """Members of archives of which only the ends are read."""
    listed = ranges.list_members(_uploaded(spark, sf), MEMBERS)
    # The fixture's paths begin with the folder of the uploads.
    archive = F.concat(F.lit("uploads/"), paths.basename(F.col("path"))).alias("archive")
    members = listed.select(archive, F.inline("members"))
    return members.select("archive", "ordinal", "path", "is_dir", F.col("bytes").cast("bigint").alias("bytes"))


@query
def s7_files_by_range(spark, sf):
    """Files of archives that are cut into ranges of a few hundred bytes."""
    entries = ranges.entries_by_range(_uploaded(spark, sf), MEMBERS, range_bytes=500)
    return ar.files_of(entries).select("repo_id", "path", "bytes", F.md5("content").alias("digest"))


def _two_folders(spark, sf):
    """Every upload in one folder, and three in ten under the same name in a second folder, later."""
    folder = new_folder(spark, "uploads")
    for name, chosen in (("a", "true"), ("b", "path RLIKE '[149][.]'")):
        _write_uploads(fx.archives(spark, sf, chosen), f"{folder}/{name}")
    return folder


def _entry_rows(entries):
    size = F.coalesce("bytes", F.lit(0)).alias("bytes")
    path = F.when(F.col("error").isNull(), F.col("path")).otherwise(paths.basename(F.col("path"))).alias("path")
    # Reasons carry interpreter texts for broken archives; their beginning tells them apart.
    reason = F.coalesce(F.substring_index("error", ":", 1), F.lit("")).alias("reason")
    return entries.select("repo_id", path, "is_dir", size, reason)


@query
def s7_ingest(spark, sf):
    """Entries and refusals of a whole folder with equal names, as one job."""
    return _entry_rows(ingest(spark, _two_folders(spark, sf), SCAN))


@query
def s7_stream_ingest(spark, sf):
    """The same entries and refusals as a stream finds them, in several batches."""
    source, folder, checkpoint = _two_folders(spark, sf), *(new_folder(spark, name) for name in ("ingested", "stream"))
    arriving = archive_stream(spark, source, max_archives_per_batch=5000)
    ingest_new_archives(arriving, folder, checkpoint, SCAN).awaitTermination()
    return _entry_rows(spark.read.schema(EXTRACTED).parquet(f"{folder}/entries"))


@query
def s8_directory_scan(spark, sf):
    folder = new_folder(spark, "trees")
    marks = F.array(*map(F.lit, fx.ODD_NAMES))
    mark = F.concat(F.lit("/"), F.element_at(marks, (F.col("file_id") % len(fx.ODD_NAMES) + 1).cast("int")))
    files = fx.files(spark, sf).withColumn("path", F.replace(F.col("path"), F.lit("/f"), mark))
    placed = files.select(F.concat_ws("/", "repo_id", "path").alias("path"), "content")
    write_blobs(placed, folder).agg(F.sum("bytes")).collect()
    roots = files.select("repo_id").distinct().withColumn("root", F.concat(F.lit(folder + "/"), "repo_id"))
    listed = fo.code_files(list_directories(roots).where(~F.col("is_dir")))
    return read_contents(listed).select("repo_id", "path", "bytes", F.md5("content").alias("digest"))


@query
def s9_text_decode(spark, sf):
    # Lone bytes, a genuine replacement character and a cut sequence after every third text.
    tail = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF41C328EFBFBDE28242"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(F.col("text").cast("binary"), tail)
    decoded = fx.documents(spark, sf).select("doc_id", text.decode_utf8(raw).alias("source"))
    return decoded.select("doc_id", F.length("source").alias("n_chars"), F.md5("source").alias("digest"))


@query
def s10_repo_size(spark, sf):
    return stats.repo_sizes(fx.files(spark, sf))


@query
def s11_repo_size_guard(spark, sf):
    # Every 17th file lies below .git, which counts for the limit and is then removed.
    inside = F.when(F.col("file_id") % 17 == 0, F.concat(F.lit(".git/"), "path")).otherwise(F.col("path"))
    files = fx.files(spark, sf).drop("content").withColumn("path", inside)
    too_large = materialize(guards.oversize_repositories(files, fx.MAX_REPO_BYTES), "too-large")
    kept = guards.within_limit(files, too_large).select("repo_id", "path", F.lit("").alias("error"))
    return kept.unionByName(too_large.select("repo_id", F.lit("").alias("path"), "error"))


@query
def s12_unique_names(spark, sf):
    """Every request refused or named, by turns."""
    found = requests.named_requests(fx.url_requests(spark, sf))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("name", "unique_name", "error")]
    return found.select("req_id", *texts)


# Requests


@query
def u1_url_validation(spark, sf):
    return requests.validated(fx.url_requests(spark, sf)).select("req_id", "is_valid", "error")


@query
def u2_repo_name(spark, sf):
    return fx.url_requests(spark, sf).select(
        "req_id",
        urls.repository_name(F.col("url")).alias("name"),
        urls.repository_name(F.col("url"), strict=True).alias("strict_name"),
    )


@query
def u3_request_split(spark, sf):
    asked = fx.url_requests(spark, sf)
    taken = requests.accepted(asked).withColumns({"outcome": F.lit("accepted"), "error": F.lit("")})
    refused = requests.rejected(asked).select("req_id", "url", F.lit("rejected").alias("outcome"), "error")
    return taken.unionByName(refused)


@query
def u3_request_dedup(spark, sf):
    """Every request with the one that is kept in its place."""
    found = requests.with_first(fx.url_requests(spark, sf))
    return found.select("req_id", F.coalesce("repository", F.lit("")).alias("repository"), "kept", "is_kept")


# Files


@query
def f1_suffix(spark, sf):
    return fx.files(spark, sf).select("file_id", paths.suffix(F.col("path")).alias("suffix"))


@query
def f2_code_files(spark, sf):
    return fo.code_files(fx.files(spark, sf)).select("repo_id", "path")


@query
def f3_language(spark, sf):
    return fo.with_language(fx.files(spark, sf)).select("path", "language")


@query
def f4_parseable_files(spark, sf):
    return fo.parseable_files(fx.files(spark, sf)).select("repo_id", "path")


@query
def f5_oversize(spark, sf):
    tagged = fo.tag_oversize(fx.files(spark, sf), fx.MAX_FILE_BYTES)
    return tagged.select("path", "bytes", F.coalesce("skipped", F.lit("")).alias("skipped"))


@query
def f6_scan_cap(spark, sf):
    return fo.scan_cap(fx.files(spark, sf), fx.MAX_FILES)


@query
def f7_viewer_files(spark, sf):
    return fo.viewer_files(fx.files(spark, sf)).select("repo_id", "path")


@query
def f8_file_metrics(spark, sf):
    return fo.file_metrics(fx.files(spark, sf))


@query
def f9_preview(spark, sf):
    shown = fo.previews(fx.files(spark, sf), fx.PREVIEW_CHARS)
    return shown.select("path", F.length("preview").alias("n_chars"), F.md5("preview").alias("digest"))


@query
def f10_display_language(spark, sf):
    return fx.files(spark, sf).select("path", language_of(F.col("path"), "text").alias("language"))


# Symbols


def _python(spark, sf, kind):
    read = fx.files(spark, sf).where(language_of(F.col("path")) == "python")
    found = read.select("repo_id", "path", symbols.python_symbols(F.col("content")).alias("found"))
    return found.select("repo_id", "path", F.posexplode(f"found.{kind}").alias("pos", "name"))


@query
def x1_python_functions(spark, sf):
    return _python(spark, sf, "functions")


@query
def x2_python_classes(spark, sf):
    return _python(spark, sf, "classes")


@query
def x3_python_imports(spark, sf):
    return _python(spark, sf, "imports")


@query
def x4_parse_errors(spark, sf):
    tail = F.when(F.col("file_id") % 3 == 0, F.lit("\ndef (")).otherwise(F.lit("")).cast("binary")
    broken = fx.files(spark, sf).withColumn("content", F.concat("content", tail))
    records = file_records(broken, ScanOptions()).where(F.col("language") == "python")
    return records.select("path", "status", F.size("functions").alias("n_functions"))


def _by_regex(spark, sf, language, extractor, kind):
    read = fx.files(spark, sf).where(language_of(F.col("path")) == language)
    names = extractor(text.decode_utf8(F.col("content")))[kind]
    return read.select("repo_id", "path", F.explode(names).alias("name"))


@query
def x5_js_functions(spark, sf):
    return _by_regex(spark, sf, "javascript", symbols.javascript_symbols, "functions")


@query
def x6_js_classes(spark, sf):
    return _by_regex(spark, sf, "javascript", symbols.javascript_symbols, "classes")


@query
def x7_js_imports(spark, sf):
    return _by_regex(spark, sf, "javascript", symbols.javascript_symbols, "imports")


@query
def x8_typescript(spark, sf):
    index = symbol_index(_records(spark, sf).where(F.col("language") == "typescript"))
    return index.select("path", "language", "kind", "name")


@query
def x9_java_classes(spark, sf):
    return _by_regex(spark, sf, "java", symbols.java_symbols, "classes")


@query
def x10_java_methods(spark, sf):
    return _by_regex(spark, sf, "java", symbols.java_symbols, "functions")


@query
def x11_java_imports(spark, sf):
    return _by_regex(spark, sf, "java", symbols.java_symbols, "imports")


@query
def x12_dispatch(spark, sf):
    sizes = [F.size(kind).alias(f"n_{kind}") for kind in ("functions", "classes", "imports")]
    return _records(spark, sf).select("path", "language", *sizes)


@query
def x13_file_record(spark, sf):
    lists = [_joined(kind).alias(kind) for kind in ("functions", "classes", "imports")]
    marks = [F.coalesce(c, F.lit("")).alias(c) for c in ("error", "skipped")]
    return _records(spark, sf).select("repo_id", "path", "language", *lists, *marks, "bytes")


@query
def x14_status(spark, sf):
    return _records(spark, sf).select("path", "status")


@query
def x15_symbol_index(spark, sf):
    return symbol_index(_records(spark, sf))


@query
def x15_sql_symbols(spark, sf):
    """The symbol index in SQL text alone, by table functions."""
    register(spark)
    return spark.sql(
        """
        SELECT repo_id, path, s.* FROM {files}, LATERAL file_verdict(path, bytes, {most}) v,
          LATERAL code_symbols(path, CAST(content AS STRING)) s WHERE v.skipped IS NULL
        UNION ALL
        SELECT repo_id, path, v.language, s.* FROM {files}, LATERAL file_verdict(path, bytes, {most}) v,
          LATERAL python_symbols(content) s WHERE v.skipped IS NULL AND v.language = 'python'
        """,
        files=fx.files(spark, sf),
        most=fx.MAX_FILE_BYTES,
    )


@query
def m2_sql_head_lines(spark, sf):
    """First lines of every text in SQL text alone."""
    register(spark)
    text = "SELECT doc_id, pos, md5(line) AS digest FROM {docs}, LATERAL head_lines(text, 50)"
    return spark.sql(text, docs=fx.markdown(spark, sf))


# Statistics


@query
def a1_total_considered(spark, sf):
    return stats.total_considered(fx.files(spark, sf))


@query
def a2_scan_counts(spark, sf):
    return stats.repo_stats(_records(spark, sf))


@query
def a3_by_language(spark, sf):
    return stats.by_language(fx.files(spark, sf))


@query
def a4_language_distribution(spark, sf):
    return stats.language_distribution(stats.by_language(fx.files(spark, sf)))


@query
def a5_largest_files(spark, sf):
    return stats.largest_files(fx.files(spark, sf)).drop("kb")


@query
def a6_kb_rounding(spark, sf):
    return fx.files(spark, sf).select("path", numbers.kib(F.col("bytes")).alias("kb"))


@query
def a7_file_counts(spark, sf):
    return stats.file_counts(fx.files(spark, sf))


@query
def a8_language_list(spark, sf):
    return stats.language_list(fx.files(spark, sf))


@query
def a9_import_usage(spark, sf):
    return stats.import_usage(_records(spark, sf))


@query
def a10_added_language(spark, sf):
    """Counts of an added language from paths and from records."""
    added = {**symbols.REGEX_EXTRACTORS, "go": symbols.java_symbols}
    files, languages = fx.files(spark, sf), ["python", *added]
    read = file_records(files, SCAN, added).groupBy("repo_id", "language").agg(F.count("*").alias("n_records"))
    totals = stats.total_considered(files, languages)
    return stats.by_language(files, languages).join(read, ["repo_id", "language"]).join(totals, "repo_id")


@query
def a10_open_languages(spark, sf):
    """Languages of a table of extensions, one of them new and one renamed, read by extractors of their own."""
    table = spark.createDataFrame([("MD", "prose"), (".go", "golang"), ("md", "prose")], "extension string, language string")
    prose = symbols.regex_extractor([r"([0-9]+)"], [r"([A-Z])[a-z]"], [r"([a-z]+)[.]"])
    options = replace(SCAN, extensions=extension_table(table))
    added = {"prose": prose, "golang": prose}
    read = file_records(fx.files(spark, sf), options, added).where(F.col("language").isin(list(added)))
    names = [F.array_join(kind, ",").alias(kind) for kind in ("functions", "classes", "imports")]
    return read.select("repo_id", "path", "language", *names, "status")


@query
def a1_count_totals(spark, sf):
    """Counts by repository, language and status, and all their totals up to the corpus."""
    return stats.count_totals(_records(spark, sf))


@query
def a9_import_edges(spark, sf):
    """Imports that name a file of the same repository."""
    return imports.import_edges(file_records(fx.linked_files(spark, sf)))


@query
def a9_import_levels(spark, sf):
    """Import cycles and levels of all files."""
    records = materialize(file_records(fx.linked_files(spark, sf)), "file-records")
    return imports.import_levels(records, imports.import_edges(records))


def _arriving(spark, sf):
    """Statistics of repositories that arrive in three batches, a third of them twice and at first in part."""
    folder = new_folder(spark, "statistics")
    records = materialize(_records(spark, sf), "file-records")
    turn = F.pmod(F.crc32(F.col("repo_id").cast("binary")), F.lit(3))
    early = records.where(turn == 0).where(F.col("language") == "python")
    batches = [early.unionByName(records.where(turn == 1)), records.where(turn == 2), records.where(turn == 0)]
    for number, batch in enumerate(batches):
        add_statistics(batch, batch.select("repo_id"), folder, number)
    return folder


@query
def a2_maintained_counts(spark, sf):
    return maintained_repo_stats(spark, _arriving(spark, sf))


@query
def a3_maintained_languages(spark, sf):
    return maintained_by_language(spark, _arriving(spark, sf))


@query
def a9_maintained_imports(spark, sf):
    return maintained_import_usage(spark, _arriving(spark, sf))


# Directory listing


@query
def t1_tree(spark, sf):
    return tree.tree_lines(fx.files(spark, sf), 1000)


@query
def t2_tree_cut(spark, sf):
    return tree.tree_lines(fx.files(spark, sf), fx.MAX_ENTRIES)


@query
def t3_tree_empty(spark, sf):
    files = fx.files(spark, sf)
    every = files.select("repo_id").unionByName(files.select(F.concat("repo_id", F.lit("-empty")).alias("repo_id")))
    return tree.tree_lines(files, fx.MAX_ENTRIES, repositories=every)


# Manifests


@query
def m1_readme_pick(spark, sf):
    return manifests.readmes(fx.doc_manifests(spark, sf)).select("repo_id", "path", F.md5("readme").alias("digest"))


@query
def m2_head_lines(spark, sf):
    heads = [text.head_lines(F.col("text"), n) for n in (50, 2)]
    read = fx.markdown(spark, sf).select("doc_id", heads[0].alias("head"), heads[1].alias("short"))
    return read.select("doc_id", F.length("head").alias("n_chars"), F.md5("head").alias("digest"), "short")


def _packages(spark, sf):
    return manifests.packages(fx.doc_manifests(spark, sf))


@query
def m3_package_json(spark, sf):
    sizes = [F.size(c).alias(f"n_{c}") for c in ("dependencies", "dev_dependencies")]
    return _packages(spark, sf).select("repo_id", *sizes)


@query
def m4_package_identity(spark, sf):
    return _packages(spark, sf).select("repo_id", "name", "version", "description")


@query
def m5_node_dependencies(spark, sf):
    return manifests.dependency_rows(_packages(spark, sf), "dependencies", 50)


@query
def m6_dev_dependencies(spark, sf):
    return manifests.dependency_rows(_packages(spark, sf), "dev_dependencies", 30)


@query
def m7_engines(spark, sf):
    return _packages(spark, sf).select("repo_id", "engines")


@query
def m8_requirements(spark, sf):
    return manifests.requirement_rows(manifests.requirements(fx.doc_manifests(spark, sf))).drop("total")


@query
def m9_requirement_cap(spark, sf):
    return manifests.requirement_rows(manifests.requirements(fx.doc_manifests(spark, sf)), 2)


@query
def m10_pom_head(spark, sf):
    return manifests.poms(fx.doc_manifests(spark, sf))


# Summaries, reports, prompts


def _profiles(spark, sf):
    return report.repo_profiles(*_stored_parts(spark, sf))


def _stored_parts(spark, sf):
    """Listing, records and manifests. The last two are read by several parts, so they are written first."""
    files = fx.files(spark, sf, fx.GROUP_FILES)
    listing = files.select("repo_id", "path", "bytes")
    records = materialize(file_records(files, SCAN), "file-records")
    found = manifests.root_manifests(fx.doc_manifests(spark, sf, fx.GROUP_MANIFESTS))
    return listing, records, materialize(found, "manifests")


@query
def r1_text_summary(spark, sf):
    return summaries.text_summaries(_records(spark, sf))


@query
def r2_shown_summaries(spark, sf):
    read = materialize(summaries.text_summaries(_records(spark, sf)), "summaries")
    return summaries.shown_summaries(read)


@query
def r3_bullet_summary(spark, sf):
    return summaries.bullet_summaries(materialize(_records(spark, sf), "file-records"))


@query
def r4_stats_summary(spark, sf):
    return report.stats_summaries(_profiles(spark, sf))


@query
def r5_report_lines(spark, sf):
    return report.report_lines(_profiles(spark, sf), GENERATED_AT)


@query
def r6_key_files(spark, sf):
    options = ReportOptions(report_key_files=3, report_names=1)
    profiles = report.repo_profiles(*_stored_parts(spark, sf), options)
    lines = report.report_lines(profiles, GENERATED_AT, options)
    return lines.where(F.col("section") == 8).select("repo_id", "line_no", "line")


@query
def r7_overview(spark, sf):
    """The overview of every repository, and of as many without a README."""
    listing, records, found = _stored_parts(spark, sf)
    bare = listing.select(F.concat("repo_id", F.lit("-bare")).alias("repo_id"))
    every = listing.select("repo_id").unionByName(bare)
    profiles = report.repo_profiles(listing, records, found, repositories=every)
    lines = report.report_lines(profiles, GENERATED_AT)
    return lines.where(F.col("section") == 1).select("repo_id", "line_no", "line")


@query
def r8_prompt(spark, sf):
    return report.prompts(_profiles(spark, sf), "Describe the repository.")


@query
def r9_prompt_preview(spark, sf):
    return report.prompt_previews(report.prompts(_profiles(spark, sf), "Describe the repository."), 500)


@query
def r10_report_files(spark, sf):
    folder = new_folder(spark, "reports")
    report.write_reports(report.reports(_profiles(spark, sf), GENERATED_AT), folder, as_files=True)
    stored = spark.read.format("binaryFile").load(folder)
    name, content = paths.basename(F.col("path")), text.decode_utf8(F.col("content"))
    return stored.select(
        F.replace(name, F.lit("_ai_documentation.md")).alias("repo_id"),
        name.alias("file_name"),
        F.length(content).alias("n_chars"),
        F.md5(content.cast("binary")).alias("digest"),
    )


# Layout


@query
def l1_sanitize(spark, sf):
    return layout.sanitized(fx.documents(spark, sf).select("doc_id", "text"), "text")


@query
def l2_soft_wrap(spark, sf):
    return layout.wrapped(fx.documents(spark, sf).select("doc_id", "text"), "text")


@query
def l3_line_kinds(spark, sf):
    return layout.layout_lines(fx.markdown(spark, sf), ["doc_id"])


@query
def l4_plain_lines(spark, sf):
    """Title and lines of the plain form; the title, the first line of the text, is line -1."""
    texts = fx.markdown(spark, sf)
    first = F.concat(F.lit("Doc "), "doc_id", F.lit("\u00a0"), F.substring_index("text", "\n", 1))
    titles = texts.select("doc_id", F.lit(-1).alias("pos"), layout.plain_title(first).alias("line"))
    return titles.unionByName(layout.plain_lines(texts, ["doc_id"]))
