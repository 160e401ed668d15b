"""Archives, directory trees, streams and the whole job."""

import io
import json
import os
import random
import struct
import warnings
import zipfile
from datetime import datetime

import pyarrow as pa
import pytest
from conftest import SF_DIR, plan, rows
from pyspark.sql import functions as F

from repoquarry.functions.symbols import REGEX_EXTRACTORS, java_symbols
from repoquarry.options import ScanOptions
from repoquarry.plans import queries
from repoquarry.plans.analysis import SESSION_SETTINGS, analyze, analyze_archives, ingest
from repoquarry.schemas import FILES
from repoquarry.sources import archives as ar
from repoquarry.sources import ranges
from repoquarry.sources.blobs import opened, opened_scheme, qualified, write_blobs
from repoquarry.sources.committed import write_committed
from repoquarry.sources.directories import list_directories, read_contents
from repoquarry.sources.shared import materialize, new_folder
from repoquarry.operators.naming import Names
from repoquarry.operators.stats import import_usage, repo_stats
from repoquarry.streaming import ingest as stream_ingest
from repoquarry.streaming.ingest import archive_stream, ingest_new_archives
from repoquarry.streaming.statistics import (
    add_statistics,
    maintained_by_language,
    maintained_import_usage,
    maintained_repo_stats,
)

LIMITS = ScanOptions(max_upload_bytes=5000, max_extract_bytes=1000)


def zipped(*members):
    out = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        warnings.simplefilter("ignore")
        for name, content in members:
            archive.writestr(name, content)
    return out.getvalue()


GOOD = zipped(
    ("pkg/__init__.py", b"class A: pass\n"),
    (".hidden", b"h"),
    ("empty/", b""),
    ("dup.txt", b"first"),
    ("./dup.txt", b"second"),
    ("a/../b.py", b"import os\n"),
)


def damaged():
    raw = bytearray(zipped(("a.py", b"x = 1\n" * 50)))
    raw[45] ^= 0xFF
    return bytes(raw)


UPLOADS = {
    "good.zip": (GOOD, None),
    "UPPER.ZIP": (zipped(("x.py", b"")), None),
    "notes.tar": (GOOD, "Only .zip files are supported."),
    "climb.zip": (zipped(("ok.py", b""), ("../x.py", b"")), "Invalid path in ZIP file: ../x.py"),
    "sibling.zip": (zipped(("../sibling_x/f", b"")), "Invalid path in ZIP file: ../sibling_x/f"),
    "absolute.zip": (zipped(("/etc/f", b"")), "Invalid path in ZIP file: /etc/f"),
    "inside.zip": (zipped(("a/../../x", b"")), "Invalid path in ZIP file: a/../../x"),
    "junk.zip": (b"not an archive", "Invalid ZIP file: File is not a zip file"),
    "at_limit.zip": (zipped(("a", b"x" * 400), ("b", b"x" * 600)), None),
    "over_limit.zip": (zipped(("a", b"x" * 400), ("b", b"x" * 601)), "Zip too large after extraction: 0.00 MB. Maximum allowed: 0.00 MB."),
    "both.zip": (zipped(("../p", b"x"), ("b", b"x" * 2000)), "Invalid path in ZIP file: ../p"),
    "large.zip": (bytes(6000), "Upload too large: 0.01 MB. Maximum allowed: 0.00 MB."),
    "nothing.zip": (zipped(), None),
}


@pytest.fixture
def uploads(tmp_path):
    for name, (raw, _) in UPLOADS.items():
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


def literal_archives(spark, uploads):
    data = [(name, datetime(2026, 1, 1), len(raw), bytearray(raw)) for name, raw in uploads.items()]
    return spark.createDataFrame(data, "path string, modificationTime timestamp, length bigint, content binary")


def test_verdicts(spark):
    archives = literal_archives(spark, {name: raw for name, (raw, _) in UPLOADS.items()})
    found = dict(rows(ar.with_verdict(archives, LIMITS), "path", "error"))
    assert found == {name: error for name, (_, error) in UPLOADS.items()}
    assert len(rows(ar.rejected_archives(archives, LIMITS))) == sum(error is not None for _, error in UPLOADS.values())


def test_members_keep_order_and_repeats(spark):
    listed = ar.with_members(literal_archives(spark, {"good.zip": GOOD})).select(F.inline("members"))
    assert rows(listed) == [
        (0, "pkg/__init__.py", False, 14),
        (1, ".hidden", False, 1),
        (2, "empty/", True, 0),
        (3, "dup.txt", False, 5),
        (4, "./dup.txt", False, 6),
        (5, "a/../b.py", False, 10),
    ]


def test_extraction_loses_no_hidden_name_and_the_last_repeat_stays(spark):
    entries = ar.extracted(literal_archives(spark, {"in/good.zip": GOOD}))
    found = {r["path"]: bytes(r["content"]) for r in ar.files_of(entries).collect()}
    assert found == {"pkg/__init__.py": b"class A: pass\n", ".hidden": b"h", "dup.txt": b"second", "a/b.py": b"import os\n"}
    assert rows(ar.directories_of(entries)) == [("good", "empty")]
    assert rows(ar.repositories_of(entries)) == [("good",)]


def test_damaged_members_reject_the_whole_archive(spark):
    entries = ar.extracted(literal_archives(spark, {"bad.zip": damaged()}))
    [(repo, path, error)] = rows(entries, "repo_id", "path", "error")
    assert (repo, path) == ("bad", "bad.zip")
    assert error.startswith("Invalid ZIP file: ")


def declaring(*sizes):
    """An archive whose directory declares these sizes for empty members."""
    local, central = b"", b""
    for i, size in enumerate(sizes):
        name, extra = f"f{i}".encode(), struct.pack("<HHQ", 1, 8, size)
        fields = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, 0, 0, 0xFFFFFFFF, len(name), len(extra))
        central += b"PK\x01\x02" + struct.pack("<H", 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(local)) + name + extra
        local += b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, 0, 0, 0, len(name), 0) + name
    end = struct.pack("<HHHHIIH", 0, 0, len(sizes), len(sizes), len(central), len(local), 0)
    return local + central + b"PK\x05\x06" + end


def test_absurd_declared_sizes_reject_only_their_archive(spark):
    uploads = {"huge.zip": declaring(2**64 - 1, 2**63, 2**63), "odd.zip": declaring(10), "good.zip": GOOD}
    entries = ar.extracted(literal_archives(spark, uploads))
    [(repo, error)] = rows(entries.where("error IS NOT NULL"), "repo_id", "error")
    assert repo == "huge"
    assert error.startswith("Zip too large after extraction: 17592186044416.00 MB")
    listed = ar.with_members(literal_archives(spark, uploads)).where("path = 'huge.zip'")
    assert [int(b) for b, in rows(listed.select(F.inline("members")), "bytes")] == [2**63, 2**63, 2**64 - 1]
    assert listed.select(ar.declared_bytes(F.col("members"))).head()[0] == 2**65 - 1
    wide = ar.extracted(literal_archives(spark, {"wide.zip": declaring(2**41)}), ScanOptions(max_extract_bytes=2**40))
    assert "2097152.00 MB. Maximum allowed: 1048576.00 MB." in rows(wide, "error")[0][0]
    assert rows(entries.where("repo_id = 'odd'"), "path", "bytes") == [("", 0), ("f0", 0)]


def test_large_entries_are_sent_in_several_batches(spark, monkeypatch):
    big = zipped(*[(f"f{i}", bytes(3 * 1024 * 1024)) for i in range(12)])
    entries = ar.files_of(ar.extracted(literal_archives(spark, {"big.zip": big})))
    assert entries.agg(F.count("*"), F.sum("bytes")).first()[:] == (12, 36 * 1024 * 1024)


def test_scan_reads_only_zip_names(spark, uploads):
    read = ar.read_archives(spark, uploads)
    assert {r[0].rpartition("/")[2] for r in rows(read, "path")} == UPLOADS.keys() - {"notes.tar"}
    limited = ar.read_archives(spark, uploads, 5000)
    assert "LessThanOrEqual(length,5000)" in limited._jdf.queryExecution().executedPlan().toString()
    listed = ar.list_uploads(spark, uploads)
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    refused = {r[0].rpartition("/")[2] for r in rows(ar.refused_uploads(listed, LIMITS), "path")}
    assert refused == {"notes.tar", "large.zip"}


def test_ingest_names_archives_apart(spark, tmp_path):
    for folder in ("a", "b", "c"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.zip").write_bytes(zipped((f"{folder}.py", b"")))
    (tmp_path / "x.tar").write_bytes(b"?")
    found = rows(ingest(spark, str(tmp_path)).where("path <> ''").select("repo_id", F.coalesce("error", F.lit("")).alias("error")))
    assert found == [("x", ""), ("x", "Only .zip files are supported."), ("x_1", ""), ("x_2", "")]


@pytest.fixture
def trees(tmp_path):
    contents = {
        "r/a.py": b"x",
        "r/_private.py": b"yy",
        "r/.env": b"",
        "r/pkg/__init__.py": b"\xff\x00",
        "r/pkg/deep/er/est/f.js": b"js",
        "s/only.py": b"s",
        "s/a b.py": b"1",
        "s/a%20b.py": b"2",
        "s/é [id]/100%.py": b"3",
        "s/x#1.py": b"4",
        "s/x": b"5",
        "s/q?.py": b"6",
        "s/a:b.gz": b"7",
    }
    for path, raw in contents.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(raw)
    (tmp_path / "r/empty/inner").mkdir(parents=True)
    (tmp_path / "t").mkdir()
    return tmp_path, contents


@pytest.mark.parametrize("most", [1, 2, 1000])
def test_directory_scan_finds_everything(spark, trees, most):
    root, contents = trees
    named = [("r", f"file:{root}/r"), ("s", f"file://{root}/s/"), ("t", f"{root}/t")]
    roots = spark.createDataFrame(named, "repo_id string, root string")
    listed = list_directories(roots, most)
    files = {f"{r['repo_id']}/{r['path']}": bytes(r["content"]) for r in read_contents(listed).collect()}
    assert files == contents
    directories = rows(listed.where("is_dir"), "repo_id", "path")
    expected = ["empty", "empty/inner", "pkg", "pkg/deep", "pkg/deep/er", "pkg/deep/er/est"]
    assert directories == [*(("r", d) for d in expected), ("s", "é [id]")]


def test_archives_under_every_name_can_be_listed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, raw in {"_x.zip": GOOD, ".y.ZIP": GOOD, "in/_x.zip": GOOD, "empty.zip": b"", "b.tar": b"", "big.zip": bytes(9000)}.items():
        (tmp_path / name).write_bytes(raw)
    found = ingest(spark, str(tmp_path), ScanOptions(max_upload_bytes=8000), every_name=True)
    assert rows(found.where("error IS NULL").groupBy("repo_id").count()) == [(".y", 6), ("_x", 6), ("_x_1", 6)]
    refused = found.where("error IS NOT NULL").withColumn("path", F.substring_index("path", "/", -1))
    assert rows(refused, "repo_id", "path", "error") == [
        ("b", "b.tar", "Only .zip files are supported."),
        ("big", "big.zip", "Upload too large: 0.01 MB. Maximum allowed: 0.01 MB."),
        ("empty", "empty.zip", "Invalid ZIP file: File is not a zip file"),
    ]


def test_tables_are_kept_in_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    stored = materialize(spark.range(3).withColumn("x", F.lit("a")), "t")
    assert all(path.startswith(f"file://{named}/t-") for path in stored.inputFiles())
    assert new_folder(spark, "t") != new_folder(spark, "t")
    assert rows(stored) == [(0, "a"), (1, "a"), (2, "a")]


def test_blobs_round_trip(spark, tmp_path):
    data = [("a/_b.bin", bytearray(b"\x00\x01")), (".c", bytearray(b"")), ("100% #1?.py", bytearray(b"x"))]
    folder = tmp_path / "in put%20"
    written = write_blobs(spark.createDataFrame(data, "path string, content binary"), str(folder))
    assert rows(written) == [(".c", 0), ("100% #1?.py", 1), ("a/_b.bin", 2)]
    assert (folder / "a/_b.bin").read_bytes() == b"\x00\x01"
    assert (folder / "100% #1?.py").read_bytes() == b"x"


def test_folders_are_opened_by_scheme(spark):
    assert qualified(spark, "/x y") == "file:///x y"
    assert opened("file:/x%20y")[1] == opened("file:///x%20y")[1] == "/x%20y"
    assert opened_scheme("s3a://bucket/a b/c") == "s3"
    for other in ("wasbs://c@a/x", "dbfs:/x"):
        with pytest.raises(ValueError, match="cannot open"):
            qualified(spark, other)


def test_stream_takes_each_archive_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        stream = ingest_new_archives(archive_stream(spark, str(source)), str(out), str(tmp_path / "checkpoint"))
        stream.awaitTermination(120)
        return rows(spark.read.parquet(f"{out}/entries").where("error IS NULL AND NOT is_dir"), "repo_id", "path")

    (source / "one.zip").write_bytes(zipped(("a.py", b"def f(): pass\n")))
    (source / "skip.tar").write_bytes(b"?")
    assert run() == [("one", "a.py")]
    (source / "two.zip").write_bytes(zipped(("b.js", b"class B {}")))
    (source / "junk.zip").write_bytes(b"junk")
    assert run() == [("one", "a.py"), ("two", "b.js")]
    assert run() == [("one", "a.py"), ("two", "b.js")]
    records = spark.read.parquet(f"{out}/file_records")
    assert rows(records, "repo_id", "functions", "classes") == [("one", ["f"], []), ("two", [], ["B"])]
    assert rows(spark.read.parquet(f"{out}/entries").where("error IS NOT NULL"), "repo_id") == [("junk",), ("skip",)]


def test_committed_files_appear_together_or_not_at_all(spark, tmp_path):
    folder = tmp_path / "out" / "files"
    odd = ["a.md", "_b", ".c", "d e/é#.txt", "100%.md"]
    data = [(p, f"content of {p}".encode(), 7) for p in odd] + [("empty", None, 0)]
    df = spark.createDataFrame(data, "path string, content binary, n int").repartition(3)
    write_committed(df, str(folder))

    def files():
        return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}

    first = files()
    manifest = json.loads(first.pop("_manifest.json"))
    assert first == {p: c or b"" for p, c, _ in data}
    assert manifest["files"] == 6 and manifest["bytes"] == sum(len(c or b"") for _, c, _ in data)
    assert [p.name for p in folder.parent.iterdir()] == ["files"]
    # What is there stays, unless it is to be replaced as a whole.
    other = spark.createDataFrame([("new.md", b"new")], "path string, content binary")
    with pytest.raises(Exception, match="is there already"):
        write_committed(other, str(folder))
    assert len(files()) == 7
    # A job that fails after some files were written shows none of them.
    broken = spark.range(40).select(F.format_string("f%d", "id").alias("path"), F.when(F.col("id") < 39, F.lit(b"x")).otherwise(F.raise_error(F.lit("broken")).cast("binary")).alias("content"))
    for place, overwrite in ((folder, True), (folder.parent / "second", False)):
        with pytest.raises(Exception, match="broken"):
            write_committed(broken.repartition(4), str(place), overwrite)
    assert len(files()) == 7 and [p.name for p in folder.parent.iterdir()] == ["files"]
    write_committed(other, str(folder), overwrite=True)
    assert set(files()) == {"new.md", "_manifest.json"} and [p.name for p in folder.parent.iterdir()] == ["files"]
    write_committed(other.where("false"), str(folder.parent / "none"))
    assert json.loads((folder.parent / "none" / "_manifest.json").read_text())["files"] == 0


class Counting(io.BytesIO):
    """A file that counts what is read of it."""

    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        self.read_bytes += len(data)
        return data


def test_listing_reads_the_end_of_an_archive():
    raw = zipped(*((f"f{i}.bin", os.urandom(200_000)) for i in range(50)))
    file = Counting(raw)
    members = ranges.members_of(file, 1_000_000)
    assert len(raw) > 10_000_000 and file.read_bytes < 100_000
    assert [m["part"] for m in members] == [i // 5 for i in range(50)]
    assert {m["target"] for m in members} == {f"f{i}.bin" for i in range(50)} and all(m["kept"] for m in members)


@pytest.mark.parametrize("range_bytes", [1, 40, 10**9])
def test_ranges_give_what_whole_archives_give(spark, tmp_path, range_bytes):
    many = bytearray(zipped(*((f"d/f{i}.txt", os.urandom(60)) for i in range(40)), ("d/f3.txt", b"last"), ("d/f4.txt/", b"")))
    late = bytearray(zipped(*((f"f{i}.txt", os.urandom(60)) for i in range(40))))
    # One damaged byte in the contents of the 30th member, and one in a member that a later one replaces.
    late[late.index(b"f30.txt") + 20] ^= 0xFF
    replaced = bytearray(many)
    replaced[replaced.index(b"d/f3.txt") + 20] ^= 0xFF
    more = {"many.zip": bytes(many), "late.zip": bytes(late), "replaced.zip": bytes(replaced), "empty.zip": zipped()}
    for name, raw in [*((n, r) for n, (r, _) in UPLOADS.items()), *more.items()]:
        (tmp_path / name).write_bytes(raw)
    options = ScanOptions(max_upload_bytes=10**6, max_extract_bytes=10**5)
    uploads = ar.list_uploads(spark, str(tmp_path)).withColumn("repo_id", F.regexp_extract("path", "([^/]*)$", 1))
    uploads = uploads.withColumn("members", F.lit(1)).withColumn("part", F.lit("x"))
    found = ranges.entries_by_range(uploads, options, range_bytes)
    expected = ar.extracted(ar.read_archives(spark, str(tmp_path)), options, F.regexp_extract("path", "([^/]*)$", 1))
    refused = expected.where("error IS NOT NULL")
    assert {"late.zip", "replaced.zip"} <= {r[0] for r in rows(refused, "repo_id")}
    tar = found.where("repo_id LIKE '%.tar'")
    assert {r.error for r in tar.collect()} == {"Only .zip files are supported."}
    digest = F.coalesce(F.md5("content"), F.lit("")).alias("digest")
    columns = ["repo_id", "path", "is_dir", F.coalesce("bytes", F.lit(-1)).alias("bytes"), digest, F.coalesce("error", F.lit("")).alias("error")]
    assert rows(found.where("repo_id NOT LIKE '%.tar'"), *columns) == rows(expected, *columns)
    assert ranges.entries_by_range(uploads.where("false"), options).count() == 0


def test_large_archives_are_the_work_of_many_tasks(spark, tmp_path):
    (tmp_path / "large.zip").write_bytes(zipped(*((f"f{i}.bin", os.urandom(50_000)) for i in range(64))))
    (tmp_path / "small.zip").write_bytes(zipped(("a.py", b"x = 1\n")))
    named = ar.list_uploads(spark, str(tmp_path)).withColumn("unique_name", F.regexp_extract("path", "([^/]*)[.]zip$", 1))
    entries = ranges.opened_entries(named, range_bytes=100_000)
    files = ar.files_of(entries)
    assert {r[0]: r[1] for r in rows(files.groupBy("repo_id").count())} == {"large": 64, "small": 1}
    assert files.where("repo_id = 'large'").select(F.spark_partition_id()).distinct().count() > 1


def test_names_are_state_of_the_stream(spark, tmp_path):
    """Many small batches, run in turns: names as in one whole ingest, and one row a batch of names written."""
    source = tmp_path / "in"
    asked = ["x", "x_1", "x", "y", "x", "x_1", "x_2", "y", "x_1_1", "x", "y_2", "y", "y"]
    for k, name in enumerate(asked):
        (source / str(k)).mkdir(parents=True)
        (source / str(k) / f"{name}.zip").write_bytes(zipped((f"f{k}.py", b"")))
        os.utime(source / str(k) / f"{name}.zip", (1_700_000_000 + k, 1_700_000_000 + k))
    for _ in range(2):
        stream = archive_stream(spark, str(source), max_archives_per_batch=2)
        ingest_new_archives(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    found = spark.read.parquet(f"{tmp_path}/out/entries").where("NOT is_dir")
    assert rows(found, "repo_id", "path") == rows(ingest(spark, str(source)).where("NOT is_dir"), "repo_id", "path")
    names = spark.read.parquet(f"{tmp_path}/out/names")
    assert names.count() == len(asked) and names.select("unique_name").distinct().count() == len(asked)
    assert names.groupBy("batch").count().where("count > 2").count() == 0


def test_stream_equals_a_whole_ingest(spark, tmp_path):
    source = tmp_path / "in"
    for folder in ("a", "b", "c"):
        (source / folder).mkdir(parents=True)
    options = ScanOptions(max_upload_bytes=2000, max_files=2)

    def run():
        stream = archive_stream(spark, str(source), max_archives_per_batch=2)
        ingest_new_archives(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), options).awaitTermination(120)

    at = 1_700_000_000

    def put(name, raw):
        nonlocal at
        (source / name).write_bytes(raw)
        at += 10
        os.utime(source / name, (at, at))

    put("a/main.zip", zipped(("m.py", b"def a(): pass\n"), ("n.py", b""), ("o.py", b"")))
    put("b/x.tar", b"?")
    put("b/main.zip", zipped(("m.py", b"def b(): pass\n")))
    run()
    put("c/main_1.zip", zipped())
    put("c/main.zip", zipped(("m.py", b"def c(): pass\n")))
    put("a/big.zip", bytes(3000))
    run()
    kept = ["repo_id", "path", "is_dir", "bytes", "error"]
    streamed = spark.read.parquet(f"{tmp_path}/out/entries").fillna(False, ["is_dir"])
    whole = ingest(spark, str(source), options).fillna(False, ["is_dir"])
    assert sorted(map(str, rows_unsorted(streamed, kept))) == sorted(map(str, rows_unsorted(whole, kept)))
    assert {r[0] for r in rows(whole.where("error IS NULL"), "repo_id")} == {"main", "main_1", "main_1_1", "main_2"}
    records = spark.read.parquet(f"{tmp_path}/out/file_records")
    assert rows(records, "repo_id", "path") == [("main", "m.py"), ("main", "n.py"), ("main_1", "m.py"), ("main_2", "m.py")]
    # Statistics kept batch by batch are those of all records, the empty repository included.
    kept_there = f"{tmp_path}/out/statistics"
    named = spark.createDataFrame([(r,) for r in ("main", "main_1", "main_1_1", "main_2")], "repo_id string")
    assert rows(maintained_repo_stats(spark, kept_there)) == rows(repo_stats(records, named))
    assert rows(maintained_by_language(spark, kept_there)) == [("main", "python", 2), ("main_1", "python", 1), ("main_2", "python", 1)]


def test_statistics_of_repositories_that_come_again(spark, tmp_path):
    schema = "repo_id string, path string, language string, status string, imports array<string>"
    folder = str(tmp_path / "statistics")
    batches = [
        [("a", "x.py", "python", "scanned", ["os", "os", "sys"]), ("b", "y.js", "javascript", "error", None)],
        [("c", "z.py", "python", "skipped", [])],
        [("a", "w.ts", "typescript", "scanned", ["fs"]), ("a", "v.ts", "typescript", "scanned", ["fs"])],
    ]
    for number, found in enumerate(batches):
        records = spark.createDataFrame(found, schema)
        names = records.select("repo_id").unionByName(spark.createDataFrame([("empty",), (None,)], "repo_id string"))
        add_statistics(records, names, folder, number)
        add_statistics(records, names, folder, number)
    every = spark.createDataFrame(batches[2] + batches[1] + batches[0][1:], schema)
    named = spark.createDataFrame([(r,) for r in ("a", "b", "c", "empty")], "repo_id string")
    assert rows(maintained_repo_stats(spark, folder)) == rows(repo_stats(every, named))
    assert rows(maintained_import_usage(spark, folder)) == rows(import_usage(every))
    # A repository that comes again without any file has none.
    add_statistics(every.where("false"), named.where("repo_id = 'a'"), folder, 3)
    assert rows(maintained_repo_stats(spark, folder).where("repo_id = 'a'")) == [("a", 0, 0, 0, 0)]
    assert maintained_import_usage(spark, folder).count() == 0


def rows_unsorted(df, columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_every_accepted_archive_has_a_result(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "nothing.zip").write_bytes(zipped())
    (source / "folders.zip").write_bytes(zipped(("d/", b""), ("d/e/", b""), (".git/hooks/", b"")))
    (source / "large.zip").write_bytes(zipped(("d/", b""), ("f.py", b"x" * 900)))
    (source / "git.zip").write_bytes(zipped((".git/config", b"c"), ("a.py", b"x = 1\n")))
    for drop_git in (False, True):
        options = ScanOptions(drop_git=drop_git)
        tables = analyze_archives(spark, str(source), str(tmp_path / f"out{drop_git}"), datetime(2026, 1, 2), options)
        lines = {}
        for repo, _, line in rows(tables["tree"], "repo_id", "pos", "line"):
            lines.setdefault(repo, []).append(line)
        assert lines["nothing"] == ["(empty or invalid repository)"]
        assert ("- .git/" in lines["folders"], "- .git/" in lines["git"]) == (not drop_git, not drop_git)
        stats = {r[0]: r[1:] for r in rows(tables["repo_stats"])}
        assert stats["nothing"] == stats["folders"] == (0, 0, 0, 0) and stats["git"][0] == 1
        assert {r[0] for r in rows(tables["reports"], "repo_id")} == {"nothing", "folders", "large", "git"}
    files = spark.createDataFrame([("r", "f.py", 900, bytearray(b"x")), ("s", "g.py", 1, bytearray(b"x"))], FILES)
    directories = spark.createDataFrame([("r", "d"), ("s", "e")], "repo_id string, path string")
    tables = analyze(files, str(tmp_path / "t"), datetime(2026, 1, 2), ScanOptions(max_extract_bytes=500), directories=directories)
    for name in ("tree", "listing", "repo_stats", "reports", "by_language"):
        assert {r[0] for r in rows(tables[name], "repo_id")} == {"s"}


def test_added_languages_reach_every_table(spark, tmp_path):
    files = spark.createDataFrame([("r", "a.go", 20, bytearray(b"import x.y\nclass A {}")), ("r", "b.py", 1, bytearray(b""))], FILES)
    added = {**REGEX_EXTRACTORS, "go": java_symbols}
    tables = analyze(files, str(tmp_path / "t"), datetime(2026, 1, 2), extractors=added)
    assert rows(tables["by_language"]) == [("r", "go", 1), ("r", "python", 1)]
    assert rows(tables["repo_stats"], "total_considered") == [(2,)]
    assert "**Languages:** go, python" in rows(tables["reports"], "report")[0][0]


EXPECTED_REPORT = """# Project Documentation

*Generated on 2026-01-02 03:04:05*

## Project Overview

# Demo
It works.

## Project Statistics
- **Total Files Analyzed:** 3
- **Successfully Scanned:** 1
- **Skipped:** 1
- **Errors:** 1

### Language Distribution
- **javascript:** 1 files
- **python:** 2 files

### Largest Files
- `web/app.js` (0.3 KB)
- `src/main.py` (0.0 KB)
- `src/bad.py` (0.0 KB)

## Technology Stack
**Languages:** javascript, python

### Node.js Dependencies
left-pad

### Python Dependencies
- numpy==1.0

## Key Files and Structure

### `src/main.py`
- **Language:** python
- **Classes:** Main
- **Functions:** go

## Setup Instructions

*Setup instructions would be extracted from README or inferred from project structure.*

---
*This report was automatically generated.*"""

EXPECTED_PROMPT = """Explain.

---
## Repository Statistics:
total_considered: 3
scanned: 1
skipped: 1
by_language: javascript:1, python:2
largest_files:
  - web/app.js (0.3 KB)
  - src/main.py (0.0 KB)
  - src/bad.py (0.0 KB)

---
## Code Structure Analysis:
- src/bad.py [python] (error)
- src/main.py [python] 
  - functions: go
  - classes: Main
  - imports: os
- web/app.js [javascript] (skipped)

---
## Existing README Content (Full):
# Demo
It works.

---
## Package.json Information (Full Details):
Name: demo
Version: N/A
Description: N/A

Dependencies with versions (1 total):
  - left-pad: ^1

Required Engine Versions: {"node":"18"}

---
## Python Dependencies (Full List with Versions):
Total dependencies: 1
numpy==1.0

---
## Maven Configuration (pom.xml - Full Content):
<project/>

---
## Generate the documentation report now."""


def test_whole_job(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "demo.zip").write_bytes(
        zipped(
            ("README.md", b"# Demo\r\nIt works.\n"),
            ("package.json", b'{"name": "demo", "dependencies": {"left-pad": "^1"}, "engines": {"node": "18"}}'),
            ("requirements.txt", b"numpy==1.0\n"),
            ("pom.xml", b"<project/>"),
            ("src/main.py", b"import os\nclass Main:\n  def go(self): pass\n"),
            ("src/bad.py", b"def f(:"),
            ("web/app.js", b"x" * 300),
            ("web/empty/", b""),
        )
    )
    (source / "bare.zip").write_bytes(zipped(("notes.txt", b"n")))
    (source / "broken.zip").write_bytes(b"?")
    options = ScanOptions(max_file_bytes=200)
    tables = analyze_archives(spark, str(source), str(tmp_path / "out"), datetime(2026, 1, 2, 3, 4, 5), options)
    reports = dict(rows(tables["reports"], "repo_id", "report"))
    assert reports.keys() == {"demo", "bare"}
    assert reports["demo"] == EXPECTED_REPORT
    assert "*No README found." in reports["bare"]
    assert "### Largest Files" not in reports["bare"]
    assert rows(tables["reports"], "file_name") == [("bare_ai_documentation.md",), ("demo_ai_documentation.md",)]
    assert rows(tables["refused_archives"], "repo_id", "error") == [("broken", "Invalid ZIP file: File is not a zip file")]
    assert [r[0] for r in rows(tables["tree"].where("repo_id = 'demo'").orderBy("pos"), "line")][-1] == "requirements.txt"
    assert rows(tables["import_usage"]) == [("os", 1, 1)]
    prompt = dict(rows(tables["prompts"], "repo_id", "prompt"))
    assert "(no files parsed)" in prompt["bare"]

    from repoquarry.operators.report import prompt_previews, prompts, write_reports

    assert dict(rows(prompts(tables["profiles"], "Explain."))) ["demo"] == EXPECTED_PROMPT
    assert dict(rows(prompt_previews(prompts(tables["profiles"], "Explain."), 10)))["demo"] == "Explain.\n\n..."
    write_reports(tables["reports"], str(tmp_path / "texts"), as_files=True)
    assert (tmp_path / "texts" / "demo_ai_documentation.md").read_text() == EXPECTED_REPORT


def test_scan_cap_limits_the_whole_job(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "r.zip").write_bytes(zipped(*[(f"d/f{i}.py", b"") for i in range(9)]))
    options = ScanOptions(max_files=4)
    tables = analyze_archives(spark, str(source), str(tmp_path / "out"), datetime(2026, 1, 2), options)
    assert rows(tables["repo_stats"], "total_considered") == [(3,)]
    assert rows(tables["by_language"], "n_files") == [(3,)]
    assert tables["listing"].count() == 9


def test_options_from_environment(monkeypatch):
    monkeypatch.setenv("MAX_FILE_BYTES", "10")
    options = ScanOptions.from_env(max_files=7)
    assert (options.max_file_bytes, options.max_files, options.max_upload_bytes) == (10, 7, 100 * 1024 * 1024)
    assert SESSION_SETTINGS["spark.sql.adaptive.enabled"] == "true"


def test_a_batch_of_the_stream_is_listed_by_few_tasks(spark, tmp_path):
    """Spark looks up the files of a batch again, by default in a task each."""
    for k in range(80):
        (tmp_path / "in" / str(k)).mkdir(parents=True)
        (tmp_path / "in" / str(k) / f"x{k % 3}.zip").write_bytes(zipped((f"f{k}.py", b"")))
        (tmp_path / "in" / str(k) / "y.tar").write_bytes(b"?")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    uploads = archive_stream(spark, str(tmp_path / "in"))
    assert uploads.sparkSession.conf.get("spark.sql.shuffle.partitions") == partitions
    stream = ingest_new_archives(uploads, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    stream.awaitTermination(120)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(stream.runId))]
    stages = [tracker.getStageInfo(s) for job in jobs if job for s in job.stageIds]
    assert jobs and max(s.numTasks for s in stages if s) <= 16
    found = spark.read.parquet(f"{tmp_path}/out/entries")
    assert rows(found.where("NOT is_dir"), "repo_id", "path") == rows(ingest(spark, str(tmp_path / "in")).where("NOT is_dir"), "repo_id", "path")
    assert found.where("error IS NOT NULL").count() == 80


def test_listing_in_tasks_shows_what_spark_shows(spark, tmp_path):
    names = ["a.zip", "b c%20#.ZIP", "é.zip", "_hidden.zip", ".hidden.zip", "_k=v.zip", "x._COPYING_", "_metadata", "_metadata.zip", "n.tar"]
    folders = ["", "d", "_d", ".d", "_k=v", "_metadata", "_common_metadata2", "e._COPYING_", "d/_in", "d/deep", "_temporary/0"]
    for folder in folders:
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
    for folder in folders:
        for k, name in enumerate(names):
            if not (tmp_path / folder / name).is_dir():
                (tmp_path / folder / name).write_bytes(b"x" * (k + 1))
                os.utime(tmp_path / folder / name, ns=(0, 1_700_000_000_123_456_789 + k))
        (tmp_path / folder / "empty.zip").write_bytes(b"")
    roots = spark.createDataFrame([("uploads", str(tmp_path))], "repo_id string, root string")
    shown = ar.shown_uploads(list_directories(roots, 2))
    expected = rows(ar.list_uploads(spark, str(tmp_path)))
    assert rows(shown) == expected and len(expected) > 20


def test_ingest_lists_its_folder_once_and_in_tasks(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped(("f.py", b"")))
    (tmp_path / "b.tar").write_bytes(b"?")
    entries = ingest(spark, str(tmp_path))
    assert "binaryFile" not in plan(entries) and "BinaryFile" not in plan(entries)
    assert rows(entries, "repo_id", "is_dir")[:2] == [("a", False), ("a", True)]
    refused = rows(entries.where("error IS NOT NULL"), "path")
    assert refused == [(f"file:{tmp_path}/b.tar",)]


class FewRows:
    """An Arrow batch of which more than a hundred rows must not become Python objects at once."""

    def __init__(self, batch):
        self.batch, self.num_rows = batch, batch.num_rows

    def slice(self, start, length):
        return FewRows(self.batch.slice(start, length))

    def to_pylist(self):
        assert self.num_rows <= 100
        return self.batch.to_pylist()


def test_ranges_are_read_few_rows_at_a_time(tmp_path):
    (tmp_path / "x.zip").write_bytes(zipped(("a.py", b"x"), ("b.py", b"yy")))
    row = {"repo_id": "x", "path": "p", "system": "file://", "place": str(tmp_path / "x.zip")}
    members = [{"ordinal": k, "target": t, "kept": True} for k, t in enumerate(("a.py", "b.py"))]
    batch = FewRows(pa.RecordBatch.from_pylist([{**row, "part": k, "members": members} for k in range(333)]))
    found = [r for b in ranges._read_range(iter([batch])) for r in b.to_pylist()]
    assert [(r["path"], r["content"]) for r in found] == 333 * [("a.py", b"x"), ("b.py", b"yy")]


def test_members_are_listed_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    (tmp_path / "x.zip").write_bytes(zipped(("a.py", b"x"), ("b.py", b"yy")))
    row = {"repo_id": "x", "path": "p", "length": 9, "system": "file://", "place": str(tmp_path / "x.zip")}
    batch = FewRows(pa.RecordBatch.from_pylist([{**row, "refused": "no" if k % 3 == 0 else None} for k in range(333)]))

    class Spread:
        def mapInArrow(self, function, schema):
            return function

    monkeypatch.setattr(ranges, "spread", lambda rows, tasks: Spread())
    run = ranges.list_members(spark.createDataFrame([("x", "p", 9)], "repo_id string, path string, length bigint"))
    found = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert [(len(r["members"] or []), r["error"]) for r in found] == 111 * [(0, "no"), (2, None), (2, None)]


def test_batches_are_opened_together_and_once(spark, tmp_path, monkeypatch):
    """Jobs that open uploads are those of many batches, and a failure between names and contents loses nothing."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k in range(7):
        (source / f"r{k}.zip").write_bytes(zipped((f"f{k}.py", b"import os\n")))

    def run():
        stream = archive_stream(spark, str(source), max_archives_per_batch=2)
        ingest_new_archives(stream, str(out), str(tmp_path / "checkpoint")).awaitTermination(120)

    def failing(*_):
        raise RuntimeError("no store")

    with monkeypatch.context() as patched:
        patched.setattr(stream_ingest, "opened_entries", failing)
        with pytest.raises(Exception, match="no store"):
            run()
    assert not (out / "entries").exists() and len(list((out / "names").glob("batch=*"))) == 4
    # An attempt that had opened two of the batches, and has not said so.
    for table in ("entries", "file_records", "statistics/files"):
        spark.createDataFrame([("stale",)], "repo_id string").write.parquet(f"{out}/{table}/batch=1")
    run()
    every = [f"r{k}" for k in range(7)]
    for table in ("entries", "file_records", "statistics/repositories"):
        assert [p.name for p in (out / table).glob("batch=*")] == ["batch=3"]
    (source / "r7.zip").write_bytes(zipped(("f7.py", b"")))
    run()
    run()
    entries = spark.read.parquet(f"{out}/entries")
    assert rows(entries.where("NOT is_dir"), "repo_id", "path", "batch") == [(f"r{k}", f"f{k}.py", 3 if k < 7 else 4) for k in range(8)]
    assert rows(maintained_repo_stats(spark, f"{out}/statistics"), "repo_id") == [(r,) for r in [*every, "r7"]]
    assert rows(maintained_import_usage(spark, f"{out}/statistics")) == [("os", 7, 7)]


def test_names_of_a_batch_read_their_own_state_only():
    class Stored(dict):
        def getValue(self, key):
            asked.add(key[0])
            return self.get(key[0])

        def updateValue(self, key, value):
            self[key[0]] = value

    chosen = random.Random(7)
    stored, whole = Stored(), Names()
    for _ in range(300):
        asked = set()
        following = stream_ingest._Following(stored)
        names = Names(following)
        for _ in range(chosen.randrange(1, 4)):
            name = "".join(["x", *chosen.choices(["_1", "_2", ""], k=3)])
            assert names.take(name) == whole.take(name)
        following.store()
        assert asked == set(following) and all(type(v) is tuple for v in stored.values())
    assert {name: k for name, (k,) in stored.items()} == whole.following


def test_a_stream_has_no_more_tasks_than_run_at_a_time(spark, tmp_path):
    many = spark.newSession()
    many.conf.set("spark.sql.shuffle.partitions", 500)
    session = archive_stream(many, str(tmp_path)).sparkSession
    assert int(session.conf.get("spark.sql.shuffle.partitions")) == spark.sparkContext.defaultParallelism
    assert many.conf.get("spark.sql.shuffle.partitions") == "500"


def test_uploads_are_listed_and_read_as_spark_does_but_in_tasks(spark, tmp_path):
    names = ["a.zip", "b c%20#.ZIP", "é.ziP", "_hidden.zip", ".hidden.zip", "x.zip.tar", "[n]?.zip", ".zip", "empty.zip"]
    for folder in ("", "d", "d/deep", "_d", ".d", "d/zip.zip"):
        (tmp_path / folder).mkdir(exist_ok=True)
        for k, name in enumerate(names):
            (tmp_path / folder / name).write_bytes(b"x" * (k + 1) if name != "empty.zip" else b"")
            os.utime(tmp_path / folder / name, ns=(0, 1_700_000_000_123_456_789 + k * 10**6))
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    columns = ["path", "modificationTime", "length"]
    listed, read = ar.list_uploads(spark, str(tmp_path)), ar.read_archives(spark, str(tmp_path), 7)
    assert rows(listed) == rows(source.load(str(tmp_path)), *columns) and listed.count() == 20
    expected = source.option("pathGlobFilter", "*.[zZ][iI][pP]").load(str(tmp_path)).where("length <= 7")
    assert rows(read) == rows(expected, *columns, "content") and read.count() == 16
    assert read.schema == expected.schema
    # Spark's source would keep an entry for every file on the driver.
    for df in (listed, read):
        assert "binaryFile" not in plan(df) and "BinaryFile" not in plan(df)


@pytest.mark.parametrize("name, listings", [("s1_archive_scan", 2), ("s7_files_by_range", 1), ("s3_members_by_range", 1)])
def test_uploads_of_a_query_are_listed_by_many_tasks(spark, monkeypatch, name, listings):
    seen = []
    monkeypatch.setattr(queries.ar, "list_folder", lambda s, folder, real=ar.list_folder: seen.append(real(s, folder)) or seen[-1])
    found = queries.QUERIES[name](spark, SF_DIR)
    assert "binaryFile" not in plan(found) and "BinaryFile" not in plan(found) and len(seen) == listings
    for listed in seen:
        files = listed.where("NOT is_dir")
        largest = files.groupBy(F.regexp_replace("path", "/[^/]*$", "")).count().agg(F.max("count")).head()[0]
        assert largest < files.count() / 10
