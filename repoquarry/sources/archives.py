"""ZIP archives of repositories: scan, guards, extraction.

The whole chain works on one archive per row and needs no shuffle: members are listed by an Arrow
job, the guards are native expressions over that list, and accepted archives go on to extraction in
the same task. An archive is read once, and its size is limited before it is opened.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.functions.numbers import mib_text
from repoquarry.functions.paths import basename, stem
from repoquarry.options import ScanOptions
from repoquarry.schemas import EXTRACTED, MEMBER_LISTING
from repoquarry.sources.directories import list_directories, place_of, read_contents, system_of
from repoquarry.sources.shared import materialize

# Reasons for rejecting an archive.
NOT_ZIP = "Only .zip files are supported."
UPLOAD_TOO_LARGE = "Upload too large: %s MB. Maximum allowed: %s MB."
INVALID_PATH = "Invalid path in ZIP file: %s"
EXTRACT_TOO_LARGE = "Zip too large after extraction: %s MB. Maximum allowed: %s MB."
INVALID_ZIP = "Invalid ZIP file: %s"

# Folders of uploads may hold any number of files, so a task takes few of them.
DIRECTORIES_PER_TASK = 16

_BATCH_BYTES = 16 * 1024 * 1024


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Entries below a folder, as ``sources.directories`` lists them: in tasks, so the driver holds no names."""
    roots = spark.createDataFrame([("uploads", folder)], "repo_id string, root string")
    return list_directories(roots, DIRECTORIES_PER_TASK)


def list_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """All files below ``folder`` as (path, modificationTime, length); nothing is opened.

    The folder is a path, not a pattern. What Spark's file sources leave out is left out, empty files and
    names that start with ``_`` or ``.``; ``sources.directories`` lists those too.
    """
    return shown_uploads(list_folder(spark, folder))


def read_archives(spark: SparkSession, folder: str, max_upload_bytes: int | None = None) -> DataFrame:
    """ZIP files among ``list_uploads`` as (path, modificationTime, length, content), opened in tasks.

    Names are tested on the listing, which is stored, and the size limit is pushed into its scan, so other
    files are never read.
    """
    found = list_uploads(spark, folder).where(F.endswith(F.lower(basename(F.col("path"))), F.lit(".zip")))
    found = materialize(found, "archives")
    if max_upload_bytes is not None:
        found = found.where(F.col("length") <= max_upload_bytes)
    # Contents are read by rows of (repo_id, path, length); the time passes through them as the first.
    micros = F.unix_micros("modificationTime").cast("string").alias("repo_id")
    modified = F.timestamp_micros(F.col("repo_id").cast("bigint")).alias("modificationTime")
    return read_uploads(found.select(micros, "path", "length")).select("path", modified, "length", "content")


def listed_uploads(listed: DataFrame) -> DataFrame:
    """``list_uploads`` of entries that ``sources.directories`` has listed."""
    files = listed.where(~F.col("is_dir"))
    path = F.concat("system", "place").alias("path")
    return files.select(path, F.col("modified").alias("modificationTime"), F.col("bytes").alias("length"))


# Directories and files whose names Spark's file sources pass over.
_HIDDEN_DIRECTORY = r"(?s)^(?!_common_metadata|_metadata)(\.|_(?!.*=)|.*\._COPYING_\z)"
_HIDDEN_FILE = r"(?s)^(\.|_(?!.*=)|.*\._COPYING_\z)"


def shown_uploads(listed: DataFrame) -> DataFrame:
    """(path, modificationTime, length) of entries that ``sources.directories`` has listed in tasks.

    Files that Spark's file sources leave out, empty or by their names, are left out; paths and
    times, whole milliseconds, are written as those write them.
    """
    above, name = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), basename(F.col("path"))
    hidden = F.exists(above, lambda part: part.rlike(_HIDDEN_DIRECTORY)) | name.rlike(_HIDDEN_FILE)
    files = listed.where(~F.col("is_dir") & (F.col("bytes") > 0) & ~hidden)
    system = F.regexp_replace("system", "^file://$", "file:")
    modified = F.timestamp_millis(F.unix_millis("modified"))
    return files.select(F.concat(system, "place").alias("path"), modified.alias("modificationTime"), F.col("bytes").alias("length"))


def read_uploads(named: DataFrame) -> DataFrame:
    """Archives of ``named`` uploads (repo_id, path, length), opened in tasks: (repo_id, path, length, content).

    Names and verdicts are settled on the listing before; contents go straight from the file system to
    the task that extracts them.
    """
    place = [system_of(F.col("path")).alias("system"), place_of(F.col("path")).alias("place")]
    files = named.select("repo_id", "path", *place, F.lit(False).alias("is_dir"), F.col("length").alias("bytes"))
    return read_contents(files).select("repo_id", "path", F.col("bytes").alias("length"), "content")


def accepted_uploads(uploads: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Uploads that name and size allow, with the repository ``name`` each asks for."""
    refused = upload_rejection(F.col("path"), F.col("length"), options)
    return uploads.where(refused.isNull()).withColumn("name", stem(F.col("path")))


def opened_entries(named: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Entries of accepted uploads (unique_name, path, length)."""
    archives = read_uploads(named.withColumn("repo_id", F.col("unique_name")))
    return extracted(archives, options, F.col("repo_id"))


def refused_entries(uploads: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """One row (repo_id, path, error) per upload refused by name or size."""
    return refused_uploads(uploads, options).select(stem(F.col("path")).alias("repo_id"), "path", "error")


def refused_uploads(uploads: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """(path, error) of uploads refused by name or size alone."""
    refused = uploads.withColumn("error", upload_rejection(F.col("path"), F.col("length"), options))
    return refused.where(F.col("error").isNotNull()).select("path", "error")


def upload_rejection(path: Column, length: Column, options: ScanOptions = ScanOptions()) -> Column:
    """Why an upload is refused by its name or size; null if it is not."""
    limit = F.lit(options.max_upload_bytes)
    return F.when(~F.endswith(F.lower(basename(path)), F.lit(".zip")), NOT_ZIP).when(
        length > limit, F.format_string(UPLOAD_TOO_LARGE, mib_text(length), mib_text(limit))
    )


# Not deterministic to Spark, so that a filter on the verdict does not list the members twice.
@F.pandas_udf(MEMBER_LISTING)
def _list_members(content: pd.Series) -> pd.DataFrame:
    def one(raw):
        if raw is None:
            return None, None
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                infos = archive.infolist()
        except Exception as problem:  # a broken archive is a value, not a failed job
            return None, INVALID_ZIP % problem
        return [
            {"ordinal": i, "path": m.filename, "is_dir": m.is_dir(), "bytes": Decimal(m.file_size)}
            for i, m in enumerate(infos)
        ], None

    return pd.DataFrame([one(raw) for raw in content], columns=["members", "error"])


def with_members(archives: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Adds ``members`` (headers only, in archive order) and ``error``.

    Uploads refused by name or size are not opened.
    """
    refused = upload_rejection(F.col("path"), F.col("length"), options)
    checked = archives.withColumn("refused", refused)
    opened = F.when(F.col("refused").isNull(), F.col("content"))
    listed = checked.withColumn("listing", _list_members.asNondeterministic()(opened))
    return listed.withColumns(
        {"members": F.col("listing.members"), "error": F.coalesce("refused", "listing.error")}
    ).drop("refused", "listing")


_SUM = "decimal(38,0)"


def _no_bytes() -> Column:
    return F.lit(0).cast(_SUM)


def leaves_target(path: Column) -> Column:
    """Whether a member name is absolute or climbs above the folder it is extracted to."""
    climb = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("outside")),
        lambda at, part: F.struct(
            (at["depth"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("depth"),
            (at["outside"] | ((part == "..") & (at["depth"] <= 0))).alias("outside"),
        ),
    )
    return F.startswith(path, F.lit("/")) | climb["outside"]


def has_unsafe_path(members: Column) -> Column:
    return F.exists(members, lambda m: leaves_target(m["path"]))


def declared_bytes(members: Column) -> Column:
    """Sum of the declared sizes; a header may declare up to 2**64 bytes."""
    return F.aggregate(members, _no_bytes(), lambda total, m: (total + m["bytes"]).cast(_SUM))


def members_rejection(members: Column, options: ScanOptions = ScanOptions()) -> Column:
    """Why an archive is refused by its members, the first offending member deciding; null if it is not."""
    limit = F.lit(options.max_extract_bytes).cast(_SUM)

    def step(state: Column, m: Column) -> Column:
        total = (state["total"] + m["bytes"]).cast(_SUM)
        reason = F.when(leaves_target(m["path"]), F.format_string(INVALID_PATH, m["path"])).when(
            total > limit, F.format_string(EXTRACT_TOO_LARGE, mib_text(total), mib_text(limit))
        )
        return F.struct(total.alias("total"), F.coalesce(state["reason"], reason).alias("reason"))

    start = F.struct(_no_bytes().alias("total"), F.lit(None).cast("string").alias("reason"))
    return F.aggregate(members, start, step)["reason"]


def with_verdict(archives: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Adds ``members`` and ``error``, which is null for accepted archives."""
    listed = with_members(archives, options)
    return listed.withColumn("error", F.coalesce("error", members_rejection(F.col("members"), options)))


def rejected_archives(archives: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """(path, error) of refused archives, without their contents."""
    return with_verdict(archives, options).where(F.col("error").isNotNull()).select("path", "error")


def extracted(archives: DataFrame, options: ScanOptions = ScanOptions(), repo_id: Column | None = None) -> DataFrame:
    """Entries of all archives: (repo_id, path, is_dir, bytes, content, error).

    A refused archive, or one that fails while it is read, yields a single row with its own path and
    the ``error``. Every accepted one yields its root, a directory with an empty path, so archives without
    entries stay known. An archive's entries are held until all have been read, which the extraction limit
    bounds.
    """
    repo_id = stem(F.col("path")) if repo_id is None else repo_id
    judged = with_verdict(archives, options)
    opened = F.when(F.col("error").isNull(), F.col("content"))
    opening = judged.select(repo_id.alias("repo_id"), "path", "error", opened.alias("content"))
    return opening.mapInArrow(_extract, EXTRACTED)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for repo_id, path, error, content in zip(*batch.columns, strict=True):
            name, reason = repo_id.as_py(), error.as_py()
            entries = []
            if reason is None:
                try:
                    entries = [("", True, 0, None), *_entries(content.as_buffer())]
                except Exception as problem:
                    reason = INVALID_ZIP % problem
            if reason is not None:
                entries = [(path.as_py(), False, None, None)]
            for chunk in _chunks(entries):
                rows = [(name, *entry, reason) for entry in chunk]
                yield pa.record_batch(list(zip(*rows, strict=True)), schema=_EXTRACTED)


def _entries(raw: pa.Buffer) -> list[tuple]:
    """(path, is_dir, bytes, content) by cleaned path; of equal paths the last member stays."""
    entries = {}
    with zipfile.ZipFile(pa.BufferReader(raw)) as archive:
        for member in archive.infolist():
            path = "/".join(part for part in member.filename.split("/") if part not in ("", ".", ".."))
            if path and member.is_dir():
                entries[path] = (path, True, 0, None)
            elif path:
                content = archive.read(member)
                entries[path] = (path, False, len(content), content)
    return list(entries.values())


def _chunks(entries: list[tuple]) -> Iterator[list[tuple]]:
    chunk, held = [], 0
    for entry in entries:
        chunk.append(entry)
        held += entry[2] or 0
        if held >= _BATCH_BYTES:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


_EXTRACTED = pa.schema(
    [
        ("repo_id", pa.string()),
        ("path", pa.string()),
        ("is_dir", pa.bool_()),
        ("bytes", pa.int64()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)


def files_of(entries: DataFrame) -> DataFrame:
    """``files(repo_id, path, bytes, content)`` among extracted entries."""
    kept = F.col("error").isNull() & ~F.col("is_dir")
    return entries.where(kept).select("repo_id", "path", "bytes", "content")


def directories_of(entries: DataFrame) -> DataFrame:
    inside = F.col("error").isNull() & F.col("is_dir") & (F.col("path") != "")
    return entries.where(inside).select("repo_id", "path")


def repositories_of(entries: DataFrame) -> DataFrame:
    """(repo_id) of every accepted archive, empty ones included."""
    return entries.where(F.col("error").isNull() & F.col("is_dir") & (F.col("path") == "")).select("repo_id")
