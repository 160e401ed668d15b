"""ZIP archives read by range: members are listed from the end of a file and dealt to tasks.

The directory of a ZIP archive stands at its end, so listing reads no contents. What is then read is cut
into ranges of members of about equal compressed size, and each range is read by a task of its own, so one
large archive is the work of many tasks.
"""

from __future__ import annotations

import errno
import io
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.options import ScanOptions
from repoquarry.schemas import EXTRACTED
from repoquarry.sources import archives as whole
from repoquarry.sources.archives import INVALID_ZIP, members_rejection, upload_rejection
from repoquarry.sources.directories import Systems, place_of, spread, system_of
from repoquarry.sources.shared import materialize

# Compressed bytes of the members of a range; archives up to this size are read whole by one task.
RANGE_BYTES = 16 * 1024 * 1024

_BATCH_BYTES = 16 * 1024 * 1024
_BUFFER = 64 * 1024
_ROWS = 64
_MEMBERS = "array<struct<ordinal: int, path: string, is_dir: boolean, bytes: decimal(20,0), target: string, kept: boolean, part: int>>"
_LISTED = f"repo_id string, path string, length bigint, system string, place string, members {_MEMBERS}, error string"
_READ = "repo_id string, archive string, path string, ordinal int, bytes bigint, content binary, error string"


class _Seekable(io.RawIOBase):
    """A file of a store as Python's libraries expect it: a place before its beginning is an ``OSError``."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def close(self) -> None:
        self.file.close()
        super().close()

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        start = (0, self.file.tell(), self.file.size())[whence]
        if start + offset < 0:
            raise OSError(errno.EINVAL, "Invalid argument")
        # A store may refuse places behind the end; there is nothing to read there either way.
        self.file.seek(min(start + offset, self.file.size()))
        return self.file.tell()

    def readinto(self, into: memoryview) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)


def _opened(systems: Systems, row: dict) -> BinaryIO:
    system, _, place = systems.at(row["system"], row["place"])
    return io.BufferedReader(_Seekable(system.open_input_file(place)), _BUFFER)


def list_members(named: DataFrame, options: ScanOptions = ScanOptions(), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Adds ``members`` and ``error`` to uploads (repo_id, path, length), reading the ends of the files only.

    Members are in archive order: ``target`` is the path a member is extracted to (empty: nowhere), ``kept``
    whether no later member has the same, and ``part`` its range. Uploads refused by name or size are not
    opened; an archive that cannot be listed has no members and the reason as ``error``. Other columns
    are left out.
    """
    path = F.col("path")
    rows = named.select(
        "repo_id",
        "path",
        "length",
        system_of(path).alias("system"),
        place_of(path).alias("place"),
        upload_rejection(path, F.col("length"), options).alias("refused"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems = Systems()
        for batch in batches:
            for row in _few_at_a_time(batch):
                members, error = None, row.pop("refused")
                if error is None:
                    with _opened(systems, row) as file:
                        try:
                            members = members_of(file, range_bytes)
                        except Exception as problem:  # a broken archive is a value, not a failed job
                            error = INVALID_ZIP % problem
                yield pa.RecordBatch.from_pylist([{**row, "members": members, "error": error}], _LISTED_ARROW)

    return spread(rows, None).mapInArrow(run, _LISTED)


def members_of(file: BinaryIO, range_bytes: int = RANGE_BYTES) -> list[dict]:
    """The members of an archive from its directory alone."""
    with zipfile.ZipFile(file) as archive:
        infos = archive.infolist()
    targets = ["/".join(part for part in m.filename.split("/") if part not in ("", ".", "..")) for m in infos]
    last = {target: i for i, target in enumerate(targets)}
    out, before = [], 0
    for i, (member, target) in enumerate(zip(infos, targets)):
        out.append(
            {
                "ordinal": i,
                "path": member.filename,
                "is_dir": member.is_dir(),
                "bytes": Decimal(member.file_size),
                "target": target,
                "kept": bool(target) and last[target] == i,
                "part": before // range_bytes,
            }
        )
        before += member.compress_size
    return out


def with_verdict(listed: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``error`` of listed archives also by their members."""
    return listed.withColumn("error", F.coalesce("error", members_rejection(F.col("members"), options)))


def entries_by_range(
    named: DataFrame, options: ScanOptions = ScanOptions(), range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Entries of uploads (repo_id, path, length) as ``archives.extracted`` gives them, read by range.

    A task holds one member at a time and about 16 MB of what it has read. All members of an accepted
    archive are read, also those that a later one replaces, as each may be damaged: the first damaged one
    in archive order refuses the archive. What the ranges give is stored before, so that an archive
    is shown as a whole or not at all. (repo_id, path) is a key of ``named``.
    """
    judged = materialize(with_verdict(list_members(named, options, range_bytes), options), "archive-members")
    if judged.isEmpty():
        return judged.sparkSession.createDataFrame([], EXTRACTED)
    accepted = judged.where("error IS NULL")
    each = accepted.select("repo_id", "path", "system", "place", F.explode("members").alias("m"))
    files = each.where("m.target <> '' AND NOT m.is_dir").select("repo_id", "path", "system", "place", "m.part", "m.ordinal", "m.target", "m.kept")
    keys = ["system", "place", "part"]
    number = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.repartition(number, *keys).groupBy("repo_id", "path", *keys)
    ranges = ranges.agg(F.sort_array(F.collect_list(F.struct("ordinal", "target", "kept"))).alias("members"))
    read = materialize(ranges.mapInArrow(_read_range, _READ), "archive-entries")
    failed = read.where("error IS NOT NULL").groupBy("repo_id", "archive").agg(F.min_by("error", "ordinal").alias("error"))
    failed = materialize(failed, "archive-failures")

    def whole_only(rows: DataFrame) -> DataFrame:
        return rows.join(failed.select("repo_id", "archive"), ["repo_id", "archive"], "left_anti")

    archive = F.col("path").alias("archive")
    directories = each.where("m.kept AND m.is_dir").select("repo_id", archive, F.col("m.target").alias("path"))
    roots = accepted.select("repo_id", archive, F.lit("").alias("path"))
    folders = whole_only(directories.unionByName(roots)).select("repo_id", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("bytes"))
    contents = whole_only(read.where("error IS NULL")).select("repo_id", "path", F.lit(False).alias("is_dir"), "bytes", "content")
    refused = judged.where("error IS NOT NULL").select("repo_id", "path", "error")
    refused = refused.unionByName(failed.select("repo_id", F.col("archive").alias("path"), "error"))
    refused = refused.withColumn("is_dir", F.lit(False))
    found = contents.unionByName(folders, allowMissingColumns=True).unionByName(refused, allowMissingColumns=True)
    return found.select("repo_id", "path", "is_dir", "bytes", "content", "error")


def opened_entries(
    named: DataFrame, options: ScanOptions = ScanOptions(), range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Entries of accepted uploads (unique_name, path, length); those over ``range_bytes`` are read by range."""
    small = whole.opened_entries(named.where(F.col("length") <= range_bytes), options)
    large = named.where(F.col("length") > range_bytes).withColumn("repo_id", F.col("unique_name"))
    return small.unionByName(entries_by_range(large, options, range_bytes))


def _read_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    systems = Systems()
    for batch in batches:
        for row in _few_at_a_time(batch):
            with _opened(systems, row) as file:
                yield from _range_of(file, row)


def _few_at_a_time(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as ``to_pylist`` gives them; only ``_ROWS`` of a batch are Python objects at a time."""
    for start in range(0, batch.num_rows, _ROWS):
        yield from batch.slice(start, _ROWS).to_pylist()


def _range_of(file: BinaryIO, row: dict) -> Iterator[pa.RecordBatch]:
    """What the members of a range hold; the first damaged one ends it with its reason."""
    out, held = [], 0
    at = row["members"][0]["ordinal"]
    shown = {"repo_id": row["repo_id"], "archive": row["path"]}
    try:
        with zipfile.ZipFile(file) as archive:
            infos = archive.infolist()
            for member in row["members"]:
                at = member["ordinal"]
                content = archive.read(infos[at])
                if member["kept"]:
                    out.append({**shown, "path": member["target"], "ordinal": at, "bytes": len(content), "content": content})
                    held += len(content)
                if held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _READ_ARROW)
                    out, held = [], 0
    except Exception as problem:
        out.append({**shown, "ordinal": at, "error": INVALID_ZIP % problem})
    if out:
        yield pa.RecordBatch.from_pylist(out, _READ_ARROW)


_MEMBER = pa.struct(
    [
        ("ordinal", pa.int32()),
        ("path", pa.string()),
        ("is_dir", pa.bool_()),
        ("bytes", pa.decimal128(20, 0)),
        ("target", pa.string()),
        ("kept", pa.bool_()),
        ("part", pa.int32()),
    ]
)
_LISTED_ARROW = pa.schema(
    [
        ("repo_id", pa.string()),
        ("path", pa.string()),
        ("length", pa.int64()),
        ("system", pa.string()),
        ("place", pa.string()),
        ("members", pa.list_(_MEMBER)),
        ("error", pa.string()),
    ]
)
_READ_ARROW = pa.schema(
    [
        ("repo_id", pa.string()),
        ("archive", pa.string()),
        ("path", pa.string()),
        ("ordinal", pa.int32()),
        ("bytes", pa.int64()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)
