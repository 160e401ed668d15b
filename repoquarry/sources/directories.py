"""Recursive scan of repositories that lie as directory trees on a shared file system.

Spark's own file sources leave out names that start with ``_`` or ``.``, so ``__init__.py`` would be
lost. Listing and reading run in tasks instead; sizes and names are known before anything is read.
A listed entry carries its file system and its own path there; names are never read as URIs again.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.schemas import FILES, LISTED
from repoquarry.sources.blobs import default_system, opened
from repoquarry.sources.shared import materialize

_BATCH_BYTES = 16 * 1024 * 1024
_BATCH_ROWS = 1000


def list_directories(roots: DataFrame, directories_per_task: int = 2000, tasks: int | None = None) -> DataFrame:
    """Entries below every root: (repo_id, path, system, place, is_dir, bytes, modified, listed).

    From ``roots(repo_id, root)``. A task lists what lies below its directories, level by level, up to
    ``directories_per_task`` of them for each it was given; those left are spread over all tasks in
    another round, until none is. A tree of any size is so listed by many tasks, each of which holds the
    entries of one directory and a bounded queue. Only names and sizes move.
    """
    spark = roots.sparkSession
    root = F.regexp_replace("root", "/+$", "")
    named = F.when(root.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), root).otherwise(
        F.concat(F.lit(default_system(spark)), F.when(F.startswith(root, F.lit("/")), "").otherwise("/"), root)
    )
    entries = roots.select(
        "repo_id",
        F.lit("").alias("path"),
        system_of(named).alias("system"),
        place_of(named).alias("place"),
        F.lit(True).alias("is_dir"),
        F.lit(0).cast("bigint").alias("bytes"),
        F.lit(None).cast("timestamp").alias("modified"),
        F.lit(False).alias("listed"),
    )
    rounds = []
    while not rounds or not entries.isEmpty():
        found = spread(entries, tasks).mapInArrow(_lister(directories_per_task), LISTED)
        rounds.append(materialize(found, "listing"))
        entries = rounds[-1].where(~F.col("listed"))
    # What waited for a round is passed on by it.
    parts = [r.where("listed AND path <> ''") for r in rounds]
    return reduce(DataFrame.unionByName, parts)


def system_of(root: Column) -> Column:
    """``scheme://authority`` of a qualified root."""
    return F.when(root.rlike("^file:"), F.lit("file://")).otherwise(F.regexp_extract(root, r"^([^:]+://[^/]*)", 1))


def place_of(root: Column) -> Column:
    """The rest of it, which begins with a slash."""
    return F.when(root.rlike("^file:"), F.regexp_replace(root, "^file:/*", "/")).otherwise(
        F.regexp_replace(root, r"^[^:]+://[^/]*", "")
    )


def spread(entries: DataFrame, tasks: int | None) -> DataFrame:
    """Rows spread by location over a fixed number of tasks.

    Without a number Spark would merge tasks by the size of these short rows, not of what they name.
    """
    number = tasks or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(number, "system", "place")


class Systems:
    """File systems of a task, opened once each."""

    def __init__(self) -> None:
        self.open: dict[str, tuple[pafs.FileSystem, str]] = {}

    def at(self, system: str, place: str) -> tuple[pafs.FileSystem, str, str]:
        """(file system, its name for the root, its name for ``place``)."""
        if system not in self.open:
            opened_system, root = opened(system + "/")
            self.open[system] = opened_system, root.rstrip("/")
        found, root = self.open[system]
        return found, root, f"{root}{place}" if root or place.startswith("/") else place


def _lister(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems = Systems()
        out = []
        for batch in batches:
            for row in batch.to_pylist():
                queue, done = deque([row]), 0
                while queue:
                    here = queue.popleft()
                    here["listed"] = done < most
                    out.append(here)
                    if here["listed"]:
                        done += 1
                        for entry in _inside(here, systems):
                            if entry["is_dir"]:
                                queue.append(entry)
                            else:
                                out.append(entry)
                            if len(out) >= _BATCH_ROWS:
                                yield pa.RecordBatch.from_pylist(out, _LISTED)
                                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _LISTED)

    return run


def _inside(row: dict, systems: Systems) -> Iterator[dict]:
    system, _, folder = systems.at(row["system"], row["place"])
    for info in system.get_file_info(pafs.FileSelector(folder or "/", recursive=False)):
        if info.type in (pafs.FileType.File, pafs.FileType.Directory):
            yield {
                "repo_id": row["repo_id"],
                "path": f"{row['path']}/{info.base_name}" if row["path"] else info.base_name,
                "system": row["system"],
                "place": f"{row['place']}/{info.base_name}",
                "is_dir": info.type == pafs.FileType.Directory,
                "bytes": info.size or 0,
                "modified": info.mtime,
                "listed": True,
            }


def read_contents(listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """``files(repo_id, path, bytes, content)`` of listed files.

    Filter the listing by name and size first: what is filtered out is never opened. Rows are spread
    by location before reading, so no task holds all files of a repository.
    """
    files = listed.where(~F.col("is_dir")).select("repo_id", "path", "system", "place", "bytes")
    return spread(files, tasks).mapInArrow(_read, FILES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    systems = Systems()
    for batch in batches:
        rows, held = [], 0
        for row in batch.to_pylist():
            system, _, place = systems.at(row.pop("system"), row.pop("place"))
            with system.open_input_stream(place, compression=None) as stream:
                row["content"] = stream.read()
            rows.append(row)
            held += len(row["content"])
            if held >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _FILES)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FILES)


_LISTED = pa.schema(
    [
        ("repo_id", pa.string()),
        ("path", pa.string()),
        ("system", pa.string()),
        ("place", pa.string()),
        ("is_dir", pa.bool_()),
        ("bytes", pa.int64()),
        ("modified", pa.timestamp("us", "UTC")),
        ("listed", pa.bool_()),
    ]
)
_FILES = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("content", pa.binary())])
