"""Binary rows written to and read from a shared file system, one file per row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemes of Hadoop connectors, and the scheme of the same store in pyarrow.
_SAME_STORE = {"s3a": "s3", "s3n": "s3"}
_KNOWN = frozenset(["file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss"])


def write_blobs(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``content`` of every row (path, content) to ``folder/path`` and return (path, bytes).

    Names are taken as they are: blanks, ``%``, ``#`` or brackets in them mean nothing, and they may
    start with a dot or underscore. A folder without a scheme lies on Spark's default file system. A
    repeated task writes the same bytes to the same place, so losing an executor does no harm. The rows
    returned are those written when read, so callers run an action over them.
    """
    place = qualified(rows.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(place)
        made = set()
        for batch in batches:
            paths, contents = batch.column(0).to_pylist(), batch.column(1)
            for path, content in zip(paths, contents, strict=True):
                target = f"{root}/{path}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(target) as out:
                    out.write(content.as_buffer())
            yield pa.record_batch([paths, [len(c.as_buffer()) for c in contents]], schema=_WRITTEN)

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(
        write, "path string, bytes bigint"
    )


_WRITTEN = pa.schema([("path", pa.string()), ("bytes", pa.int64())])


def default_system(spark: SparkSession) -> str:
    """The file system of paths without a scheme, as ``scheme://authority``."""
    named = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    scheme, _, rest = named.partition("://")
    return f"{scheme or 'file'}://{rest.partition('/')[0]}"


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with scheme and authority, otherwise unchanged; raises for stores tasks cannot open."""
    if ":/" not in folder.partition("/")[0] + "/":
        folder = default_system(spark) + ("" if folder.startswith("/") else "/") + folder
    opened_scheme(folder)
    return folder


def opened_scheme(folder: str) -> str:
    scheme = folder.partition(":")[0]
    scheme = _SAME_STORE.get(scheme, scheme)
    if scheme not in _KNOWN:
        raise ValueError(f"{folder}: tasks cannot open {scheme}://, only {', '.join(sorted(_KNOWN | _SAME_STORE.keys()))}")
    return scheme


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified folder. Only scheme and authority are read as a URI."""
    scheme = opened_scheme(folder)
    rest = folder.partition(":")[2]
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, path = rest.removeprefix("//").partition("/")
    system, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, "/".join(part.strip("/") if i else part.rstrip("/") for i, part in enumerate([base, path]) if i == 0 or part)
