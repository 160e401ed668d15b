"""Files that appear all together or not at all: a data source whose writes are committed.

Tasks write below a folder of the attempt, beside the one asked for. When all of them have ended, one
rename shows the attempt under the wanted name; when one of them fails for good, the attempt is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from repoquarry.sources.blobs import opened, qualified

MANIFEST = "_manifest.json"


class CommittedFiles(DataSource):
    """Rows (path, content) as files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], uuid.uuid4().hex, overwrite)


@dataclass
class _Written(WriterCommitMessage):
    files: int
    bytes: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, job: str, overwrite: bool):
        self.folder, self.job, self.overwrite = folder.rstrip("/"), job, overwrite

    def _places(self) -> tuple[pafs.FileSystem, str, str, str]:
        """The file system, and on it the folder, that of the attempt, and that of what is replaced."""
        system, folder = opened(self.folder)
        parent, _, name = folder.rpartition("/")
        return system, folder, f"{parent}/_attempt-{self.job}-{name}", f"{parent}/_replaced-{self.job}-{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """A repeated task writes the same bytes to the same places."""
        system, _, attempt, _ = self._places()
        files = size = 0
        made: set[str] = set()
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                target = f"{attempt}/{path}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                data = content.as_buffer() if content.is_valid else b""
                with system.open_output_stream(target) as out:
                    out.write(data)
                files, size = files + 1, size + len(data)
        return _Written(files, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The driver has one short message a task, and renames one folder."""
        system, folder, attempt, replaced = self._places()
        done = [m for m in messages if m is not None]
        system.create_dir(attempt, recursive=True)
        totals = {"job": self.job, "tasks": len(done), "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}
        with system.open_output_stream(f"{attempt}/{MANIFEST}") as out:
            out.write(json.dumps(totals).encode())
        there = system.get_file_info(folder).type != pafs.FileType.NotFound
        if there and not self.overwrite:
            system.delete_dir(attempt)
            raise FileExistsError(f"{self.folder} is there already")
        if there:
            system.move(folder, replaced)
        system.move(attempt, folder)
        if there:
            system.delete_dir(replaced)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _, attempt, _ = self._places()
        if system.get_file_info(attempt).type != pafs.FileType.NotFound:
            system.delete_dir(attempt)


def write_committed(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write ``content`` of every row (path, content) to ``folder/path``; all files appear at once.

    ``folder`` must not exist unless ``overwrite`` is set, and is then replaced as a whole. After a failed
    job it is as it was before. ``_manifest.json`` in it has the numbers of tasks, files and bytes. Null
    contents are empty files; of rows with the same path one stays; no rows make an empty folder. Other
    columns of ``rows`` do not matter. Names are taken as they are, as by ``write_blobs``. The file system
    has to rename folders as one step, as HDFS and local ones do and object stores do not.
    """
    spark = rows.sparkSession
    spark.dataSource.register(CommittedFiles)
    found = rows.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    mode = "overwrite" if overwrite else "append"
    found.write.format(CommittedFiles.name()).mode(mode).save(qualified(spark, folder))
