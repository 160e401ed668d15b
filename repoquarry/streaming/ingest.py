"""Incremental ingest: new uploads in a folder become rows of a table.

The stream carries names and sizes only. Uploads are refused by name or size; the others get the names
a whole ingest in the same order would give, and are opened in tasks, those of several batches together.
The file source remembers which uploads it has seen; the names taken are keyed state of the stream, one
number for every name ever asked for, and a batch touches the state of the names it brings.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import MapState, TimerValues

from repoquarry.functions.paths import stem
from repoquarry.operators.files import capped
from repoquarry.operators.naming import Names, root_of
from repoquarry.operators.records import file_records
from repoquarry.options import ScanOptions
from repoquarry.schemas import ARCHIVES, EXTRACTED
from repoquarry.sources.archives import directories_of, files_of, refused_entries, repositories_of, upload_rejection
from repoquarry.sources.ranges import opened_entries
from repoquarry.streaming.statistics import add_statistics

_NAMED = "path string, modificationTime timestamp, length bigint, unique_name string"
# Uploads of a batch are dealt to so many groups; fixed, as the state is kept by group.
_SHARES = 128
# Only names and sizes of files are read, so many of them make a task.
_OPEN_COST = 64 * 1024
# A batch reads and writes the state of its own names only, however many there are.
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Uploads of so many batches are opened by the same jobs.
_OPENED_TOGETHER = 16
_TABLES = ("entries", "file_records", "statistics/files", "statistics/imports", "statistics/repositories")


def archive_stream(spark: SparkSession, folder: str, max_archives_per_batch: int = 1000) -> DataFrame:
    """Uploads of any name as they arrive: (path, modificationTime, length); nothing is opened.

    The stream has a session of its own, with the settings of ``spark`` but for those of listing.
    """
    return (
        _listing_session(spark)
        .readStream.format("binaryFile")
        .schema(ARCHIVES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_archives_per_batch)
        .load(folder)
        .select("path", "modificationTime", "length")
    )


def _listing_session(spark: SparkSession) -> SparkSession:
    """A session in which the files of a batch are listed, scanned and named by few tasks.

    Spark looks up every file of a batch again, in a task each up to the limit that is set here. A batch is
    bounded, whatever all uploads are, so its names are dealt to no more tasks than run at a time.
    """
    parallelism = spark.sparkContext.defaultParallelism
    session = _session_like(spark, parallelism)
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", max(16, 2 * parallelism))
    session.conf.set("spark.sql.files.openCostInBytes", _OPEN_COST)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return session


def _session_like(spark: SparkSession, most_tasks: int) -> SparkSession:
    """A session with the settings of ``spark`` and at most so many tasks after a shuffle."""
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if session.conf.isModifiable(name):
            session.conf.set(name, value)
    if int(session.conf.get("spark.sql.shuffle.partitions")) > most_tasks:
        session.conf.set("spark.sql.shuffle.partitions", most_tasks)
    return session


def named_uploads(uploads: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """(path, modificationTime, length, unique_name) of a stream of uploads.

    Uploads that name or size refuse take no name. Within a batch names are taken by (modificationTime,
    path), and batches follow each other. Names need the state store and the session of ``archive_stream``.
    """
    refused = upload_rejection(F.col("path"), F.col("length"), options)
    asked = uploads.withColumn("name", F.when(refused.isNull(), stem(F.col("path"))))
    keyed = asked.withColumn("share", _share(F.col("name"), F.col("path")))
    return keyed.groupBy("share").transformWithStateInPandas(_NameTaker(), _NAMED, "append", "none")


def _share(name: Column, path: Column) -> Column:
    """Names with the same root are in the same share; refused uploads are dealt by their paths."""
    return F.pmod(F.xxhash64(F.coalesce(root_of(name), path)), F.lit(_SHARES)).cast("int")


class _NameTaker(StatefulProcessor):
    """Names for the uploads of one share in one batch, which the source's limit bounds.

    The state has a number for every name ever asked for, each of which is read and written by itself.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getMapState("following", "name string", "following bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        columns = ("modificationTime", "path", "length", "name")
        found = [row for frame in rows for row in zip(*(frame[c].tolist() for c in columns), strict=True)]
        found.sort(key=lambda row: row[:2])
        times, paths, lengths, asked = zip(*found, strict=True)
        following = _Following(self.stored)
        names = Names(following)
        taken = [names.take(n) if isinstance(n, str) else None for n in asked]
        following.store()
        yield pd.DataFrame({"path": paths, "modificationTime": times, "length": lengths, "unique_name": taken})

    def close(self) -> None:
        pass


class _Following(dict):
    """Numbers of names; each is looked up in the state when it is first asked for."""

    def __init__(self, stored: MapState):
        super().__init__()
        self.stored, self.changed = stored, set()

    def get(self, name: str, default: int | None = None) -> int | None:
        if not super().__contains__(name):
            found = self.stored.getValue((name,))
            super().__setitem__(name, None if found is None else found[0])
        number = super().__getitem__(name)
        return default if number is None else number

    def __contains__(self, name: str) -> bool:
        return self.get(name) is not None

    def __setitem__(self, name: str, number: int) -> None:
        super().__setitem__(name, number)
        self.changed.add(name)

    def store(self) -> None:
        for name in self.changed:
            self.stored.updateValue((name,), (self[name],))


def ingest_new_archives(
    uploads: DataFrame, folder: str, checkpoint: str, options: ScanOptions = ScanOptions()
) -> StreamingQuery:
    """Append entries, refusals, file records and statistics of uploads that have arrived, then stop.

    Each batch stores its names in a folder of its own, replaced as a whole; they are the same if it is run
    again after a failure, as the state is that of the batch before. Uploads of up to 16 batches are opened
    together, to folders named by the last of them. The query is active until all of them have been opened;
    what a failure leaves named but not opened is opened by the next run, and none is shown twice.
    """
    opening = _Opening(uploads.sparkSession, folder, checkpoint, options)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Stored first, as reading a batch again would take its names again.
        batch.write.mode("overwrite").parquet(f"{folder}/names/batch={batch_id}")
        opening.add(batch_id)

    started = (
        named_uploads(uploads, options)
        .writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return _Ingest(started, opening)


class _Opening:
    """Opens the uploads of named batches, several batches together, beside the stream that names them.

    Marks beside the checkpoint say which batches have been named and which opened.
    """

    def __init__(self, spark: SparkSession, folder: str, checkpoint: str, options: ScanOptions):
        self.spark = _session_like(spark, 2 * spark.sparkContext.defaultParallelism)
        self.folder, self.checkpoint, self.options = folder, checkpoint, options
        self.opened = max(self._marks("opened"), default=-1)
        self.waiting = {k for k in self._marks("named") if k > self.opened}
        self.changed, self.problem = threading.Condition(), None

    def add(self, batch: int) -> None:
        """A batch whose names are stored; one that had been opened before a failure has the same names again."""
        self._mark("named", batch)
        with self.changed:
            if batch > self.opened:
                self.waiting.add(batch)
                self.changed.notify_all()
            while self.problem is None and len(self.waiting) > 2 * _OPENED_TOGETHER:
                self.changed.wait()
            if self.problem is not None:
                raise self.problem

    def run(self, stream: StreamingQuery) -> None:
        """Open batches until the stream has ended and none is waiting."""
        try:
            while batches := self._next(stream):
                self._open(batches)
                self._mark("opened", batches[-1])
                with self.changed:
                    self.opened = batches[-1]
                    self.waiting.difference_update(batches)
                    self.changed.notify_all()
        except Exception as problem:
            with self.changed:
                self.problem = problem
                self.changed.notify_all()

    def _next(self, stream: StreamingQuery) -> list[int]:
        with self.changed:
            while stream.isActive and len(self.waiting) < _OPENED_TOGETHER:
                self.changed.wait(0.2)
            return sorted(self.waiting)[:_OPENED_TOGETHER]

    def _open(self, batches: list[int]) -> None:
        folder, options, last = self.folder, self.options, batches[-1]
        # An attempt that failed may have opened other batches together.
        for name in _TABLES:
            for k in batches:
                self._delete(f"{folder}/{name}/batch={k}")
        arrived = self.spark.read.schema(_NAMED).parquet(*(f"{folder}/names/batch={k}" for k in batches))
        new = arrived.where("unique_name IS NOT NULL").select("unique_name", "path", "length")
        refused = arrived.where("unique_name IS NULL").drop("unique_name")
        entries = f"{folder}/entries/batch={last}"
        found = opened_entries(new, options).unionByName(refused_entries(refused, options), allowMissingColumns=True)
        found.write.mode("overwrite").parquet(entries)
        stored = self.spark.read.schema(EXTRACTED).parquet(entries)
        files = capped(files_of(stored), options.max_files, directories_of(stored))
        records = f"{folder}/file_records/batch={last}"
        written = file_records(files, options)
        written.write.mode("overwrite").parquet(records)
        stored_records = self.spark.read.schema(written.schema).parquet(records)
        add_statistics(stored_records, repositories_of(stored), f"{folder}/statistics", last)

    def _path(self, place: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def _marks(self, kind: str) -> list[int]:
        system, path = self._path(f"{self.checkpoint}/{kind}")
        return [int(s.getPath().getName()) for s in system.listStatus(path)] if system.exists(path) else []

    def _mark(self, kind: str, batch: int) -> None:
        system, path = self._path(f"{self.checkpoint}/{kind}/{batch}")
        system.create(path, True).close()

    def _delete(self, place: str) -> None:
        system, path = self._path(place)
        system.delete(path, True)


class _Ingest(StreamingQuery):
    """The stream of names, which ends when all that it has named has been opened, too."""

    def __init__(self, stream: StreamingQuery, opening: _Opening):
        super().__init__(stream._jsq)
        self._opening = opening
        self._thread = InheritableThread(target=opening.run, args=(stream,), daemon=True)
        self._thread.start()

    @property
    def isActive(self) -> bool:
        return super().isActive or self._thread.is_alive()

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        until = None if timeout is None else time.monotonic() + timeout
        super().awaitTermination(timeout)
        self._join(until)
        return None if timeout is None else not self.isActive

    def processAllAvailable(self) -> None:
        super().processAllAvailable()
        self._join(None)

    def _join(self, until: float | None) -> None:
        self._thread.join(None if until is None else max(0, until - time.monotonic()))
        if self._opening.problem is not None:
            raise self._opening.problem
