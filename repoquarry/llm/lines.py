"""Removal of lines that many documents share, with an index that can take documents back.

The index has three tables. ``references`` names the lines of every document, ``counts`` has for every
line the exact number of documents that refer to it and the largest of their ids, and ``filters`` holds,
for every shard of the line digests, a cuckoo filter of the lines that enough documents refer to. Lines
of documents meet the small filters first; only what a filter holds is looked up in the counts. A line
enters its filter when its count reaches the threshold and leaves it when the count falls below, so
inserting and deleting the same documents leaves every decision as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoquarry.llm.cuckoo import Cuckoo
from repoquarry.sources.shared import materialize

MIN_DOCS = 3
MIN_CHARS = 20
# Lines in a filter, on average, and rows that look into one at a time.
SHARD_LINES = 1 << 14
PROBE_ROWS = 1 << 16
_LEAST_BITS = 6
_BLANK = b" \t\n\x0b\x0c\r"
_MOST_UTF8 = 4


def line_digest(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a line without blanks at its ends and with A-Z in lower case; none of a short line."""
    key = line.strip(_BLANK).lower()
    if len(key) < min_chars:
        return None
    if len(key) < _MOST_UTF8 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


@dataclass
class LineIndex:
    """The lines of a set of documents, and which of them are repeated. Tables are not changed, but replaced."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    bits: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @classmethod
    def over(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        """The index of ``docs`` (doc_id, text).

        ``min_docs`` documents make a line repeated; lines under ``min_chars`` code points never are.
        Rows are documents: repeated rows and rows with the same id count as often as they occur. Null ids
        are smaller than all others. Null and empty texts have one empty line.
        """
        kind = docs.schema["doc_id"].dataType.simpleString()
        spark = docs.sparkSession
        return cls(
            spark.createDataFrame([], _REFERENCES.format(kind)),
            spark.createDataFrame([], _COUNTS.format(kind)),
            spark.createDataFrame([], _FILTERS),
            _LEAST_BITS,
            min_docs,
            min_chars,
        ).insert(docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with ``docs`` (doc_id, text) added; their lines are counted before they move."""
        new = materialize(_references(docs, self.min_chars), "line-references")
        found = _lines(new).groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"))
        known = self.counts.select("line", F.lit(0).cast("bigint").alias("new"), F.col("n").alias("before"), "largest")
        found = found.select("line", F.col("n").alias("new"), F.lit(0).cast("bigint").alias("before"), "largest")
        merged = known.unionByName(found).groupBy("line").agg(
            F.sum("before").alias("before"), (F.sum("before") + F.sum("new")).alias("n"), F.max("largest").alias("largest")
        )
        return self._with(self.references.unionByName(new), materialize(merged, "line-counts"))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ``ids`` (doc_id); unknown ids change nothing.

        Lines that lose a document are counted anew from the references that stay.
        """
        ids = ids.select("doc_id").distinct()
        same = self.references["doc_id"].eqNullSafe(ids["doc_id"])
        gone = materialize(self.references.join(ids, same, "left_semi"), "line-references")
        kept = materialize(self.references.join(ids, same, "left_anti"), "line-references")
        fewer = materialize(_lines(gone).select("line").distinct(), "lines")
        again = _lines(kept).join(fewer, "line", "left_semi")
        again = again.groupBy("line").agg(F.count("*").alias("now"), F.max("doc_id").alias("last"))
        untouched = self.counts.join(fewer, "line", "left_anti").select("line", F.col("n").alias("before"), "n", "largest")
        touched = self.counts.join(fewer, "line", "left_semi").join(again, "line", "left")
        counted = touched.select("line", F.col("n").alias("before"), F.coalesce("now", F.lit(0)).alias("n"), F.col("last").alias("largest"))
        return self._with(kept, materialize(untouched.unionByName(counted), "line-counts"))

    def _with(self, references: DataFrame, changed: DataFrame) -> LineIndex:
        """The index with new tables; ``changed`` are counts together with those ``before``."""
        over = F.col("n") >= self.min_docs
        was = F.col("before") >= self.min_docs
        counts = changed.where("n > 0").select("line", "n", "largest")
        repeated = counts.where(over).count()
        bits = max(_LEAST_BITS, (repeated // SHARD_LINES).bit_length())
        if bits > self.bits + 1 or not self.filters.limit(1).count():
            steps, filters = counts.where(over).select("line", F.lit(True).alias("enters")), self.filters.limit(0)
        else:
            bits, filters = self.bits, self.filters
            steps = changed.where(over != was).select("line", over.alias("enters"))
        steps = steps.withColumn("shard", _shard(F.col("line"), bits))
        moved = filters.groupBy("shard").cogroup(steps.groupBy("shard")).applyInPandas(_updated, _FILTERS)
        moved = materialize(moved, "line-filters")
        full = moved.where("filter IS NULL").select("shard")
        if full.limit(1).count():
            lines = counts.where(over).select("line", _shard(F.col("line"), bits).alias("shard"), F.lit(True).alias("enters"))
            lines = lines.join(full, "shard", "left_semi")
            made = filters.limit(0).groupBy("shard").cogroup(lines.groupBy("shard")).applyInPandas(_updated, _FILTERS)
            moved = materialize(moved.where("filter IS NOT NULL").unionByName(made), "line-filters")
        return LineIndex(references, counts, moved, bits, self.min_docs, self.min_chars)

    def droppable(self, references: DataFrame) -> DataFrame:
        """(doc_id, place, lines): the lines that documents of ``references`` lose.

        Lines go to the filter of their shard; a shard that many rows look into, as one very common line
        makes it, is shared by several groups with a copy of the filter each. What the filter holds is
        then checked with the exact counts.
        """
        asked = _lines(references).withColumn("shard", _shard(F.col("line"), self.bits))
        parts = asked.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("parts"))
        parts = materialize(parts, "line-shards")
        shared = parts.where("parts > 1")
        # Only shards with many rows are listed here: one for every PROBE_ROWS rows at most.
        dealt = asked.join(shared, "shard", "left").withColumn(
            "part", F.pmod(F.xxhash64("doc_id", "place"), F.coalesce("parts", F.lit(1))).cast("int")
        )
        filters = self.filters.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = filters.select("shard", "part", "filter").unionByName(
            dealt.select("shard", "part", "doc_id", "place", "line"), allowMissingColumns=True
        )
        ordered = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())
        kind = references.schema["doc_id"].dataType.simpleString()
        maybe = ordered.mapInArrow(_held, f"doc_id {kind}, place bigint, line binary")
        exact = self.counts.where(F.col("n") >= self.min_docs).select("line", "largest")
        lost = maybe.join(exact, "line").where(~F.col("doc_id").eqNullSafe(F.col("largest")))
        return lost.groupBy("doc_id", "place").agg(F.collect_set("line").alias("lines"))

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """``docs`` with shortened ``text``, and ``n_lines`` (before) and ``n_dropped`` of every row.

        Lines that at least ``min_docs`` documents of the index hold go, all of them, unless the row's id is the
        largest that holds them. Rows keep their other columns; columns named ``n_lines`` or ``n_dropped``
        are replaced. Null texts stay null, with one line. An empty table gives no rows.
        """
        return self._cut(docs, _references(docs, self.min_chars))

    def deduplicated_members(self, docs: DataFrame) -> DataFrame:
        """``deduplicated`` for documents that are all of the index, whose lines are known."""
        return self._cut(docs, self.references)

    def _cut(self, docs: DataFrame, references: DataFrame) -> DataFrame:
        lost = self.droppable(references).withColumnsRenamed({"doc_id": "_lost_id", "place": "_lost_place"})
        columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        rows = docs.select(*(F.col(f"`{c}`") for c in columns), _place(F.col("text")).alias("_place"))
        met = rows["doc_id"].eqNullSafe(lost["_lost_id"]) & (rows["_place"] == lost["_lost_place"])
        joined = rows.join(lost, met, "left").select(*(rows[f"`{c}`"] for c in columns), lost["lines"].alias("_lines"))
        schema = docs.select(*(F.col(f"`{c}`") for c in columns)).schema.add("n_lines", T.LongType()).add("n_dropped", T.LongType())
        return joined.mapInArrow(_shortened(columns.index("text"), self.min_chars), schema)

    def save(self, folder: str) -> None:
        """Write the index to ``folder``, which must not exist."""
        for name in ("references", "counts", "filters"):
            getattr(self, name).write.parquet(f"{folder}/{name}")
        spark = self.counts.sparkSession
        spark.createDataFrame([(self.bits, self.min_docs, self.min_chars)], _SETTINGS).coalesce(1).write.parquet(f"{folder}/settings")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LineIndex:
        bits, min_docs, min_chars = spark.read.parquet(f"{folder}/settings").head()
        tables = (spark.read.parquet(f"{folder}/{name}") for name in ("references", "counts", "filters"))
        return cls(*tables, bits, min_docs, min_chars)


_REFERENCES = "doc_id {}, place bigint, lines array<binary>"
_COUNTS = "line binary, n bigint, largest {}"
_FILTERS = "shard bigint, filter binary"
_SETTINGS = "bits int, min_docs int, min_chars int"


def _place(text: Column) -> Column:
    """Spreads rows with equal ids; rows that agree in it lose the same lines, whatever their texts are."""
    return F.xxhash64(text.cast("string"))


def _shard(line: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.hex(F.substring(line, 1, 4)), 16, 10).cast("bigint"), 32 - bits)


def _lines(references: DataFrame) -> DataFrame:
    return references.select("doc_id", "place", F.explode("lines").alias("line"))


def _references(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, place, lines): the digests of the distinct lines of every row, a narrow job over whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digests(t, min_chars) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            lines = pa.array(found, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lines], ["doc_id", "place", "lines"])

    text = F.col("text").cast("string")
    return docs.select("doc_id", _place(text).alias("place"), text.alias("text")).mapInArrow(run, _REFERENCES.format(kind))


def _digests(text: bytes | None, min_chars: int) -> list[bytes]:
    found = (line_digest(line, min_chars) for line in (text or b"").split(b"\n"))
    return list(dict.fromkeys(d for d in found if d is not None))


def _updated(key: tuple, filters: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """The filter of a shard after lines have entered and left; null if it has to be made anew."""
    enters = steps["enters"].astype(bool)
    entering, leaving = steps["line"][enters].tolist(), steps["line"][~enters].tolist()
    if not len(filters):
        made = Cuckoo.of(entering)
    else:
        made = Cuckoo.from_bytes(filters["filter"].iloc[0])
        made.remove(leaving)
        made = made if made.insert(entering) else None
    return pd.DataFrame({"shard": [key[0]], "filter": [made.to_bytes() if made else None]})


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that the filter of their shard holds; the filter comes first among the rows of a group.

    One filter and one batch are held at a time, however many rows a group has.
    """
    at, filter_ = None, None
    for batch in batches:
        groups = list(zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist()))
        cuts = [0, *(k for k in range(1, len(groups)) if groups[k] != groups[k - 1]), len(groups)]
        for first, last in zip(cuts, cuts[1:]):
            part = batch.slice(first, last - first)
            if groups[first] != at:
                at, filter_ = groups[first], None
            head = part.column("filter")[0].as_py()
            if head is not None:
                filter_, part = Cuckoo.from_bytes(head), part.slice(1)
            if filter_ is None or not part.num_rows:
                continue
            kept = part.filter(pa.array(filter_.holds(part.column("line").to_pylist())))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("doc_id", "place", "line")], ["doc_id", "place", "line"])


def _shortened(text_at: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, lost = batch.columns
            texts = columns[text_at].cast(pa.large_binary()).to_pylist()
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(texts, lost.to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [line for line in lines if line_digest(line, min_chars) not in gone]
                    text = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(text)
            columns[text_at] = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(columns[text_at].type)
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return run
