"""Deterministic sharded WARC archives: writing through temporary names and a manifest, reading back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.llm.sharding import shard_by_bytes
from repoquarry.sources.blobs import opened, qualified

# Payload bytes per shard, and compressed bytes after which a shard starts its next file.
SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "file string, shard int, records bigint, bytes bigint, sha256 string"
_RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line: blanks and control characters as percent escapes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _record_id(page: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}/{digest}/{copy}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without a time stamp."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def record(page: int | None, url: str | None, payload: bytes, first: int | None, copy: int, date: str) -> bytes:
    """A response record, or with ``copy`` > 0 a revisit of page ``first``, whose payload is the same."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() if copy else http.encode() + payload
    headers = [
        ("WARC-Type", "revisit" if copy else "response"),
        ("WARC-Record-ID", _record_id(page, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _field(url) if url else f"urn:page:{page}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    headers += [("Page-Id", str(page))] if page is not None else []
    if copy:
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(first, digest, 0))]
        headers += [("Refers-To-Page-Id", str(first))] if first is not None else []
    return _member(headers, block)


def _committed(system: pafs.FileSystem, root: str, name: str, parts: list[bytes]) -> tuple[int, str]:
    """Write under a name of this attempt, then rename; every attempt makes the same bytes."""
    attempt = f"{root}/_attempts/{uuid.uuid4().hex}"
    digest, total = hashlib.sha256(), 0
    system.create_dir(f"{root}/_attempts", recursive=True)
    with system.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
            digest.update(part)
            total += len(part)
    target = f"{root}/{name}"
    if system.type_name not in ("local", "mock") and system.get_file_info(target).type != pafs.FileType.NotFound:
        system.delete_file(target)
    system.move(attempt, target)
    return total, digest.hexdigest()


def _key(page: Column, digest: Column) -> Column:
    """Binary key that sorts like (page, digest) with nulls last."""
    number = F.lpad(F.hex(F.coalesce(page, F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.unhex(F.concat(F.when(page.isNull(), F.lit("01")).otherwise(F.lit("00")), number)), digest)


def write_warc(
    pages: DataFrame,
    folder: str,
    date: str = "2000-01-01T00:00:00Z",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    least: int = 0,
) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) below ``folder``; returns the stored manifest.

    Pages are sorted by (page_id, payload digest), nulls last, and cut into contiguous shards of about
    ``shard_bytes``; the cuts are (page_id, digest) keys at equal parts of the global prefix sum of payload
    bytes, so they depend on the data only, and the payloads of one id, or of none, span as many shards as
    they fill. Rows that agree in both stay together, as one of them is written whole and the others are
    headers. A shard begins a new file once the compressed records reach ``roll_bytes``. Equal input gives
    equal file names and bytes.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest page id is the
    response and the others are revisits of it (repeated rows too); smaller payloads are all responses.
    Null html is an empty payload, a null url becomes ``urn:page:<id>``, rows with a null page_id are
    written without an id; an empty table gives no file. Payloads are shuffled once; digests of
    duplicates join them as rows of their own, so equal payloads of any number never meet in a task.

    Tasks write files under names of their attempt and rename them; the manifest is committed by Spark
    and lists the files of successful tasks only, so readers never see what a lost executor left.
    The driver holds one key of 29 bytes per shard: total bytes / ``shard_bytes`` keys.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    digested = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    copies = digested.where(F.length("payload") >= least).groupBy("digest")
    copies = copies.agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    repeated = digested.where(F.length("payload") >= least).select("page_id", "digest").distinct()
    notes = repeated.join(copies, "digest").select("page_id", "digest", F.lit(True).alias("note"), "first")

    total = rows.agg(F.sum(F.length("payload") + 1)).head()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    keyed = pages.select(_key(F.col("page_id").cast("bigint"), F.unhex(F.sha1(payload))).alias("key"), "html")
    cuts = shard_by_bytes(keyed, shards, "key", "html").groupBy("shard").agg(F.min("key").alias("key"))
    bounds = sorted({bytes(r.key) for r in cuts.where("shard > 0").collect()})

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, bytes(key)) for key in keys], dtype="int32")

    held = digested.select("page_id", "digest", F.lit(False).alias("note"), F.lit(None).cast("bigint").alias("first"), "url", "payload")
    both = held.unionByName(notes, allowMissingColumns=True).withColumn("shard", shard(_key(F.col("page_id"), F.col("digest"))))
    # Notes come before the records they speak of.
    dealt = both.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(
        "shard", F.col("page_id").asc_nulls_last(), "digest", F.col("note").desc()
    )
    dealt = dealt.select("shard", "page_id", "digest", "note", "first", "url", "payload")
    place = qualified(pages.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(place)
        number, parts, size, count, files = None, [], 0, 0, 0
        noted, first, copy = None, None, 0

        def flush():
            nonlocal parts, size, count, files
            name = f"pages-{number:06d}-{files:05d}.warc.gz"
            info = f"software: repoquarry\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
            headers = [
                ("WARC-Type", "warcinfo"),
                ("WARC-Record-ID", _record_id(None, name, 0)),
                ("WARC-Date", date),
                ("WARC-Filename", name),
                ("Content-Type", "application/warc-fields"),
            ]
            written, digest = _committed(system, root, name, [_member(headers, info), *parts])
            out = (name, number, count, written, digest)
            parts, size, count, files = [], 0, 0, files + 1
            return pa.RecordBatch.from_pylist([dict(zip(_NAMES, out))], schema=_MANIFEST_ARROW)

        for batch in batches:
            for s, page, digest, note, to, url, data in zip(*(c.to_pylist() for c in batch.columns)):
                if number is not None and s != number:
                    if parts:
                        yield flush()
                    files = 0
                number = s
                if note:
                    # The response is the first row with the smallest page id.
                    noted, first, copy = (page, digest), to, int(page != to)
                    continue
                known = noted == (page, digest)
                packed = record(page, url, data, first, copy if known else 0, date)
                copy += known
                parts.append(packed)
                size += len(packed)
                count += 1
                if size >= roll_bytes:
                    yield flush()
        if parts:
            yield flush()

    manifest = f"{folder.rstrip('/')}/manifest"
    dealt.mapInArrow(write, _MANIFEST).write.parquet(manifest)
    return dealt.sparkSession.read.schema(_MANIFEST).parquet(manifest)


_NAMES = ["file", "shard", "records", "bytes", "sha256"]
_MANIFEST_ARROW = pa.schema(
    [("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
)


def _inflated(stream) -> Iterator[bytes]:
    """The gzip members of a file, one whole record each."""
    unpack, held = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            held.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(held)
                unpack, held = zlib.decompressobj(31), []
    if any(held):
        raise ValueError("a WARC file ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields with lower-case names, and the block."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All response and revisit records of the files in the manifest, digests checked.

    One task reads a file record by record. ``payload_bytes`` and ``payload_digest`` are of the full
    payload for both types. A block or payload that differs from its digest is an error.
    """
    place = qualified(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(place)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in _inflated(stream):
                        fields, block = parse(member)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: block of {fields['warc-record-id']} differs from its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and (len(payload), base32_sha1(payload)) != (length, digest):
                            raise ValueError(f"{name}: payload of {fields['warc-record-id']} differs from its digest")
                        page, to = (fields.get(k) for k in ("page-id", "refers-to-page-id"))
                        rows.append(
                            (
                                None if page is None else int(page),
                                fields["warc-target-uri"],
                                length,
                                digest,
                                fields["warc-type"],
                                None if to is None else int(to),
                            )
                        )
                        if len(rows) >= 10000:
                            yield _record_batch(rows)
                            rows = []
                if rows:
                    yield _record_batch(rows)

    files = spark.read.schema(_MANIFEST).parquet(f"{folder.rstrip('/')}/manifest").select("file")
    # As many tasks as files: Spark would merge them by the size of the manifest's rows.
    return files.repartition(max(1, files.count()), "file").mapInArrow(read, _RECORDS)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [field.split()[0] for field in _RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
