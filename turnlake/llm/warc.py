"""WARC archives: one gzip member a record, written to shared storage and read back record by record.

Writing: each task appends its rows' records to an archive of its own, under a temporary name that it gives up for the final
one when whole, so a lost or repeated task leaves no torn archive. Equal payloads of at least DEDUP_BYTES are stored
once, under the page with the largest id; the others are revisit records that refer to it.

Reading is sequential: bytes go through one zlib decompressor a member; the header block ends at the blank line, the body
has Content-Length bytes and two line ends follow; digests of block and payload are verified, and any fault is an error
with the place where the record starts. Neither side holds more than one record and one buffer."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import materialise, shared_dir, skew_lookup, table

DEDUP_BYTES = 1000
BUFFER = 1 << 18
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
REREAD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    pass


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = 6) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone (Content-Length still tells the payload's)."""
    block = HTTP % len(payload) + (b"" if revisit else payload)
    heads = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        heads += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    heads.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(file: BinaryIO, buffer: int = BUFFER) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member, decompressed as it is read."""
    at, rest = 0, b""
    while True:
        rest = rest or file.read(buffer)
        if not rest:
            return
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not rest and not (rest := file.read(buffer)):
                raise WarcError(f"member at {at} is cut off")
            try:
                parts.append(z.decompress(rest))
            except zlib.error as e:
                raise WarcError(f"member at {at}: {e}") from None
            used += len(rest) - len(z.unused_data)
            rest = z.unused_data
        yield at, b"".join(parts)
        at += used


def parse(at: int, data: bytes) -> dict:
    """A record's header fields (lower-case names) and its block; framing and block digest are verified."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise WarcError(f"record at {at} has no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields.get("content-length", -1))
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"record at {at}: {len(rest) - 4} bytes, {size} by its Content-Length")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _digest(block):
        raise WarcError(f"record at {at}: wrong block digest")
    return fields | {"block": block}


def read_records(file: BinaryIO) -> Iterator[tuple]:
    """Rows as REREAD. payload is null for revisits; payload_bytes and payload_digest are the full payload's."""
    for at, data in members(file):
        r = parse(at, data)
        head, _, payload = r["block"].partition(b"\r\n\r\n")
        length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        kind = r["warc-type"]
        digest = base64.b32decode(r["warc-payload-digest"].partition(":")[2])
        if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
            raise WarcError(f"record at {at}: wrong payload digest or length")
        page, refers = r["warc-page-id"], r.get("warc-refers-to-page-id")
        yield (int(page) if page else None, r["warc-target-uri"], length, digest.hex(), kind, int(refers) if refers else None, payload if kind == "response" else None)


def _filesystem(uri: str):
    """The storage and path of a folder; file, hdfs, s3 and gs addresses."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def with_revisits(pages: DataFrame, least: int = DEDUP_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: equal payloads of at least `least` bytes refer to the largest page_id.

    Rows that repeat that page_id are responses, too. Null html is an empty payload; null page_ids are never referred to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    small = rows.where(F.octet_length("payload") >= least).select("digest", "page_id")
    groups = small.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null")
    groups = materialise(groups, "payload-groups")
    got = skew_lookup(rows, "digest", groups.select("digest", "last"), groups.select("digest", "n"), groups.agg(F.sum("n")).first()[0] or 1)
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return got.select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives to the shared `folder`; returns path, records, bytes of each (as many as tasks, not as rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex  # a repeated task writes another file; only the task that counts reports its own
        part, n, size = f"{root}/{name}.part", 0, 0
        with fs.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for page_id, url, payload, refers_to, revisit in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    data = record(page_id, url, payload.encode(), refers_to, revisit)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        final = f"{root}/{name}.warc.gz"
        fs.move(part, final)
        yield pa.RecordBatch.from_pydict({"path": [name + ".warc.gz"], "records": [n], "bytes": [size]})

    done = with_revisits(pages).mapInArrow(run, "path string, records long, bytes long")
    return materialise(done.where("records > 0"), "archives")


def read_archives(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """All records of the listed archives, a task for each few archives. Without `payload`, its column is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        names = [f.split()[0] for f in REREAD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        keep = len(names) if payload else len(names) - 1
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{path}", compression=None) as file:
                    rows, size = [], 0
                    for r in read_records(file):
                        rows.append(r[:keep])
                        size += len(r[6] or b"") if payload else 0
                        if len(rows) >= 2000 or size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names[:keep])
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names[:keep])

    tasks = max(1, min(archives.count(), 10_000))
    schema = REREAD if payload else REREAD.rpartition(", ")[0]
    return archives.select("path").repartition(tasks).mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives under the shared folder and read back. Empty table: no archives, no rows."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    got = read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder, payload=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d from pages),
g as (select d, max(page_id) last, count(*) c from p where n >= 1000 group by d)
select page_id, cast(n as bigint) payload_bytes, d payload_digest,
  case when n >= 1000 and page_id < g.last then 'revisit' else 'response' end record_type,
  case when n >= 1000 and page_id < g.last then g.last end refers_to
from p left join g using (d)
"""
