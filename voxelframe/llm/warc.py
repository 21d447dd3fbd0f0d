"""WARC archives: written by tasks, indexed, and read back by byte ranges."""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm._store import written

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A hot payload's pages are dealt over this many tasks.
SALTS = 32


def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI, and the path in it; Hadoop's names of object stores are taken too."""
    for given, plain in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://")):
        folder = folder.replace(given, plain, 1) if folder.startswith(given) else folder
    return pa.fs.FileSystem.from_uri(folder)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member. The block is an HTTP response; a revisit's has its head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(3, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _parsed(member: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """Headers, length of the full payload, payload (None: a revisit)."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    return headers, size, payload if headers["WARC-Type"] == "response" else None


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 64 << 20, date: str | None = None) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html) and return the index, itself a written table.

    The payload is html in UTF-8, empty for null. Of records with equal payloads of at least least_bytes bytes, that
    with the largest page_id is the response and the others revisit it (rows that repeat that page_id stay responses, as
    do rows none of whose copies has a page_id); smaller payloads are all responses. The index has a row for each record:
    page_id, url, payload_digest, record_type, refers_to, archive, offset, length. Further columns are left out. An
    archive is one task attempt's: what a lost or repeated attempt wrote is in no index. Archives roll at archive_bytes.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        task, number, out, at = TaskContext.get(), 0, None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, at, number = store.open_output_stream(f"{top}/{name}", compression=None), 0, number + 1
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                record = _record(page_id, url, html.encode(), digest, refers_to, date)
                out.write(record)
                rows.append((page_id, url, digest, "response" if refers_to is None else "revisit", refers_to, name, at, len(record)))
                at += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), INDEX_TYPES, strict=True)] if rows else [pa.array([], t) for t in INDEX_TYPES], names=INDEX_NAMES)
        if out is not None:
            out.close()

    store, top = _store(folder)
    store.create_dir(top, recursive=True)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
    shared = shared.select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = rows.join(shared.withColumn("salt", F.col("salt").cast("long")), ["digest", "salt"], "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return written(known.select("page_id", "url", "html", "digest", refers_to.alias("refers_to")).mapInArrow(write, INDEX), "warc-index")


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
INDEX_TYPES = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]


def read_warc(index: DataFrame, folder: str, with_payload: bool = True, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records that the rows of `index` name: (page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    Index rows are dealt by archive and stretch, sorted by offset, and neighbouring ranges whose gap is small are
    read at once, up to `most` bytes; there is a task for each `most` bytes of records. `folder` is a URI of a store that
    Arrow opens (file, s3, gs, hdfs, abfss). A response's digest and length are counted from its payload; a payload that
    doesn't fit its own header is an error. A revisit has the full payload's digest and length in its headers, and a null
    payload. An empty index gives no rows.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def reads(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        held: tuple | None = None
        for archive, offset, length in rows:
            if held and held[0] == archive and offset - held[2] <= gap and offset + length - held[1] <= most:
                held[3].append((offset, length))
                held = (archive, held[1], max(held[2], offset + length), held[3])
            else:
                if held:
                    yield held
                held = (archive, offset, offset + length, [(offset, length)])
        if held:
            yield held

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        opened, file = "", None
        listed = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        for archive, begin, end, members in reads(listed):
            if archive != opened:
                if file is not None:
                    file.close()
                opened, file = archive, store.open_input_file(f"{top}/{archive}")
            block = file.read_at(end - begin, begin)
            rows = []
            for offset, length in members:
                headers, size, payload = _parsed(block[offset - begin : offset - begin + length])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if payload is not None and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"record at {offset} of {archive} doesn't fit its digest")
                number = lambda x: int(x) if (x := headers.get(x, "")[10:-1]) else None
                rows.append((number("WARC-Record-ID"), size, digest, headers["WARC-Type"], number("WARC-Refers-To"), *[payload] * with_payload))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if file is not None:
            file.close()

    stretch = F.expr(f"offset div {most}")
    tasks = max(1, -(-int(index.agg(F.sum("length")).first()[0] or 0) // most))  # by the records' bytes: the index rows are small
    dealt = index.select("archive", "offset", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(read, RECORDS + ", payload binary" * with_payload)
