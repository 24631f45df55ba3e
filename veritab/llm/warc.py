"""WARC archives: a writer and a splittable reader.

Writing: each partition becomes one archive of gzip members, one record a
member. Payloads are compared by SHA-1 and length; of equal payloads of at
least `revisit_from` bytes the largest page_id is written as a response, the
others as revisits that refer to it. An archive counts once its task has
committed its line in the manifest, so a task that is run again leaves an
orphan file and no double record.

Reading: archives are cut into byte ranges. A task looks for the gzip magic in
its range, takes a candidate as a member only if it inflates to a WARC header
block with a length, and owns the records that start inside the range; the
last one is read past the end of the range.

Edge cases: a null payload is empty; a null url is an empty target; a page
without id is a response and is read back with a null id; rows that repeat the
largest page_id are all responses; a damaged member is skipped by the search
for the next magic; no pages give no archives, and no archives no rows;
further columns of the pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import shared

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
CRLF = b"\r\n"
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RANGE_BYTES = 8 << 20
STEP = 1 << 20
MANIFEST = "path string, bytes bigint, records bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, archive string, archive_offset bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int) -> bytes:
    """One gzip member."""
    digest = base32_sha1(payload)
    revisit = refers_to is not None
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join([*head, "", ""]).encode("utf-8") + block + CRLF + CRLF) + deflate.flush()


def write_warc(pages: DataFrame, folder: str, revisit_from: int = 0, level: int = 1) -> DataFrame:
    """Write the pages (page_id, url, html) below folder; returns the manifest.

    folder is a URI that pyarrow opens on every executor (the shared folder).
    """
    spark = pages.sparkSession
    shared.bound_batches(spark)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")
    ).withColumns({"sha1": F.unhex(F.sha1("payload")), "bytes": F.octet_length("payload")})
    groups = (
        pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
        .filter(F.col("page_id").isNotNull() & (F.octet_length("payload") >= revisit_from))
        .groupBy(F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").alias("bytes"))
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1").drop("copies")
    )
    # inner key only: rows without copies keep null; hot payloads are split by the skew join
    linked = rows.join(groups.hint("merge"), ["sha1", "bytes"], "left").select(
        "page_id", "url", "payload", F.when(F.col("original") != F.col("page_id"), F.col("original")).alias("refers_to")
    )

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, count = None, f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    files, name = _filesystem(path)
                    files.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(name, compression=None)
                member = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), level)
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]})

    return shared.materialize(linked.mapInArrow(archive, MANIFEST), "warc-manifest")


def archives(spark: SparkSession, glob: str) -> DataFrame:
    """path and bytes of the archives that match glob, listed through Hadoop."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return spark.createDataFrame([(str(f.getPath()), f.getLen()) for f in found], "path string, bytes bigint")


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.partition(b":") for x in lines)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _content_length(head: bytes) -> int | None:
    """The length that a header block names, if it is one of a record."""
    length = _headers(head.split(CRLF)[1:]).get("content-length", "")
    return int(length) if length.isdigit() else None


def _record_at(source: BinaryIO, offset: int) -> tuple[bytes, bytes, int] | None:
    """Header block, block and end of the member at offset; None if it is damaged or no record.

    A member is inflated once. It is given up at the first bytes that are no
    version line, or where its header block, of any length, names no length.
    """
    inflate, data, at, head = zlib.decompressobj(31), bytearray(), offset, -1
    source.seek(offset)
    step = 4096  # most false candidates end here
    while not inflate.eof:
        chunk = source.read(step)
        if not chunk:
            return None
        seen, step = max(0, len(data) - len(CRLF + CRLF) + 1), STEP
        try:
            data += inflate.decompress(chunk)
        except zlib.error:
            return None
        at += len(chunk)
        if head < 0:
            if not data.startswith(VERSION[: len(data)]):
                return None
            head = data.find(CRLF + CRLF, seen)
            if head >= 0 and _content_length(bytes(data[:head])) is None:
                return None
    if head < 0:
        return None
    return bytes(data[:head]), bytes(data[head + len(CRLF + CRLF) :]), at - len(inflate.unused_data)


def records_in_range(source: BinaryIO, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of every record whose member starts in [start, end)."""
    at = start
    while at < end:
        source.seek(at)
        chunk = source.read(min(STEP, end - at) + len(MAGIC) - 1)
        found = chunk.find(MAGIC)
        if found < 0 or at + found >= end:
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        at += found
        whole = _record_at(source, at)
        if whole is None:
            at += 1
            continue
        head, block, after = whole
        yield at, _headers(head.split(CRLF)[1:]), block[: _content_length(head)]
        at = after


def _page(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").removeprefix(URN)
    return int(text) if text.lstrip("-").isdigit() else None


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the archives (path, bytes).

    A response's payload is checked against its digest. With payloads=False the
    payload column is null, for plans that need the headers only.
    """
    ranges = files.filter("bytes > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"), "bytes"
    ).select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, RECORDS.split(", "), strict=True)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files_, name = _filesystem(path)
                rows, held = [], 0
                with files_.open_input_file(name) as source:
                    for offset, headers, block in records_in_range(source, start, end):
                        kind = headers.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(CRLF + CRLF)
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        size = len(payload)
                        if kind == "revisit":
                            size = int(_headers(http.split(CRLF)[1:]).get("content-length", "0"))
                        elif base32_sha1(payload) != digest:
                            raise ValueError(f"{path} at {offset}: the payload differs from its digest")
                        rows.append((
                            _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), kind,
                            _page(headers.get("warc-refers-to")) if kind == "revisit" else None, size, digest,
                            payload if payloads and kind == "response" else None, path, offset,
                        ))
                        held += len(payload)
                        if held > 16 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    spread = ranges.repartition(shared.shuffle_partitions(files.sparkSession))  # round robin: ranges have one size
    return spread.mapInArrow(scan, RECORDS)


def require_whole(records: DataFrame, manifest: DataFrame) -> None:
    """Raise unless as many records were read from each archive as its line in the manifest says."""
    read = records.groupBy(F.col("archive").alias("path")).agg(F.count(F.lit(1)).alias("read"))
    short = manifest.join(read.hint("merge"), "path", "left").filter(F.coalesce("read", F.lit(0)) != F.col("records")).first()
    if short is not None:
        raise ValueError(f"{short['path']}: {short['read'] or 0} records read, {short['records']} written")
