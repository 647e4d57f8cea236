"""WARC archives: one gzip member per record, written and read sequentially.

Writing: each task puts its records into archives of about ``archive_bytes`` in a folder of
the shared store, under names made of its partition and of its attempt, so that no attempt
touches another's files.  A table of the archives is the commit: only what it lists is read,
and it lists one attempt of each partition; files of failed attempts stay unread.
Reading: a task takes one archive at a time and decompresses it piece by piece; each gzip
member is one record, its length is checked against Content-Length and its digests against
the bytes.  Memory holds one piece and one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, small_batches, written

PIECE = 1 << 18
ARCHIVE_BYTES = 64 << 20
_ID = "urn:page:"


class WarcError(ValueError):
    """A record that breaks the framing or whose digest differs."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member: version line, headers, block, two line ends."""
    clean = [(k, re.sub(r"[\r\n]+", " ", v)) for k, v in headers]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*clean, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def response_record(record_id: str, uri: str | None, payload: bytes, digest: str) -> bytes:
    return record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), *([("WARC-Target-URI", uri)] if uri is not None else []), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")], http_head(len(payload)) + payload)


def revisit_record(record_id: str, uri: str | None, size: int, digest: str, refers_to: str) -> bytes:
    """The block has the HTTP head alone; its Content-Length is the full payload's."""
    return record_bytes([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), *([("WARC-Target-URI", uri)] if uri is not None else []), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")], http_head(size))


def members(stream) -> Iterator[bytes]:
    """The contents of each gzip member of a stream, decompressed as the bytes come."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    fresh = True
    while True:
        piece = rest or stream.read(PIECE)
        rest = b""
        if not piece:
            if not fresh:
                raise WarcError("the archive ends within a record")
            return
        fresh = False
        parts.append(inflate.decompress(piece))
        if inflate.eof:
            yield b"".join(parts)
            rest, inflate, parts, fresh = inflate.unused_data, zlib.decompressobj(31), [], True


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with lower-case names, and the block."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        raise WarcError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header line without a colon")
        headers[name.decode().strip().lower()] = value.decode().strip()
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError):
        raise WarcError("no Content-Length") from None
    if rest[n:] != b"\r\n\r\n":
        raise WarcError("the record is not as long as Content-Length says")
    block = rest[:n]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError("the block's digest differs")
    return headers, block


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, HTTP head and payload of each record; a response's payload digest is verified."""
    for data in members(stream):
        headers, block = parse_record(data)
        head, sep, payload = block.partition(b"\r\n\r\n")
        if headers.get("warc-type") == "response" and headers.get("warc-payload-digest") not in (None, f"sha1:{sha1_base32(payload)}"):
            raise WarcError("the payload's digest differs")
        yield headers, head + sep, payload


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of rows (page_id, url, html, refers_to); refers_to null: a response.

    Returns the written table (archive, records, bytes) of the archives.
    """

    def run(batches):
        from pyspark import TaskContext

        store, base = _open_fs(folder)
        store.create_dir(base, recursive=True)
        task, made, out, name, count, size = TaskContext.get(), 0, None, "", 0, 0
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    # another attempt may write too, and cut its rows differently
                    name = f"{base}/part-{task.partitionId():06d}-{made:05d}-{task.taskAttemptId()}.warc.gz"
                    out, count, size, made = store.open_output_stream(name, compression=None), 0, 0, made + 1
                payload = (row["html"] or "").encode()
                rid = f"{_ID}{'' if row['page_id'] is None else row['page_id']}"
                digest = sha1_base32(payload)
                data = response_record(rid, row["url"], payload, digest) if row["refers_to"] is None else revisit_record(rid, row["url"], len(payload), digest, f"{_ID}{row['refers_to']}")
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ""
        prefix = scheme + urlsplit(folder).netloc if scheme not in ("", "file://") else scheme
        yield pa.RecordBatch.from_arrays([pa.array([prefix + d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["archive", "records", "bytes"])

    return written(records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records bigint, bytes bigint"), "archives")


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the listed archives; a revisit's payload is null, its size and digest the full payload's."""

    def number(text: str | None) -> int | None:
        text = (text or "").strip("<>").removeprefix(_ID)
        return int(text) if text else None

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = _open_fs(archive)
                with store.open_input_stream(path, compression=None) as stream:
                    for h, head, payload in read_records(stream):
                        full = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
                        revisit = h["warc-type"] == "revisit"
                        rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), full, h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number(h.get("warc-refers-to")), None if revisit or not with_payload else payload))
                        held += len(payload) if with_payload else 0
                        if len(rows) >= 5000 or held >= 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
        yield _batch(rows)

    n = archives.count()
    return archives.select("archive").repartition(max(1, n)).mapInArrow(run, READ)


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def planned(pages: DataFrame, least_bytes: int = 0, popular: int = 1000) -> DataFrame:
    """page_id, url, html and refers_to: of equal payloads of ``least_bytes`` or more, the largest page_id is kept whole.

    Null html: an empty payload.  Null page_id: its record has no number; it revisits
    others' payloads and is never referred to.  Rows that repeat the kept page_id are
    responses as well: nothing could tell which one a revisit means.  Other columns are not read.

    Digests are compared without the payloads.  Of payloads that more than one page in
    ``popular`` has (so fewer than ``popular`` of them) the decision goes to all tasks; all
    others are decided by a join of narrow rows.  Payloads travel once, by page.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    ids = written(rows.filter(large).select("page_id", "digest"), "digests")
    groups = ids.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).filter("copies > 1 and kept is not null")
    groups = written(groups, "groups")
    many = ids.count() // popular
    hot = groups.filter(F.col("copies") > many).select("digest", F.col("kept").alias("hot"))
    rare = groups.filter(F.col("copies") <= many).select("digest", "kept")
    again = lambda kept: F.when(~F.col("page_id").eqNullSafe(F.col(kept)), F.col(kept))
    decided = ids.join(F.broadcast(hot), "digest", "left_anti").join(rare, "digest").select("page_id", "digest", again("kept").alias("refers")).filter("refers is not null").distinct()
    out = rows.join(F.broadcast(hot), "digest", "left").withColumn("hot", F.when(large, F.col("hot")))
    # pages of popular payloads need no partner: a key that none has
    own = F.when(F.col("hot").isNull() & large, F.struct(F.coalesce("page_id", F.lit(-1)).alias("p"), F.col("page_id").isNull().alias("z"), F.col("digest").alias("d"))).otherwise(F.struct(F.xxhash64("url", "page_id").alias("p"), F.lit(False).alias("z"), F.lit("").alias("d")))
    theirs = F.struct(F.coalesce("page_id", F.lit(-1)).alias("p"), F.col("page_id").isNull().alias("z"), F.col("digest").alias("d"))
    out = out.withColumn("_k", own).join(decided.select(theirs.alias("_k"), "refers"), "_k", "left")
    return out.select("page_id", "url", "html", F.coalesce(again("hot"), F.col("refers")).alias("refers_to"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_archives(planned(pages), new_path(spark, "warc"))
    return read_archives(archives, with_payload=False).drop("payload", "url")


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v[{i}] >> {15 - 5 * j}) & 31 AS INTEGER), 1)" for i in range(1, 9) for j in range(4))
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, h, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM p),
k AS (SELECT h, max(page_id) AS kept FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM b JOIN k USING (h)
"""
