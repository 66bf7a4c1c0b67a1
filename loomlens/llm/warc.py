"""WARC archives: one gzip member per record, read back sequentially.

Records with equal payloads of at least `least` bytes are written once: the one
with the smallest page_id as a response, the others as revisits that refer to it.

Defined cases: null html is an empty payload; a null url leaves the target field
out; a page_id that occurs again with the same payload as the first one's is a
response each time (the rows cannot be told apart), a null page_id is a revisit
where any row with an id has its payload and else a response; an empty table
writes no archive; other columns are not read.

Plan: digests are native and grouped with map-side sums; only digests that occur
twice or more are kept and joined back, so a payload that a third of the rows
share is one row there (the join's large side may be split by AQE). Each task
writes one archive; reading takes one task per archive and holds one record. What
was read is one narrow table; revisits are then held against their responses there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, SharedWriter, even, shared_fs

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NOT_IN_HEADER = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    x = urn.strip("<>").rpartition(":")[2]
    return None if x == "none" else int(x)


def member(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), f"Content-Length: {len(block)}".encode()])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        target = _NOT_IN_HEADER.sub(lambda m: f"%{ord(m[0]):02X}", url)
        fields.append(("WARC-Target-URI", target))
        if target != url:  # read back as it was
            fields.append(("X-Target-As-Given", base64.b64encode(url.encode()).decode()))
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", page_urn(refers_to)), ("WARC-Profile", PROFILE)]
    return member(fields, block)


def members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Content of each gzip member, decompressed piece by piece."""
    z, parts, data = None, [], b""
    while data or (data := stream.read(chunk)):
        if z is None:
            z, parts = zlib.decompressobj(31), []
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z = None
    if z is not None:
        raise ValueError("the archive ends within a record")


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; content-length says where the block ends."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its block")
    return fields, rest[:n]


def verified(content: bytes) -> tuple[dict[str, str], bytes, int]:
    """Fields, payload (empty for revisits) and the full payload's length."""
    fields, block = parse(content)
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("a block does not match its digest")
    size = int(re.search(rb"(?mi)^content-length: (\d+)", http)[1])
    if fields["warc-type"] == "response" and (len(payload) != size or fields["warc-payload-digest"] != f"sha1:{digest(payload)}"):
        raise ValueError("a payload does not match its digest")
    return fields, payload, size


def given(fields: dict[str, str]) -> str | None:
    raw = fields.get("x-target-as-given")
    return base64.b64decode(raw).decode() if raw else fields.get("warc-target-uri")


MANIFEST = "path string, n_records long, n_bytes long"


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0, date: str = "2000-01-01T00:00:00Z", scratch: Scratch | None = None) -> DataFrame:
    scratch = scratch or Scratch(spark, "warc")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    seen = rows.filter(F.octet_length("body") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    seen = scratch.save(seen.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("sha", "first"), "seen")
    joined = rows.join(seen, "sha", "left").select("page_id", "url", "body", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, path = None, 0, f"{folder}/part-{TaskContext.get().partitionId():08d}.warc.gz"
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[i].as_py() for c in batch.columns)
                out = out or SharedWriter(path)
                out.write(record(page_id, url, payload, refers_to, date))
                n += 1
        if out is not None:
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [out.commit()]})

    return joined.mapInArrow(write, MANIFEST)


def read_archives(manifest: DataFrame, n_files: int, with_payload: bool = False) -> DataFrame:
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload binary" if with_payload else "")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 7 if with_payload else 6
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = shared_fs(uri)
                rows: list[tuple] = []

                def flush():
                    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds[:width], strict=True)], names=names[:width])

                with fs.open_input_stream(path, compression=None) as f:
                    for content in members(f):
                        fields, payload, size = verified(content)
                        refers = fields.get("warc-refers-to")
                        rows.append((page_of(fields["warc-record-id"]), size, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], page_of(refers) if refers else None, given(fields), payload)[:width])
                        if len(rows) >= 500:
                            yield flush()
                            rows.clear()
                if rows:
                    yield flush()

    return even(manifest.select("path"), n_files).mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0, with_payload: bool = False) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = scratch.save(write_archives(spark, pages, scratch.path("archives"), least, scratch=scratch), "manifest")
    rows = scratch.save(read_archives(manifest, manifest.count(), with_payload), "rows")
    check_revisits(rows)
    scratch.drop("seen", "archives", "manifest")
    return rows


def check_revisits(rows: DataFrame) -> None:
    """Raises ValueError unless each revisit refers to a response of its own digest
    and length. Equal references meet before the join, so a payload that a third of
    the rows share is one row there."""
    what = ["payload_digest", "payload_bytes"]
    said = rows.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *what).distinct()
    odd = said.join(rows.filter("record_type = 'response'").select("page_id", *what), ["page_id", *what], "left_anti").limit(1).collect()
    if odd:
        raise ValueError(f"a revisit of page {odd[0].page_id} does not match its response")
