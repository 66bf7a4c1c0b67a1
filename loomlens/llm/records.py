"""Token-id output as length-delimited binary records with a separate offset index.

Record frame (the public TFRecord frame, all little-endian):
    uint64 length | uint32 masked CRC-32C of the length | payload | uint32 masked CRC-32C of the payload
Payload: int64 doc_id | uint8 null flag of doc_id | uint8 bytes per id | uint32 number of ids | ids.
Index file: per record uint64 offset of its frame, uint64 length of its frame.

Defined cases: null text is an empty text (its record holds the end id alone); a
null doc_id sorts first and comes back null; repeated doc_ids or rows are each
written, ordered by doc_id and then a hash of the text; an empty table gives no record and no file;
other columns of the input, whatever their names, are not read.

Plan: one range exchange on doc_id (the files must be in id order; ties are split by
text and place, so a very common id takes many files), into files that follow the
input's size, one task per file for encoding and writing, a running sum over one row per file, one task per
file for reading. Tasks hold one slice of documents at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, SharedWriter, even, shared_fs, slices
from .tokens import Encoder

_HEAD = struct.Struct("<qBBI")
_MASK_DELTA = 0xA282EAD8
_POLY = 0x82F63B78
_BLOCK = 1024
FILE_BYTES, MOST_FILES = 256 << 20, 1 << 20  # of input for each file


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t


def _word_tables() -> list[np.ndarray]:
    """tables[k][b]: what byte b leaves in the register after k more zero bytes."""
    base = _byte_table()
    tables = [base]
    for _ in range(3):
        prev = tables[-1]
        tables.append((prev >> 8) ^ base[prev & 0xFF])
    return tables


_T = _word_tables()


def _apply(tables: list[np.ndarray], r: np.ndarray) -> np.ndarray:
    return tables[0][r & 0xFF] ^ tables[1][(r >> 8) & 0xFF] ^ tables[2][(r >> 16) & 0xFF] ^ tables[3][r >> 24]


def _zeros_operator() -> list[list[np.ndarray]]:
    """operator[k]: four byte tables that advance a register over 2**k zero bytes."""
    base = _T[0]

    def one(r):
        return (r >> 8) ^ base[r & 0xFF]

    bytes_ = np.arange(256, dtype=np.uint32)
    op = [one(bytes_ << np.uint32(8 * i)) for i in range(4)]
    powers = [op]
    for _ in range(40):
        op = [_apply(op, t) for t in op]
        powers.append(op)
    return powers


_ZEROS = _zeros_operator()


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings at once: blocks of all strings advance in
    lockstep, then each string's blocks are folded together."""
    n = np.array([len(p) for p in parts], np.int64)
    blocks = -(-n // _BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    buffer = np.zeros(int(first[-1]) * _BLOCK, np.uint8)
    for p, end in zip(parts, first[1:], strict=True):  # zeros in front leave a zero register as it is
        buffer[end * _BLOCK - len(p) : end * _BLOCK] = np.frombuffer(p, np.uint8)
    register = np.zeros(int(first[-1]), np.uint32)
    for word in np.ascontiguousarray(buffer.view("<u4").reshape(-1, _BLOCK // 4).T):
        x = register ^ word
        register = _T[3][x & 0xFF] ^ _T[2][(x >> 8) & 0xFF] ^ _T[1][(x >> 16) & 0xFF] ^ _T[0][x >> 24]
    total = np.zeros(len(parts), np.uint32)
    step = _ZEROS[_BLOCK.bit_length() - 1]
    for j in range(int(blocks.max(initial=0)), 0, -1):
        has = np.flatnonzero(blocks >= j)
        total[has] = _apply(step, total[has]) ^ register[first[has + 1] - j]
    start = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    for k in range(int(n.max(initial=0)).bit_length()):
        has = np.flatnonzero((n >> k) & 1)
        start[has] = _apply(_ZEROS[k], start[has])
    return total ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint64)
    return ((((crc >> np.uint64(15)) | (crc << np.uint64(17))) + np.uint64(_MASK_DELTA)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def frame(payloads: list[bytes]) -> list[bytes]:
    if not payloads:
        return []
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(sizes)), masked(crc32c(payloads))
    return [s + h.tobytes() + p + t.tobytes() for s, h, p, t in zip(sizes, heads, payloads, tails, strict=True)]


def unframe(frames: list[bytes]) -> list[bytes]:
    """Payloads of whole frames; raises ValueError for any damaged one."""
    if not frames:
        return []
    sizes = [f[:8] for f in frames]
    payloads = [f[12:-4] for f in frames]
    if any(len(f) < 16 or struct.unpack("<Q", s)[0] != len(p) for f, s, p in zip(frames, sizes, payloads, strict=True)):
        raise ValueError("record length does not fit its frame")
    if any(f[8:12] != h.tobytes() for f, h in zip(frames, masked(crc32c(sizes)), strict=True)):
        raise ValueError("checksum of a record length does not match")
    if any(f[-4:] != t.tobytes() for f, t in zip(frames, masked(crc32c(payloads)), strict=True)):
        raise ValueError("checksum of a record does not match")
    return payloads


def pack_record(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is None, width, len(ids) // width) + ids


def parse_record(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width, n = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)
    if len(ids) != n:
        raise ValueError("a record holds fewer ids than it says")
    return (None if null else doc_id), ids


def read_frames(uri: str, index_uri: str, some: list[int] | None = None, per_read: int = 8 << 20) -> Iterator[list[bytes]]:
    """Frames of a file by its index, in runs of at most about `per_read` bytes: all
    in order, or those at the positions `some` in that order (a shuffled read)."""
    fs, path = shared_fs(uri)
    ifs, ipath = shared_fs(index_uri)
    with ifs.open_input_stream(ipath) as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    with fs.open_input_file(path) as f:
        if some is not None:
            for i in some:
                yield [f.read_at(int(index[i, 1]), int(index[i, 0]))]
            return
        i = 0
        while i < len(index):
            j = max(i + 1, int(np.searchsorted(index[:, 0] + index[:, 1], index[i, 0] + per_read, "right")))
            data = f.read_at(int(index[j - 1].sum() - index[i, 0]), int(index[i, 0]))
            yield [data[a : a + n] for a, n in zip((index[i:j, 0] - index[i, 0]).tolist(), index[i:j, 1].tolist(), strict=True)]
            i = j


MANIFEST = "shard long, path string, index_path string, n_docs long, n_tokens long, n_bytes long"


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file written: files follow one another in ascending doc_id order.
    Equal ids are dealt over files by their text, and equal rows by their place."""
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the planner's estimate
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // FILE_BYTES), MOST_FILES))
    ties = [F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_place")]
    ordered = rows.select("*", *ties).repartitionByRange(files, "doc_id", "_tie", "_place").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.of(tokenizer_path), TaskContext.get().partitionId()
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        out, at = None, []
        n_tokens = 0
        for batch in batches:
            for part in slices(batch):
                if out is None:
                    out = SharedWriter(f"{folder}/shard-{shard:08d}.rec")
                ids = [x.tobytes() + end for x in encoder.ids(part.column(1).to_pylist())]
                n_tokens += sum(map(len, ids)) // width
                for f in frame([pack_record(d, x, width) for d, x in zip(part.column(0).to_pylist(), ids, strict=True)]):
                    at.append((out.write(f), len(f)))
        if out is not None:
            index = SharedWriter(f"{folder}/shard-{shard:08d}.idx")
            index.write(np.array(at, "<u8").tobytes())
            index.commit()
            size = out.commit()
            row = {"shard": [shard], "path": [f"{folder}/shard-{shard:08d}.rec"], "index_path": [f"{folder}/shard-{shard:08d}.idx"], "n_docs": [len(at)], "n_tokens": [n_tokens], "n_bytes": [size]}
            yield pa.RecordBatch.from_pydict(row)

    return ordered.mapInArrow(write, MANIFEST)


def read_records(manifest: DataFrame, n_files: int, with_ids: bool = False) -> DataFrame:
    """Rows of the records in `manifest` (which needs `base`, the ids in earlier files)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["base"]
                for frames in read_frames(row["path"], row["index_path"]):
                    out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                    for payload in unframe(frames):
                        doc_id, ids = parse_record(payload)
                        out["doc_id"].append(doc_id)
                        out["start"].append(start)
                        out["n_tokens"].append(len(ids))
                        out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                        if with_ids:
                            out["ids"].append(ids.astype(np.int64))
                        start += len(ids)
                    types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int64())}
                    yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in out.items()], names=list(out))

    return even(manifest.select("path", "index_path", "base"), n_files).mapInArrow(read, schema)


def token_records(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Writes every document as a record and reads the files back."""
    scratch = Scratch(spark, "records")
    manifest = scratch.save(write_records(docs, tokenizer_path, end_id, folder or scratch.path("files")), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return read_records(based, manifest.count(), with_ids)
