"""Packing of token sequences by cutting-stock column generation.

Documents are cut into whole sequences of `capacity` ids, one piece whose length
is a multiple of `grid`, and a tail under `grid`; so at most capacity/grid + grid
lengths exist, whatever the number of documents. Over that histogram a linear
program picks patterns (multisets of lengths that fit one sequence): a knapsack
dynamic program prices new columns until none improves it. Patterns are rounded
down, what is left is packed first-fit by falling length, and the pieces of each
length, ranked over all documents, fill the patterns' places in order.

Defined cases: null or empty text is the end id alone; a null doc_id is kept;
repeated doc_ids or rows are each packed; an empty table gives no piece; other
columns of the input, whatever their names, are not read.

Plan: one narrow pass encodes and cuts (texts are never shuffled); ranks come from
windows over (length, salt) and a running sum over the table of their counts, so
one very common length (of equal rows, too) spreads over `salts` tasks, more with
more pieces; the table of bases is broadcast if it has at most BROADCAST_ROWS rows by
construction; only the histogram
(at most capacity/grid + grid rows) reaches the driver.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices
from .tokens import Encoder

GRID = 64
SALTS = 64
ROWS_PER_SALT = 1_000_000
BROADCAST_ROWS = 200_000


def cuts(n: int, capacity: int, grid: int) -> list[int]:
    full, rest = divmod(n, capacity)
    tail = rest % grid
    return [capacity] * full + [x for x in (rest - tail, tail) if x]


def best_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of lengths within capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = lengths <= c
        gain = np.where(fit, best[np.maximum(c - lengths, 0)] + values, 0.0)
        i = int(gain.argmax())
        best[c], took[c] = best[c - 1], -1
        if gain[i] > best[c] + 1e-12:
            best[c], took[c] = gain[i], i
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= lengths[took[c]]
    return float(best[capacity]), pattern


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, limit: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Optimal basis (patterns as columns) and its real-valued counts. Should `limit`
    steps not reach the optimum, the gap is warned of; the basis packs all the same."""
    basis, value = np.diag(capacity // lengths).astype(float), np.inf
    for _ in range(limit):
        amount = np.linalg.solve(basis, demand.astype(float))
        price = np.linalg.solve(basis.T, np.ones(len(lengths)))
        value, pattern = best_pattern(lengths, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, pattern.astype(float))
        can = direction > 1e-9
        if not can.any():
            break
        ratio = np.where(can, np.maximum(amount, 0) / np.where(can, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    else:
        warnings.warn(f"packing stopped short of the optimum: at most {value - 1:.2%} more sequences than it", stacklevel=2)
    return basis.round().astype(np.int64), np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Segments (length, first rank, pieces, first sequence, pieces in each
    sequence, offset of the first of them) that place every rank, and the number
    of sequences."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    patterns: list[tuple[dict[int, int], int]] = []
    if left.get(capacity):
        patterns.append(({capacity: 1}, left.pop(capacity)))
    lengths = np.array(sorted(left, reverse=True), np.int64)
    if len(lengths):
        demand = np.array([left[int(x)] for x in lengths], np.int64)
        basis, amount = column_generation(lengths, demand, capacity)
        for j in np.argsort(-amount, kind="stable"):
            column = basis[:, j]
            used = column > 0
            if not used.any():
                continue
            n = min(int(np.floor(amount[j] + 1e-6)), int((demand[used] // column[used]).min()))
            if n > 0:
                demand = demand - n * column
                patterns.append(({int(x): int(k) for x, k in zip(lengths, column, strict=True) if k}, n))
        open_: list[tuple[int, dict[int, int]]] = []  # room, content; a number of bins that the basis bounds
        for x, k in zip(lengths.tolist(), demand.tolist(), strict=True):
            for _ in range(k):
                for b, (room, content) in enumerate(open_):
                    if room >= x:
                        content[x] = content.get(x, 0) + 1
                        open_[b] = (room - x, content)
                        break
                else:
                    open_.append((capacity - x, {x: 1}))
        patterns += [(content, 1) for _, content in open_]
    segments, next_rank, sequence = [], {}, 0
    for content, n in patterns:
        offset = 0
        for x in sorted(content, reverse=True):
            k = content[x]
            segments.append((x, next_rank.get(x, 0), n * k, sequence, k, offset))
            next_rank[x] = next_rank.get(x, 0) + n * k
            offset += k * x
        sequence += n
    return segments, sequence


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, grid: int = GRID, with_ids: bool = False, slots: int | None = None) -> DataFrame:
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _nr long" + (", ids array<long>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, nr = Encoder.of(tokenizer_path, slots), 0
        for batch in batches:
            for part in slices(batch):
                rows = [[] for _ in range(7)]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    start = 0
                    for n in cuts(len(ids), capacity, grid):
                        piece = ids[start : start + n]
                        for column, x in zip(rows, (doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), nr, piece.astype(np.int64) if with_ids else None), strict=True):
                            column.append(x)
                        start += n
                        nr += 1
                arrays = [pa.array(x, pa.int64()) for x in rows[:6]] + ([pa.array(rows[6], pa.list_(pa.int64()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_nr", "ids"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def place(scratch: Scratch, cut: DataFrame, capacity: int, salts: int = SALTS, grid: int = GRID) -> DataFrame:
    """Adds sequence_id and offset to the (materialised) pieces."""
    salts = max(salts, cut.count() // ROWS_PER_SALT + 1)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_nr"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.save(counts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "ranks")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    segments, _ = plan(histogram, capacity)
    table: dict[int, np.ndarray] = {}
    for x in {s[0] for s in segments}:
        table[x] = np.array([s[1:] for s in segments if s[0] == x], np.int64)
    base = counts.select("length", "_salt", "_base")
    if (capacity // grid + grid) * salts <= BROADCAST_ROWS:  # that many rows at most
        base = F.broadcast(base)
    ranked = salted.join(base, ["length", "_salt"])
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "_nr")
    ranked = ranked.withColumn("_rank", F.col("_base") + F.row_number().over(own) - 1).drop("_salt", "_base", "_nr")
    names = [c for c in ranked.columns if c != "_rank"]
    fields = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at, rows = np.flatnonzero(length == x), table[int(x)]
                s = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                sequence[at] = s[:, 2] + (rank[at] - s[:, 0]) // s[:, 3]
                offset[at] = s[:, 4] + (rank[at] - s[:, 0]) % s[:, 3] * x
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, f"{fields}, sequence_id long, offset long")


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, grid: int = GRID, with_ids: bool = False, slots: int | None = None) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves; slots: see Encoder.of."""
    scratch = Scratch(spark, "packing")
    return place(scratch, scratch.save(pieces(docs, tokenizer_path, end_id, capacity, grid, with_ids, slots), "pieces"), capacity, grid=grid)
