"""Compression of vectors to codes of one byte a part (product codes), in integers.

A component x counts as floor(scale * x). Vectors are cut into equal consecutive parts,
each with a codebook of its own, which starts as that part of the first vectors. Each
round assigns every part to the nearest entry (squared distance, ties to the lower
index) and moves entries to the componentwise floor of their parts' mean; entries without parts stay.

Nearest search: codebooks are kd-trees (`Tree`) that are broadcast each round; a search
of many parts at once goes down to the nearer side first and comes back to the other
for those parts alone whose bound (squared distance to its box) is not over their best
distance. Equal bounds are visited, so that among equal distances the lower index wins.
Everything is an integer: sums and results don't depend on partitions or their order.

Defined cases: vectors that are null, or that hold null or non-finite components, are
dropped; of the others the width is that of the first one (by id, then by components)
whose width is a multiple of the number of parts, and vectors of other widths are dropped; scaled components so large that
a distance might not fit 64 bits raise an error (beyond sqrt(2**61 / width), 190 million at 64 components); repeated ids are rows of their own; null ids come
last in the order that picks first entries; fewer vectors than entries give smaller codebooks; null labels are one label; an
empty table gives an empty result; other columns are not read.

Plan: integers are written once; each round is one narrow pass in which a task adds up
sums of its own, and an aggregate of parts x entries rows, which is all that reaches the
driver; assignments are written, errors added up by label map-side, and the sums joined
back by label (a hot label is split by adaptive execution; no side is held to be small).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
LEAF = 2  # entries of a leaf
ROWS = 4096  # vectors searched at once


@dataclass(frozen=True)
class Tree:
    """A kd-tree of a codebook. Node i has a box (low, high) and either the entries of a
    leaf, in rising order, or two children."""

    entries: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    leaf: list[np.ndarray | None]
    children: list[tuple[int, int] | None]

    @classmethod
    def build(cls, entries: np.ndarray, leaf: int = LEAF) -> "Tree":
        tree = cls(entries, [], [], [], [])
        if len(entries):
            tree._grow(np.arange(len(entries)), leaf)
        return tree

    def _grow(self, own: np.ndarray, leaf: int) -> int:
        node, points = len(self.low), self.entries[own]
        self.low.append(points.min(0))
        self.high.append(points.max(0))
        self.leaf.append(None)
        self.children.append(None)
        wide = self.high[node] - self.low[node]
        if len(own) <= leaf or not wide.any():
            self.leaf[node] = np.sort(own)
            return node
        order = own[np.argsort(points[:, int(np.argmax(wide))], kind="stable")]
        half = len(order) // 2
        self.children[node] = (self._grow(order[:half], leaf), self._grow(order[half:], leaf))
        return node

    def bound(self, node: int, rows: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the node's box."""
        off = np.maximum(np.maximum(self.low[node] - rows, rows - self.high[node]), 0)
        return (off * off).sum(1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, the lowest of equal ones."""
        index = np.full(len(rows), len(self.entries), np.int64)
        best = np.full(len(rows), np.iinfo(np.int64).max)
        if len(self.entries):
            self._visit(0, np.arange(len(rows)), rows, index, best)
        return index, best

    def _visit(self, node: int, who: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        if not len(who):
            return
        if self.leaf[node] is not None:
            for e in self.leaf[node]:
                off = rows[who] - self.entries[e]
                far = (off * off).sum(1)
                wins = (far < best[who]) | ((far == best[who]) & (e < index[who]))
                index[who[wins]], best[who[wins]] = e, far[wins]
            return
        a, b = self.children[node]
        to_a, to_b = self.bound(a, rows[who]), self.bound(b, rows[who])
        first = to_a <= to_b
        self._visit(a, who[first], rows, index, best)
        self._visit(b, who[~first], rows, index, best)
        back = first & (to_b <= best[who])
        self._visit(b, who[back], rows, index, best)
        back = ~first & (to_a <= best[who])
        self._visit(a, who[back], rows, index, best)


def integers(vectors: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the scaled components of the vectors that count."""
    x = F.col(vector).cast("array<double>")
    most = F.sqrt(F.lit(2.0**61) / F.greatest(F.size("x"), F.lit(1)))  # two vectors within it are at most 2**63 apart
    fits = lambda v: F.when(F.abs(v) > most, F.raise_error(F.lit("a component is too large for exact distances")).cast("long")).otherwise(v)
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("x")).filter(F.col("x").isNotNull() & finite)
    return rows.select("vec_id", "label", F.transform("x", lambda v: fits(F.floor(F.lit(float(scale)) * v))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width) if width else np.zeros((len(column), 0), np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


@dataclass(frozen=True)
class Codebooks:
    """entries: an array (entries, width of a part) for each part."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for x in part.reshape(-1)).encode()).hexdigest()

    def moved(self, sums: dict[tuple[int, int], tuple[list[int], int]]) -> "Codebooks":
        """Entries at the floor of their parts' mean; unused ones stay."""
        new = [e.copy() for e in self.entries]
        for (part, entry), (total, n) in sums.items():
            new[part][entry] = [int(s) // int(n) for s in total]  # of Python's integers: exact, rounds down
        return Codebooks(new)


def _sums(rows: DataFrame, books, width: int) -> dict[tuple[int, int], tuple[list[int], int]]:
    """Component sums and counts by part and entry. Each task sends a row for each that it met."""
    size = width // len(books.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.value
        total = [np.zeros((len(t.entries), size), np.int64) for t in trees]
        count = [np.zeros(len(t.entries), np.int64) for t in trees]
        for piece in _pieces(batches):
            v = _matrix(piece.column(0), width)
            for p, tree in enumerate(trees):
                own = np.ascontiguousarray(v[:, p * size : (p + 1) * size])
                index, _ = tree.nearest(own)
                count[p] += np.bincount(index, minlength=len(tree.entries))
                np.add.at(total[p], index, own)
        met = [(p, e) for p in range(len(trees)) for e in np.flatnonzero(count[p])]
        if met:
            flat = [int(x) for p, e in met for x in total[p][e]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * size, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in met], pa.int32()), pa.array([int(e) for _, e in met], pa.int32()), pa.array([int(count[p][e]) for p, e in met], pa.int64()), lists], names=["part", "entry", "n", "total"])

    own = rows.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    adds = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(size)]
    got = own.groupBy("part", "entry").agg(F.sum("n").alias("n"), *adds).collect()  # parts x entries rows at most
    return {(r["part"], r["entry"]): ([r[f"s{i}"] for i in range(size)], r["n"]) for r in got}


def _assigned(rows: DataFrame, books, width: int) -> DataFrame:
    """vec_id, label, code and error; a code has two hex digits for each part."""
    size = width // len(books.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            v, error, codes = _matrix(piece.column(2), width), np.zeros(piece.num_rows, np.int64), []
            for p, tree in enumerate(books.value):
                index, far = tree.nearest(np.ascontiguousarray(v[:, p * size : (p + 1) * size]))
                codes.append(index.astype(np.uint8))
                error += far
            code = [row.tobytes().hex() for row in np.stack(codes, 1)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def train(spark: SparkSession, rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int]:
    """Codebooks after the rounds, and the vectors' width. rows: vec_id, v (read once a round)."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("codes have one byte a part")
    usable = rows.filter(F.size("v") % parts == 0)
    by = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    head = usable.orderBy(*by).select(F.size("v").alias("n")).first()
    width = head["n"] if head else 0
    first = [r["v"] for r in usable.filter(F.size("v") == width).orderBy(*by).select("v").limit(entries).collect()]
    start = np.array(first, np.int64).reshape(len(first), width)
    size = width // parts
    books = Codebooks([start[:, p * size : (p + 1) * size].copy() for p in range(parts)])
    for _ in range(rounds if len(first) else 0):
        shared = spark.sparkContext.broadcast([Tree.build(e) for e in books.entries])
        books = books.moved(_sums(rows.filter(F.size("v") == width), shared, width))
        shared.unpersist()
    return books, width


def compress(spark: SparkSession, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of every vector that counts, and the codebooks."""
    scratch = Scratch(spark, "vector-codes")
    rows = scratch.save(integers(vectors, key, vector, label, scale), "integers")
    books, width = train(spark, rows, parts, entries, rounds)
    shared = spark.sparkContext.broadcast([Tree.build(e) for e in books.entries])
    found = scratch.save(_assigned(rows.filter(F.size("v") == width), shared, width), "assigned")
    scratch.drop("integers")
    sums = scratch.save(found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "sums")
    both = found.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    return both, books
