"""Shared helpers of the training-data operators: tables, scratch space, shared files."""

from __future__ import annotations

import atexit
import ctypes
import os
import posixpath
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that
    is unset, a temporary folder if all runs in one process, and an error if not."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="loomlens-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return f"file://{_own_root[0]}"


class Scratch:
    """A folder of this call inside the shared root. `save` writes a table there
    and reads it back, which cuts the lineage at files that outlive executors.

    Lifetime: results of an operator read tables of its folder, so it stays until the
    result is used. Operators drop the tables that their result does not read; the
    folder itself goes with `close`, with the end of a `with` block, or with the
    folder in spark.checkpoint.dir (a temporary one goes when the process ends)."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """While this one table is written, Arrow batches hold BATCH_ROWS rows: rows
        carry whole texts or sets, and an executor holds several batches at a time.
        The session's own setting is back when it returns."""
        schema, conf = df.schema, self.spark.conf
        before = conf.get(_BATCH)
        conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            conf.set(_BATCH, before)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _delete(self, uri: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        self._delete(self.uri)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def shared_fs(uri: str):
    """(pyarrow file system, path) of a URI; usable on driver and executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class SharedWriter:
    """Binary file in the shared folder that appears under its name only when it
    is complete: a lost or repeated task never leaves a torn file there."""

    def __init__(self, uri: str):
        self.fs, self.final = shared_fs(uri)
        self.temp = f"{self.final}.{uuid.uuid4().hex[:8]}.tmp"
        self.fs.create_dir(posixpath.dirname(self.final), recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Returns where the data begin."""
        begin = self.at
        self.out.write(data)
        self.at += len(data)
        return begin

    def commit(self) -> int:
        self.out.close()
        self.fs.move(self.temp, self.final)
        return self.at


def even(df: DataFrame, rows: int) -> DataFrame:
    """Deals a few heavy rows (one per file) evenly over tasks."""
    return df.repartition(max(1, min(rows, 20_000)))


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not the GNU C library

    def _trim(pad: int) -> None: ...


def slices(batch: pa.RecordBatch, rows: int = 256, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch of at most `rows` rows and about `size` bytes of text
    (one row at least); memory that the C library or Arrow keeps goes back after the batch."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            weight += np.asarray(pc.fill_null(pc.binary_length(column), 0))
    total, i = np.cumsum(weight), 0
    while i < batch.num_rows:
        before = total[i - 1] if i else 0
        j = max(i + 1, min(i + rows, int(np.searchsorted(total, before + size, "right"))))
        yield batch.slice(i, j - i)
        i = j
    _trim(0)
    pa.default_memory_pool().release_unused()


_resident: dict = {}


def resident(key: tuple, build: Callable[[], object]) -> object:
    """The one large object that a worker process keeps between tasks: workers are
    used again by other operators, whose own object then takes its place."""
    key = (os.getpid(), *key)
    if key not in _resident:
        _resident.clear()
        _resident[key] = build()
    return _resident[key]


class Bloom:
    """A filter of keys of at most 2**most bits (16 MB by default), whatever their
    number: never misses one of them, and lets few others pass (1.4 % at 16 bits a
    key, 0.1 % at 64; all of them, at worst, if there are far more keys than bits). Native: bits
    are set by an aggregate, and looked up in an array that a scalar subquery holds;
    only words of the filter reach the driver, never keys."""

    LEAST, MOST = 16, 27

    def __init__(self, keys: DataFrame, column: str, bits: int = 16, most: int = MOST):
        self.log = min(most, max(self.LEAST, (bits * keys.count()).bit_length()))
        places = F.array(*(self._place(F.col(column), i) for i in range(2)))
        at = keys.filter(F.col(column).isNotNull()).select(F.explode(places).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
        got = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        words = np.zeros(1 << (self.log - 6), np.int64)
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
        offsets = pa.array([0, len(words)], pa.int32())
        self.words = keys.sparkSession.createDataFrame(pa.table({"words": pa.ListArray.from_arrays(offsets, pa.array(words))}))

    def _place(self, key: Column, i: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(i), key.cast("long")), 64 - self.log)

    def may_hold(self, key: Column | str) -> Column:
        """Whether the key may be one of the filter's (false for null)."""
        key = F.col(key) if isinstance(key, str) else key
        out = key.isNotNull()
        for i in range(2):
            place = self._place(key, i)
            word = F.get(self.words.scalar(), F.shiftright(place, 6).cast("int"))
            out = out & (F.getbit(word, place.bitwiseAND(63).cast("int")) == 1)
        return F.coalesce(out, F.lit(False))


def crc_bucket(n: int):
    """crc32 of the document id as text, modulo n: the rule of the fixed folds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def dual_descent(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 20, weight: np.ndarray | None = None, seed: int = 7, rows: np.ndarray | None = None) -> np.ndarray:
    """Linear hinge-loss model without intercept (append a column of ones for one)
    by dual coordinate descent: min 1/2 w.w + sum c_i max(0, 1 - y_i w.x_i).
    `rows`: the rows of x that y and weight are about (all by default)."""
    rows = np.arange(len(y)) if rows is None else rows
    n, upper = len(y), c * (np.ones(len(y)) if weight is None else weight)
    alpha, w = np.zeros(n), np.zeros(x.shape[1])
    square = np.array([float(x[r] @ x[r]) for r in rows])
    order, rng = np.arange(n), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            if square[i] <= 0:
                continue
            v = x[rows[i]]
            gradient = y[i] * (v @ w) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * c:
            break
    return w


def logistic_scale(margin: np.ndarray, y01: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a, b of P(y=1) = 1 / (1 + exp(-(a * margin + b))), by damped Newton steps
    on smoothed targets."""
    pos, neg = float((y01 > 0).sum()), float((y01 <= 0).sum())
    target = np.where(y01 > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(beta[0]), float(beta[1])
