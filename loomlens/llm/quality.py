"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by their log-count ratios between the classes,
brought to unit length, and a linear hinge-loss model is fitted to them by dual
coordinate descent. N-grams are of two kinds: hashed words, and runs of one to
three word shapes (case, length, digits, marks, whether a word repeats the one
before it or an earlier one). A shape run gives one indicator for each density it reaches, so a
stray line in a long text and a text full of such lines differ.

Labels are learned from at most about 2 x SAMPLE rows of each class, drawn by a hash
of doc_id from the rows that are not held out; scoring reads the text alone. The score is the chance of
label 1, scaled on a fifth of the sample that the model did not see and moved to
the classes' true shares.

Defined cases: null or empty texts have no indicator and get the model's intercept;
unlabelled rows teach nothing; with no or one class the score is that class's
share (0.5 if none); a null doc_id is never held out; repeated rows are each
scored; an empty table gives an empty result; other columns are not read.

Plan: one aggregate over labels; the drawn ids (bounded by SAMPLE) are broadcast to
the texts; one narrow pass scores. Texts are not exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, logistic_scale, resident, slices
from .neardup import mix
from .tokens import Powers

SAMPLE = 3000  # labelled rows of each class to learn from, on average
WORDS = 1 << 13
SHAPES = 1 << 12
DENSITIES = (0.0, 0.05, 0.3)
SIZE = WORDS + SHAPES * len(DENSITIES)
THRESHOLD = 0.3
_powers = Powers()

_KIND = np.zeros(256, np.int64)  # 1 lower, 2 upper, 4 digit, 8 mark of a sentence, 16 other mark
for _c in range(256):
    _KIND[_c] = 0 if _c >= 128 else 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 4 if chr(_c).isdigit() else 8 if chr(_c) in ".,;:'\"-()" else 16 if _c > 32 else 0


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct indicator numbers of a text."""
    data = np.frombuffer((text or "").encode() + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    n = len(starts)
    powers = _powers if len(data) < 1 << 21 else Powers()  # those of a huge text are not kept
    powers.need(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], out=total[1:])
    h = mix((total[ends] - total[starts]) * powers.down[starts])
    kind = _KIND[data]
    bits = np.bitwise_or.reduceat(kind, starts)
    size = np.searchsorted([3, 6, 10], ends - starts, "right")
    first = np.zeros(n, bool)
    first[np.unique(h, return_index=True)[1]] = True
    again = np.where(first, 0, 1)
    again[1:][h[1:] == h[:-1]] = 2
    shape = (bits * 4 + size) * 3 + again
    out = [(h % np.uint64(WORDS)).astype(np.int64)]
    key = np.zeros(n, np.uint64)
    for k in (1, 2, 3):
        if n < k:
            break
        key = mix(key[: n - k + 1] * np.uint64(0x9E3779B97F4A7C15) + shape[k - 1 :].astype(np.uint64) + np.uint64(1), k)
        count = np.bincount((key % np.uint64(SHAPES)).astype(np.int64), minlength=SHAPES)
        for i, least in enumerate(DENSITIES):
            out.append(WORDS + SHAPES * i + np.flatnonzero((count > 0) & (count >= least * len(key))))
    return np.unique(np.concatenate(out))


class Model:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, share: float, smoothing: float = 1.0, c: float = 1.0, epochs: int = 20):
        """share: true share of label 1."""
        self.weights, self.scale = np.zeros(SIZE + 1), (0.0, 0.0)
        if not 0 < share < 1 or len(set(labels.tolist())) < 2:
            self.scale = (0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))) if len(labels) else 0.0)
            return
        y = np.where(labels > 0, 1.0, -1.0)
        held = np.arange(len(y)) % 5 == 4
        counts = {s: np.full(SIZE, smoothing) for s in (1.0, -1.0)}
        for x, s, h in zip(rows, y, held, strict=True):
            if not h:
                counts[s][x] += 1
        ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
        def unit(x: np.ndarray) -> np.ndarray:
            v = ratio[x]
            return v / max(np.sqrt(v @ v), 1e-9)

        w, b = np.zeros(SIZE), 0.0
        alpha, rng, order = np.zeros(len(y)), np.random.default_rng(5), np.flatnonzero(~held)
        for _ in range(epochs):
            rng.shuffle(order)
            moved = 0.0
            for i in order:
                x, v = rows[i], unit(rows[i])
                new = min(max(alpha[i] - (y[i] * (w[x] @ v + b) - 1) / (v @ v + 1), 0.0), c)
                step = (new - alpha[i]) * y[i]
                if step:
                    w[x] += step * v
                    b += step
                    moved = max(moved, abs(step))
                    alpha[i] = new
            if moved < 1e-3:
                break
        self.ratio, self.w, self.b = ratio, w, b
        margins = np.array([w[x] @ unit(x) + b for x in rows])
        use = held if len(set(y[held].tolist())) == 2 else ~held
        a, shift = logistic_scale(margins[use], y[use])
        drawn = (y[use] > 0).mean()
        self.scale = (a, shift + float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))))

    def score(self, x: np.ndarray) -> float:
        margin = 0.0
        if hasattr(self, "w"):
            v = self.ratio[x]
            margin = self.w[x] @ v / max(np.sqrt(v @ v), 1e-9) + self.b
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -35, 35))))


def held_out() -> Column:
    return F.coalesce(crc_bucket(5) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("y")).filter(~held_out() & F.col("y").isNotNull())
    rows = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not rows:
        return Model([], np.zeros(0), 0.5)
    ticket = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_000))
    wanted = F.lit(False)
    for y, n in rows.items():
        wanted = wanted | ((F.col("y") == y) & (ticket < int(min(1.0, sample / n) * 1_000_000 + 1)))
    drawn = known.filter(wanted).limit(2 * sample * len(rows)).persist()
    asked = {r["y"]: r["n"] for r in drawn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([indicators(t).astype("<i4").tobytes() for t in part.column(2).to_pylist()], pa.binary())], names=["doc_id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    drawn.unpersist()
    y = np.array(got.column("y").to_pylist(), int)
    there = {k: n * (y == k).sum() / max(1, asked.get(k, 0)) for k, n in rows.items()}  # labels whose documents are not in docs don't count
    share = there.get(1, 0) / max(sum(there.values()), 1e-9) if len(y) else rows.get(1, 0) / sum(rows.values())
    return Model([np.frombuffer(b.as_py(), "<i4") for b in got.column("x").combine_chunks()], y, float(share))


def assess(docs: DataFrame, model: Model, threshold: float = THRESHOLD, extra: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted, after the columns `extra` (and text)."""
    extra = [c for c in (extra or []) if c not in ("doc_id", "text", "held_out", "score", "predicted")]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    keep_text = bool(extra)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "text" or keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(("none",), lambda: None)  # frees what another operator left in this worker
        for batch in batches:
            for part in slices(batch, 128):
                scores = np.array([model.score(indicators(t)) for t in part.column(1).to_pylist()])
                own = [part.column(i) for i in range(part.num_columns) if i != 1 or keep_text]
                names = [n for i, n in enumerate(part.schema.names) if i != 1 or keep_text]
                yield pa.RecordBatch.from_arrays([*own, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return base.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"])).withColumn("held_out", held_out())
