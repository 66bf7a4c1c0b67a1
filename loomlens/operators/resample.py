"""Bootstrap of rank metrics on exact scores, by merging ordered segments.

Rows are counted by (slice, score, label, weight); a cell of n equal rows is drawn a
Poisson number of times of mean n, by a hash of (seed, smallest key of the cell,
replicate), in place of draws of row numbers. Scores are never rounded: with all
scores and weights different there are as many cells as rows, and the work is rows x
replicates, as for any resampling, but it is done in NumPy on ranges of the scores:

* cells are dealt by range of (slice, score, key), so that a score which many rows
  share may lie in several parts;
* a part gives, for each replicate, the weights of positives and negatives and the won
  pairs of three segments: its lowest score, its highest one, and what lies between;
* segments of a slice are put in order and merged: won pairs add up, plus the later
  segment's positives times the negatives before it. Equal scores add up first.

Only segments x replicates numbers are exchanged. For the specificity at a sensitivity
the same totals tell in which segment a replicate's threshold lies, and a second pass
looks it up there.

Rows without score, label or weight take no part. A replicate in which a class is
missing is rejected. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shelf
from ..shipping import ship
from .order import seeded_key

BLOCK = 125  # replicates that are merged together
TABLED = 32  # means up to which draws are looked up; beyond, normal with the skewness put right
CHUNK = 1 << 18  # draws made and kept at once
PART, PARTS = 8192, 2000  # cells of a part; beyond so many parts they grow
#: Fixed values of the mixing function.
MULTIPLIER, STEP, LOW = 0x45D9F3B, 0x9E3779B1, 0xFFFFFFFF


@cache
def limits(n: int) -> tuple[int, ...]:
    """The distribution function of a Poisson variable of mean n, in units of 2**-32."""
    out, p, k, total = [], math.exp(-n), 0, 0.0
    while total < 1 - 1e-11:
        total += p
        out.append(min(LOW, int(total * 2**32)))
        k += 1
        p *= n / k
    return tuple(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A hash of numbers below 2**32 (held in 64 bits)."""
    for _ in range(2):
        h = ((h >> np.uint64(16)) ^ h) * np.uint64(MULTIPLIER) & np.uint64(LOW)
    return (h >> np.uint64(16)) ^ h


def draws(a: np.ndarray, b: np.ndarray, n: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each cell (rows) is drawn in each replicate (columns)."""
    step = replicates.astype(np.uint64) * np.uint64(STEP) & np.uint64(LOW)
    u = mixed(mixed(b.astype(np.uint64)[:, None] ^ step) ^ a.astype(np.uint64)[:, None])
    out = np.empty(u.shape)
    for k in np.unique(n):
        own = n == k
        if k <= TABLED:
            out[own] = np.searchsorted(np.array(limits(int(k)), np.uint64), u[own], "right")
        else:
            v = mixed(u[own] ^ np.uint64(MULTIPLIER))
            z = np.sqrt(-2 * np.log((u[own] + 0.5) / 2**32)) * np.cos(2 * np.pi * (v + 0.5) / 2**32)
            out[own] = np.maximum(0, np.floor(k + np.sqrt(k) * z + (z * z - 1) / 6 + 0.5))
    return out


def cells(df: DataFrame, by: list[str], seed: int, weight: str | None, key: str) -> DataFrame:
    """by, prob, y, w, n and two 32-bit numbers a, b that the draws start from."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    whole = F.col("prob").isNotNull() & F.col("y").isNotNull() & w.isNotNull()
    counted = df.filter(whole).groupBy(*by, F.col("prob").cast("double").alias("prob"), F.col("y").cast("int").alias("y"), w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("_key"))
    hashed = seeded_key(seed, F.col("_key"))
    part = lambda i: F.conv(F.substring(hashed, i, 8), 16, 10).cast("long")
    return counted.withColumns({"a": part(1), "b": part(9)})


class _Drawn:
    """The sorted cells of a slice in a part, and its weights by replicate and distinct score."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("prob", kind="stable")
        self.p, self.y, self.w = (frame[c].to_numpy() for c in ("prob", "y", "w"))
        self.a, self.b, self.n = (frame[c].to_numpy() for c in ("a", "b", "n"))
        self.starts = np.flatnonzero(np.concatenate([[True], self.p[1:] != self.p[:-1]]))
        self.scores = self.p[self.starts]

    def weights(self, replicates: np.ndarray):
        """(where, positive, negative) for pieces of the replicates, of (distinct score, replicate)."""
        wide = max(1, CHUNK // len(self.p))
        for i in range(0, len(replicates), wide):
            drawn = draws(self.a, self.b, self.n, replicates[i : i + wide]) * self.w[:, None]
            yield slice(i, i + wide), *(np.add.reduceat(drawn * (self.y == label)[:, None], self.starts, axis=0) for label in (1, 0))


def _slices(frame: pd.DataFrame, by: list[str]):
    if not by:
        yield (), frame
        return
    for name, own in frame.groupby(by, dropna=False, sort=False):
        yield tuple(None if pd.isna(x) else x for x in name), own


def _fields(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def _segments(table: DataFrame, by: list[str], replicates: int) -> DataFrame:
    """A row for each segment and block of replicates: tie tells that it is one score."""
    columns = [*by, "part", "block", "score", "tie", "pos", "neg", "won"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, own in _slices(frame, by):
            cells_ = _Drawn(own)
            last = len(cells_.scores) - 1
            for block, at in enumerate(range(0, replicates, BLOCK)):
                names = np.arange(at, min(replicates, at + BLOCK))
                sums = np.zeros((3, 3, len(names)))  # of the lowest score, the inner ones, the highest: pos, neg, won
                for where, pos, neg in cells_.weights(names):
                    p, n = pos[1:last], neg[1:last]
                    sums[:, :2, where] = [(pos[0], neg[0]), (p.sum(0), n.sum(0)), (pos[last], neg[last])]
                    sums[1, 2, where] = (p * (np.cumsum(n, 0) - n / 2)).sum(0)
                row = lambda i, tie, own: (*name, int(frame["part"].iloc[0]), block, float(cells_.scores[i]), tie, *own)  # noqa: E731, B023
                out += [row(i, True, sums[2 if i else 0]) for i in {0, last}]
                if last > 1:
                    out.append(row(1, False, sums[1]))
        return pd.DataFrame(out, columns=columns)

    schema = f"{_fields(table, by)}part int, block int, score double, tie boolean, pos array<double>, neg array<double>, won array<double>"
    return table.groupBy("part").applyInPandas(run, schema)


def _ordered(frame: pd.DataFrame) -> list[dict]:
    """Segments by rising score, those of one score added up."""
    out: list[dict] = []
    for row in frame.sort_values(["score", "tie", "part"], kind="stable").to_dict("records"):
        if out and row["tie"] and out[-1]["tie"] and out[-1]["score"] == row["score"]:
            out[-1] |= {k: out[-1][k] + row[k] for k in ("pos", "neg")}
        else:
            out.append(row)
    return out


def _areas(segments: DataFrame, by: list[str]) -> DataFrame:
    """(by, rep, value): the area under the ROC curve of each replicate."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pos = neg = won = 0.0
        for s in _ordered(frame):
            won = won + s["won"] + s["pos"] * (neg + (s["neg"] / 2 if s["tie"] else 0.0))
            pos, neg = pos + s["pos"], neg + s["neg"]
        good = (pos > 0) & (neg > 0)
        value = won[good] / (pos[good] * neg[good])
        head = {c: [frame[c].iloc[0]] * int(good.sum()) for c in by}
        return pd.DataFrame(head | {"rep": frame["block"].iloc[0] * BLOCK + np.flatnonzero(good), "value": value})

    return segments.groupBy(*by, "block").applyInPandas(run, f"{_fields(segments, by)}rep int, value double")


def _specificities(table: DataFrame, segments: DataFrame, by: list[str], sensitivity: float) -> DataFrame:
    """(by, rep, value): 1 - false positive rate at the highest threshold that reaches the sensitivity."""
    columns = [*by, "rep", "part", "value", "pos", "neg", "all_pos", "all_neg"]

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        """Values of replicates whose threshold is one score; of the others, where to look."""
        order = _ordered(frame)[::-1]
        pos, neg = (np.cumsum([s[k] for s in order], 0) for k in ("pos", "neg"))
        at = np.argmax(np.divide(pos, pos[-1], out=np.zeros_like(pos), where=pos[-1] > 0) >= sensitivity, 0)
        out, name = [], tuple(frame[c].iloc[0] for c in by)
        for r in np.flatnonzero((pos[-1] > 0) & (neg[-1] > 0)):
            i = at[r]
            p, n = (pos[i - 1, r], neg[i - 1, r]) if i else (0.0, 0.0)
            value = 1 - neg[i, r] / neg[-1, r] if order[i]["tie"] else None
            out.append((*name, int(frame["block"].iloc[0] * BLOCK + r), int(order[i]["part"]), value, p, n, pos[-1, r], neg[-1, r]))
        return pd.DataFrame(out, columns=columns)

    def look_up(cells_: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(cells_):
            return pd.DataFrame([], columns=[*by, "rep", "value"])
        of = dict(_slices(cells_, by))
        out = []
        for name, own in _slices(asked, by):
            drawn = _Drawn(of[name])
            for where, pos, neg in drawn.weights(own["rep"].to_numpy()):
                asked_ = own.iloc[where]
                # the segment's inner scores, from the highest one on
                pos, neg = np.cumsum(pos[-2:0:-1], 0) + asked_["pos"].to_numpy(), np.cumsum(neg[-2:0:-1], 0) + asked_["neg"].to_numpy()
                at = np.argmax(pos / asked_["all_pos"].to_numpy() >= sensitivity, 0)
                value = 1 - neg[at, np.arange(len(asked_))] / asked_["all_neg"].to_numpy()
                out += [(*name, int(r), float(v)) for r, v in zip(asked_["rep"], value, strict=True)]
        return pd.DataFrame(out, columns=[*by, "rep", "value"])

    head = _fields(segments, by)
    settled = segments.groupBy(*by, "block").applyInPandas(settle, f"{head}rep int, part int, value double, pos double, neg double, all_pos double, all_neg double")
    open_ = settled.filter("value is null")
    found = table.groupBy("part").cogroup(open_.groupBy("part")).applyInPandas(look_up, f"{head}rep int, value double")
    return settled.filter("value is not null").select(*by, "rep", "value").unionByName(found)


def replicate_values(df: DataFrame, by: list[str], replicates: int, seed: int, weight: str | None = None, sensitivity: float | None = None, key: str = "obs_id") -> DataFrame:
    """(by, rep, value): the weighted area under the ROC curve of each replicate, or,
    with a sensitivity, the specificity there."""
    ship(df.sparkSession)
    shelf = Shelf(df.sparkSession, "bootstrap")
    counted = shelf.keep(cells(df, by, seed, weight, key), "counted")
    n = counted.count()
    parts = () if n <= PART else (min(PARTS, -(-n // PART)),)  # a stated number, as small tables would be put into one task
    dealt = counted.repartitionByRange(*parts, *by, "prob", "_key")
    table = shelf.keep(dealt.withColumn("part", F.spark_partition_id()).drop("_key"), "cells")
    segments = shelf.keep(_segments(table, by, replicates), "segments")
    return _areas(segments, by) if sensitivity is None else _specificities(table, segments, by, sensitivity)


def bootstrap(df: DataFrame, by: list[str], replicates: int, seed: int, weight: str | None = None, sensitivity: float | None = None, key: str = "obs_id") -> DataFrame:
    """Per slice `by`: 2.5 and 97.5 % linear quantiles over the replicates and their number."""
    values = replicate_values(df, by, replicates, seed, weight, sensitivity, key)
    return values.groupBy(*by).agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count(F.lit(1)).alias("n_replicates"))
