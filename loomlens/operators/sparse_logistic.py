"""Penalised logistic regressions over sparse features, many at once, without the
vocabulary or the rows on the driver.

A `Problem` is one fit: a seed (which rows it trains on), a fold that is held out (or
none) and a strength. All problems share the data and run in one L-BFGS (for absolute
penalties with pseudo-gradients and projection to the orthant). Objective of a
problem: C * sum w * logloss + penalty, as |beta|^2 / 2 or |beta|_1, each feature's part
times its own factor (0: free).

The matrix is cut into blocks of rows and blocks of features. In an iteration

* each block of features takes its step and sends the coefficients that blocks of rows ask for;
* each block of rows adds up its margins, and sends back gradients of its features;
* gradients are added up (in a tree over blocks of rows), blocks of features keep the new state, and
  only dot products, (2 * PAIRS + 1)^2 numbers a problem and block, come to the driver,
  which derives from them the next direction as weights of the kept vectors.

States are tables in the shared folder, one a step; coefficients are a table at the end.

With squared penalties a feature of one single row needs no state: the row's loss, minimised over its own
features, is again a smooth convex function of the margin of the others (`settled`). Most phrases
of free text are such ones. Their coefficients are derived from the fit at the end.

Where what is left of the data is small (HELD), problems are dealt over tasks instead, which
hold it and run a problem's steps by themselves: the same functions, without a job for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Shelf
from ..shipping import ship

ROW_BLOCK = 5_000
STATE_BYTES = 16 << 20  # of a block of features, over all problems
CHUNK = 1 << 20  # products that a task holds at a time
PAIRS = 4
HELD = 24  # times STATE_BYTES: size of the data up to which a task runs whole problems
DEALT = 20  # tasks that problems are dealt over
FAN = 64  # blocks of rows whose gradients are added up by one task
FIRST_STEP = 0.25
ARMIJO = 1e-4


@dataclass(frozen=True)
class Problem:
    seed: int  # position of the seed, from 0
    fold: int  # held out; 0: none
    c: float


@dataclass(frozen=True)
class Setting:
    """What all tasks know of the problems."""

    problems: tuple[Problem, ...]
    absolute: bool
    tolerance: float
    steps: int

    @property
    def strength(self) -> np.ndarray:
        return np.array([1 / p.c if np.isfinite(p.c) else 0.0 for p in self.problems])

    def weights(self, w: np.ndarray, folds: np.ndarray) -> np.ndarray:
        """(row, problem): the row's weight where it is trained on, else 0."""
        own = folds[:, [p.seed for p in self.problems]]
        return w[:, None] * ((own > 0) & (own != np.array([p.fold for p in self.problems])))


# ---- steps: of one block of features


def pseudo(u: np.ndarray, g: np.ndarray, pull: np.ndarray | None) -> np.ndarray:
    """The gradient, or with absolute penalties `pull` the steepest one-sided slope."""
    if pull is None:
        return g
    right, left = g + pull, g - pull
    return np.where(u > 0, right, np.where(u < 0, left, np.where(right < 0, right, np.where(left > 0, left, 0.0))))


class Block:
    """State of a block of features, in coordinates that its curvature bound scales:
    u = beta * size. Arrays are (feature, problem), pairs (PAIRS, feature, problem)."""

    FIELDS = ("u", "g", "s", "y", "trial", "slope")

    def __init__(self, factor: np.ndarray, active: np.ndarray, curve: np.ndarray, setting: Setting):
        self.setting = setting
        on = active[:, [p.seed for p in setting.problems]]
        strength = setting.strength[None] * factor[:, None]
        bound = 0.25 * curve + (0 if setting.absolute else strength)
        self.size = np.where(on & (bound > 0), np.sqrt(np.maximum(bound, 1e-300)), np.inf)  # a coefficient without data or seed stays 0
        self.ridge = 0.0 if setting.absolute else np.where(np.isfinite(self.size), strength / self.size**2, 0.0)
        self.pull = np.where(np.isfinite(self.size), strength / self.size, 0.0) if setting.absolute else None
        self.strength = strength
        shape = curve.shape
        self.u, self.g, self.trial, self.slope = (np.zeros(shape) for _ in range(4))
        self.s, self.y = (np.zeros((PAIRS, *shape), np.float32) for _ in range(2))

    def beta(self, u: np.ndarray) -> np.ndarray:
        return np.divide(u, self.size, out=np.zeros_like(u), where=np.isfinite(self.size))

    def commit(self, taken: np.ndarray) -> None:
        """Problems whose trial was taken go there; their pair is kept, the oldest goes."""
        if not taken.any():
            return
        s, y = self.trial - self.u, self.slope - self.g
        self.s[:-1, :, taken], self.y[:-1, :, taken] = self.s[1:, :, taken], self.y[1:, :, taken]
        self.s[-1, :, taken], self.y[-1, :, taken] = s[:, taken].T, y[:, taken].T
        self.u[:, taken], self.g[:, taken] = self.trial[:, taken], self.slope[:, taken]

    def move(self, weights: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The trial: a step along the direction that the weights (problem, 2 * PAIRS + 1) give."""
        v = pseudo(self.u, self.g, self.pull)
        basis = [*self.s, *self.y, v]
        direction = sum(b * weights[:, i] for i, b in enumerate(basis))
        if self.pull is not None:
            direction = np.where(direction * v < 0, direction, 0.0)
        self.trial = self.u + step * direction
        if self.pull is not None:
            side = np.where(self.u != 0, np.sign(self.u), -np.sign(v))
            self.trial = np.where(np.sign(self.trial) == side, self.trial, 0.0)
        return self.beta(self.trial)

    def receive(self, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes the loss's gradient at the trial. -> dot products of the vectors as they
        are if the trial is taken, the trial's penalty, and (move . slope at the start)."""
        self.slope = np.divide(gradient, self.size, out=np.zeros_like(gradient), where=np.isfinite(self.size)) + self.ridge * self.trial
        penalty = (self.pull * np.abs(self.trial)).sum(0) if self.pull is not None else 0.5 * (self.ridge * self.trial**2).sum(0)
        moved = self.trial - self.u
        basis = [*self.s[1:], moved.astype(np.float32), *self.y[1:], (self.slope - self.g).astype(np.float32), pseudo(self.trial, self.slope, self.pull)]
        dots = np.empty((moved.shape[1], len(basis), len(basis)))
        for i, a in enumerate(basis):
            for j, b in enumerate(basis[: i + 1]):
                dots[:, i, j] = dots[:, j, i] = np.einsum("jk,jk->k", a, b, dtype=float)
        return dots, penalty, (moved * pseudo(self.u, self.g, self.pull)).sum(0)


def direction_weights(dots: np.ndarray) -> np.ndarray:
    """Weights of the kept vectors in the L-BFGS direction, from their dot products alone."""
    k, n = len(dots), 2 * PAIRS + 1
    out = np.zeros((k, n))
    out[:, -1] = -1.0
    curves = dots[:, range(PAIRS), range(PAIRS, 2 * PAIRS)]
    good = curves > 1e-12 * np.sqrt(dots[:, range(PAIRS), range(PAIRS)] * dots[:, range(PAIRS, 2 * PAIRS), range(PAIRS, 2 * PAIRS)]) + 1e-300
    inverse = np.where(good, 1 / np.where(good, curves, 1.0), 0.0)
    back = np.zeros((k, PAIRS))
    for i in reversed(range(PAIRS)):
        back[:, i] = np.einsum("kj,kj->k", out, dots[:, :, i]) * inverse[:, i]
        out[:, PAIRS + i] -= back[:, i]
    last, squares = curves[:, -1], dots[:, 2 * PAIRS - 1, 2 * PAIRS - 1]
    out *= np.where(good[:, -1], last / np.where(squares > 0, squares, 1.0), 1.0)[:, None]
    for i in range(PAIRS):
        forth = np.einsum("kj,kj->k", out, dots[:, :, PAIRS + i]) * inverse[:, i]
        out[:, i] += np.where(good[:, i], back[:, i] - forth, 0.0)
    return out


class Search:
    """The driver's side: which problems go on, how far, and in which direction."""

    def __init__(self, setting: Setting):
        k = len(setting.problems)
        self.setting = setting
        self.weights = np.zeros((k, 2 * PAIRS + 1))
        self.step = np.zeros(k)
        self.loss = np.full(k, np.inf)
        self.first: np.ndarray | None = None
        self.taken = np.zeros(k, bool)
        self.open = np.ones(k, bool)
        self.still = np.zeros(k, int)

    def learn(self, loss: np.ndarray, dots: np.ndarray, slope: np.ndarray) -> None:
        """loss: at the trial, with penalty. The first call is about the start."""
        start = self.first is None
        self.taken = self.open & np.isfinite(loss) & (np.isinf(self.loss) | (loss <= self.loss + ARMIJO * slope + 1e-13 * np.abs(self.loss)))
        norm = np.sqrt(np.maximum(dots[:, -1, -1], 0))
        if start:
            self.first = norm
        gain = np.where(np.isfinite(self.loss), self.loss - loss, np.inf)
        self.still = np.where(self.taken, np.where(gain <= 1e-11 * (1 + np.abs(loss)), self.still + 1, 0), self.still)
        fresh = direction_weights(dots)
        self.weights[self.taken] = fresh[self.taken]
        self.loss = np.where(self.taken, loss, self.loss)
        self.step = np.where(self.taken, FIRST_STEP if start else 1.0, self.step / 4)
        done = self.taken & (norm <= self.setting.tolerance * np.maximum(self.first, 1e-12)) | (self.still >= 3) | (self.step < 1e-8)
        self.open &= ~done

    @property
    def steps(self) -> np.ndarray:
        return np.where(self.open, self.step, 0.0)


# ---- blocks of rows


class Part:
    """Entries of a block of rows in a block of features, in both orders."""

    def __init__(self, r: np.ndarray, c: np.ndarray, x: np.ndarray):
        self.by = []
        for own, other in ((r, c), (c, r)):
            order = np.argsort(own, kind="stable")
            sorted_ = own[order]
            starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, int)
            self.by.append((sorted_[starts], starts, other[order], x[order]))

    def _sums(self, side: int, values: np.ndarray, size: int, square: bool = False) -> np.ndarray:
        out = np.zeros((size, values.shape[1]))
        at, starts, other, x = self.by[side]
        bounds, i = np.append(starts, len(x)), 0
        while i < len(at):  # at most CHUNK products at a time, or those of one row or column
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK // values.shape[1], "right")) - 1)
            a, b = bounds[i], bounds[j]
            own = x[a:b]
            own = own * own if square else own
            if values.shape[1] == 1:
                out[at[i:j], 0] = np.add.reduceat(own * values[other[a:b], 0], bounds[i:j] - a)
            else:
                out[at[i:j]] = np.add.reduceat(own[:, None] * values[other[a:b]], bounds[i:j] - a, axis=0)
            i = j
        return out

    def margins(self, beta: np.ndarray, rows: int) -> np.ndarray:
        return self._sums(0, beta, rows)

    def gradient(self, slope: np.ndarray, width: int, square: bool = False) -> np.ndarray:
        return self._sums(1, slope, width, square)


def row_loss(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss by problem, its slope by row and problem)."""
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return (weights * (np.logaddexp(0, z) - y[:, None] * z)).sum(0), weights * (p - y[:, None])


def settled(u: np.ndarray, room: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """d > 0 with d = room * sigmoid(-(u + d)), for room > 0: how far a row's own features move its margin u (signed
    by its label). Newton's method for log d, whose equation is convex and rising, from an upper bound or a d that was near."""
    size = np.log(room)
    q = np.minimum(size - np.logaddexp(0, u), np.log(np.logaddexp(0, size - u))) if start is None else np.log(start)
    for _ in range(60):
        d = np.exp(q)
        v = u + d
        e = np.exp(-np.abs(v))
        step = (q + np.maximum(v, 0) + np.log1p(e) - size) / (1 + d * np.where(v > 0, 1, e) / (1 + e))
        q -= step
        if not np.abs(step).max(initial=0) > 1e-13:  # in units of log d
            break
    return np.exp(q)


class Rows:
    """A block of rows: labels, weights, and what their own features allow."""

    def __init__(self, y: np.ndarray, w: np.ndarray, folds: np.ndarray, own: np.ndarray, setting: Setting):
        self.y, self.weights = y, setting.weights(w, folds)
        self.w, self.own = w, own[:, [p.seed for p in setting.problems]]
        # how far the row's own features can move it; 0 where it has none
        self.room = self.own * self.weights * np.array([p.c for p in setting.problems]) if self.own.any() else None
        self.parts, self.columns, self.near = {}, {}, {}

    @staticmethod
    def head(row: pd.Series) -> tuple[np.ndarray, ...]:
        y, w = (np.asarray(row[c], float) for c in ("y", "w"))
        return y, w, np.asarray(row["folds"], int).reshape(len(y), -1), np.asarray(row["own"], float).reshape(len(y), -1)

    @classmethod
    def of(cls, frame: pd.DataFrame, setting: Setting) -> "Rows":
        """Rebuilt from its stored frame."""
        out = cls(*cls.head(frame.iloc[0]), setting)
        for _, f in frame.iterrows():
            if f["cb"] >= 0:  # columns count from 0 among those that the block of rows has
                r, c, x, columns = (np.asarray(f[c]) for c in ("r", "c", "x", "columns"))
                out.parts[int(f["cb"])], out.columns[int(f["cb"])] = Part(r, np.searchsorted(columns, c), x), columns
        return out

    def margins(self, beta: dict[int, np.ndarray], k: int) -> np.ndarray:
        out = np.zeros((len(self.y), k))
        for cb, part in self.parts.items():
            out += part.margins(beta[cb], len(self.y))
        return out

    def moved(self, z: np.ndarray) -> np.ndarray:
        """What the rows' own features add to their margins z."""
        out, side = np.zeros(z.shape), 2 * self.y - 1
        wide = max(1, CHUNK // 16 // z.shape[1])
        for i in range(0, len(z) if self.room is not None else 0, wide):  # pieces that stay in the cache
            own, at = self.room[i : i + wide] > 0, slice(i, i + wide)
            sides = np.broadcast_to(side[at, None], own.shape)[own]
            self.near[i] = settled(sides * z[at][own], self.room[at][own], self.near.get(i))
            out[at][own] = sides * self.near[i]
        return out

    def loss(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As row_loss, with the rows' own features at their best and their penalties."""
        if self.room is None:
            return row_loss(z, self.y, self.weights)
        b = self.moved(z)
        loss, slope = row_loss(z + b, self.y, self.weights)
        return loss + 0.5 * (b * b * np.divide(self.weights, self.room, out=np.zeros(b.shape), where=self.room > 0)).sum(0), slope

    @property
    def bound(self) -> np.ndarray:
        """Four times what bounds the loss's curvature by row and problem."""
        return self.weights if self.room is None else self.weights / (1 + 0.25 * self.room)


# ---- jobs


def _bytes(a: np.ndarray, kind: type = float) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _array(b: bytes, *shape: int, kind: type = float) -> np.ndarray:
    return np.frombuffer(b, kind).reshape(*shape).copy()


class Fit:
    """rows: obs_id, y (0/1), w, folds (a fold for each seed; 0: the seed does not train on the row).
    entries: obs_id, feature, x. features: feature, factor (of its penalty), active (by seed)."""

    def __init__(self, rows: DataFrame, entries: DataFrame, features: DataFrame, problems: list[Problem], absolute: bool = False, tolerance: float = 1e-4, steps: int = 200):
        ship(rows.sparkSession)
        self.spark = rows.sparkSession
        self.setting = Setting(tuple(problems), absolute, tolerance, steps)
        self.shelf = Shelf(self.spark, "sparse-fit")
        self.seeds = 1 + max(p.seed for p in problems)
        self._lay(rows, *self._parted(entries, features))

    def _parted(self, entries: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sets apart features of one row that are penalised (`own`: feature, obs_id, x, factor, active); -> the others."""
        entries, self.own = self.shelf.keep(entries.filter("x <> 0"), "entries"), None
        if self.setting.absolute or not (self.setting.strength > 0).all():
            return entries, features
        single = entries.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("obs_id").alias("obs_id"), F.min("x").cast("double").alias("x")).filter("n = 1").drop("n")
        self.own = self.shelf.keep(single.join(features.filter("factor > 0"), "feature"), "own")
        names = self.own.select("feature")
        return entries.join(names, "feature", "left_anti"), self.shelf.keep(features.join(names, "feature", "left_anti"), "shared")

    def _lay(self, rows: DataFrame, entries: DataFrame, features: DataFrame) -> None:
        """Blocks: rows by obs_id and features by name, in hashed blocks of bounded size."""
        self.sizes = n, v, _ = rows.count(), features.count(), entries.count()
        wide = max(1, STATE_BYTES // (8 * (4 + PAIRS) * len(self.setting.problems)))
        self.row_blocks, self.feature_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-v // wide))
        place = lambda df, key, blocks, b, i: df.withColumn(b, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(i, (F.row_number().over(Window.partitionBy(b).orderBy(key)) - 1).cast("int"))
        zeros = F.array(*[F.lit(0.0)] * self.seeds)
        if self.own is None:
            rows = rows.withColumn("own", zeros)
        else:
            sums = [F.sum(F.when(F.col("active")[i], F.col("x") * F.col("x") / F.col("factor")).otherwise(0.0)) for i in range(self.seeds)]
            rows = rows.join(self.own.groupBy("obs_id").agg(F.array(*sums).alias("own")), "obs_id", "left").withColumn("own", F.coalesce("own", zeros))
        self.rows = self.shelf.keep(place(rows.select("obs_id", "y", "w", "folds", "own"), "obs_id", self.row_blocks, "rb", "r"), "rows")
        self.features = self.shelf.keep(place(features.select("feature", "factor", "active"), "feature", self.feature_blocks, "cb", "c"), "features")
        at = entries.join(self.features.select("feature", "cb", "c"), "feature").join(self.rows.select("obs_id", "rb", "r"), "obs_id")
        cells = at.groupBy("rb", "cb").agg(F.collect_list(F.struct("r", "c", "x")).alias("cells"))
        listed = F.array_sort(F.array_distinct(F.transform("cells", lambda e: e["c"])))  # the columns that the block of rows asks for
        parts = cells.select("rb", "cb", F.transform("cells", lambda e: e["r"]).alias("r"), F.transform("cells", lambda e: e["c"]).alias("c"), F.transform("cells", lambda e: e["x"].cast("double")).alias("x"), listed.alias("columns"))
        ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda e: e[c])
        heads = self.rows.groupBy("rb").agg(ordered("obs_id").alias("obs"), F.transform(ordered("y"), lambda y: y.cast("double")).alias("y"), ordered("w").alias("w"), F.flatten(ordered("folds")).alias("folds"), F.flatten(ordered("own")).alias("own"))
        none = {c: F.array().cast(f"array<{t}>") for c, t in (("r", "int"), ("c", "int"), ("x", "double"), ("columns", "int"))}
        head_rows = heads.select("rb", F.lit(-1).alias("cb"), *(none[c].alias(c) for c in none), "obs", "y", "w", "folds", "own")
        kinds = {"obs": "array<long>", "y": "array<double>", "w": "array<double>", "folds": "array<int>", "own": "array<double>"}
        part_rows = parts.select("rb", "cb", "r", "c", "x", "columns", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
        self.matrix = self.shelf.keep(head_rows.unionByName(part_rows), "matrix")
        by_column = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("c", c))), lambda e: e[c]).alias(c)
        wide = self.features.groupBy("cb").agg(by_column("factor"), by_column("active"))
        self.columns = self.shelf.keep(wide.withColumn("active", F.flatten("active")), "columns")

    # tasks that hold all data

    @property
    def small(self) -> bool:
        rows, features, entries = self.sizes
        return 100 * (rows + features) + 40 * entries <= HELD * STATE_BYTES

    def _run_whole(self) -> DataFrame:
        """A task holds the data, and takes its problems one by one."""
        setting, seeds, absolute = self.setting, self.seeds, self.setting.absolute
        deal = min(DEALT, len(setting.problems))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["rb", "cb"])
            wide, heads, parts = frame[frame["rb"] < 0], frame[(frame["rb"] >= 0) & (frame["cb"] < 0)], frame[(frame["rb"] >= 0) & (frame["cb"] >= 0)]
            if not len(wide) or not len(heads):
                return pd.DataFrame([], columns=["cb", "problem", "beta"])
            factors = [np.asarray(f, float) for f in wide["factor"]]
            factor, active = np.concatenate(factors), np.concatenate([np.asarray(a, bool).reshape(-1, seeds) for a in wide["active"]])
            told = [np.concatenate(x) for x in zip(*(Rows.head(h) for _, h in heads.iterrows()), strict=True)]
            after = lambda keys, sizes: dict(zip(keys, np.concatenate([[0], np.cumsum(sizes)]), strict=False))
            top, left = after(heads["rb"], [len(y) for y in heads["y"]]), after(wide["cb"], [len(f) for f in factors])
            joined = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(v, kind) for v in parts[c])])
            moved = lambda c, key, base: joined(c, int) + np.repeat([base[k] for k in parts[key]], [len(v) for v in parts[c]]).astype(int)
            part = Part(moved("r", "rb", top), moved("c", "cb", left), joined("x", float))
            out, n, width = [], len(told[0]), len(factor)
            for i in range(int(frame["g"].iloc[0]), len(setting.problems), deal):
                one = Setting((setting.problems[i],), absolute, setting.tolerance, setting.steps)
                rows = Rows(*told, one)
                block = Block(factor, active, part.gradient(rows.bound, width, square=True), one)
                search, trial = Search(one), np.zeros((width, 1))
                for _ in range(one.steps):
                    loss, slope = rows.loss(part.margins(trial, n))
                    dots, penalty, along = block.receive(part.gradient(slope, width))
                    search.learn(loss + penalty, dots, along)
                    block.commit(search.taken)
                    if not search.open.any():
                        break
                    trial = block.move(search.weights, search.steps)
                beta = block.beta(block.u)[:, 0]
                out += [(cb, i, _bytes(beta[a : a + len(f)])) for (cb, a), f in zip(left.items(), factors, strict=True)]
            return pd.DataFrame(out, columns=["cb", "problem", "beta"])

        def stacked(frame: pd.DataFrame) -> pd.DataFrame:
            each = [_array(b, -1) for b in frame.sort_values("problem")["beta"]]
            return pd.DataFrame([(int(frame["cb"].iloc[0]), _bytes(np.stack(each, 1)))], columns=["cb", "beta"])

        both = self.matrix.drop("obs", "columns").unionByName(self.columns.withColumn("rb", F.lit(-1)), allowMissingColumns=True)
        each = both.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(deal - 1)))).repartitionByRange(deal, "g")
        fits = self.shelf.keep(each.groupBy("g").applyInPandas(run, "cb int, problem int, beta binary"), "fits")
        return self.shelf.keep(fits.groupBy("cb").applyInPandas(stacked, "cb int, beta binary"), "beta")

    # a job for each step

    def _gathered(self, betas: DataFrame, k: int) -> DataFrame:
        """(rb, cb, beta): the coefficients that each block of rows asks for."""
        asked = self.matrix.filter("cb >= 0").select("rb", "cb", "columns")

        def pick(frames):
            for frame in frames:
                cut = [_bytes(_array(b, -1, k)[np.asarray(c, int)]) for b, c in zip(frame["beta"], frame["columns"], strict=True)]
                yield pd.DataFrame({"rb": frame["rb"], "cb": frame["cb"], "beta": cut})

        return asked.join(betas, "cb").mapInPandas(pick, "rb int, cb int, beta binary")

    def _sent(self, matrix: DataFrame, betas: DataFrame | None) -> DataFrame:
        """(rb, cb, columns, sums): gradients at the coefficients, and the loss under cb = -1.
        Without coefficients: the sums of squares that bound the curvature."""
        setting, k, bounding = self.setting, len(self.setting.problems), betas is None
        columns = ["rb", "cb", "columns", "sums"]

        def run(frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            if not len(frame):
                return pd.DataFrame([], columns=columns)
            rb, rows = int(frame["rb"].iloc[0]), Rows.of(frame.sort_values("cb"), setting)
            out, slope = [], rows.bound
            if not bounding:
                beta = {int(cb): _array(b, -1, k) for cb, b in zip(got["cb"], got["beta"], strict=True)}
                loss, slope = rows.loss(rows.margins(beta, k))
                out.append((rb, -1, [], _bytes(loss)))
            for cb, part in rows.parts.items():
                cols = rows.columns[cb]
                out.append((rb, cb, cols.tolist(), _bytes(part.gradient(slope, len(cols), square=bounding))))
            return pd.DataFrame(out, columns=columns)

        asked = self._gathered(betas, k) if not bounding else matrix.limit(0).select("rb", "cb", F.lit(b"").alias("beta"))
        sent = matrix.groupBy("rb").cogroup(asked.groupBy("rb")).applyInPandas(run, "rb int, cb int, columns array<int>, sums binary")
        blocks = self.row_blocks
        while blocks > 1:  # a tree: no task adds up more than FAN blocks' sums

            def add(frame: pd.DataFrame) -> pd.DataFrame:
                every = np.unique(np.concatenate([np.asarray(c, int) for c in frame["columns"]]))
                total = np.zeros((max(1, len(every)), k))
                for c, b in zip(frame["columns"], frame["sums"], strict=True):
                    at = np.searchsorted(every, np.asarray(c, int)) if len(every) else np.zeros(1, int)
                    total[at] += _array(b, -1, k)
                return pd.DataFrame([(int(frame["rb"].iloc[0]), int(frame["cb"].iloc[0]), every.tolist(), _bytes(total))], columns=columns)

            sent = sent.withColumn("rb", F.floor(F.col("rb") / FAN).cast("int")).groupBy("rb", "cb").applyInPandas(add, "rb int, cb int, columns array<int>, sums binary")
            blocks = -(-blocks // FAN)
        return sent

    def _run_steps(self) -> DataFrame:
        """The first job bounds the curvature, each later one takes a step."""
        setting, k, shelf, seeds = self.setting, len(self.setting.problems), self.shelf, self.seeds
        matrix = self.matrix.repartition(min(self.row_blocks, 2000), "rb").persist(StorageLevel.DISK_ONLY)  # dealt once; a lost part is read again
        fields = ", ".join(f"{f} binary" for f in Block.FIELDS)
        state_schema = f"cb int, curve binary, {fields}, dots binary, penalty binary, along binary, loss binary"
        names = [f.split()[0] for f in state_schema.split(", ")]

        def rebuilt(row: pd.Series) -> Block:
            factor = np.asarray(row["factor"], float)
            block = Block(factor, np.asarray(row["active"], bool).reshape(len(factor), seeds), _array(row["curve"], -1, k), setting)
            for f in Block.FIELDS:
                pairs = f in "sy"
                setattr(block, f, _array(row[f], *((PAIRS,) if pairs else ()), len(factor), k, kind=np.float32 if pairs else float))
            return block

        def dumped(cb: int, block: Block, curve: bytes, dots=b"", penalty=b"", along=b"") -> tuple:
            return (cb, curve, *(_bytes(getattr(block, f), np.float32 if f in "sy" else float) for f in Block.FIELDS), dots, penalty, along, None)

        def spread(sent: pd.DataFrame, width: int) -> np.ndarray:
            out = np.zeros((width, k))
            for c, b in zip(sent["columns"], sent["sums"], strict=True):
                out[np.asarray(c, int)] += _array(b, -1, k)
            return out

        def begin(sent: pd.DataFrame, meta: pd.DataFrame) -> pd.DataFrame:
            if not len(meta):
                return pd.DataFrame([], columns=names)
            head = meta.iloc[0]
            curve = spread(sent, len(head["factor"]))
            block = Block(np.asarray(head["factor"], float), np.asarray(head["active"], bool).reshape(len(curve), seeds), curve, setting)
            return pd.DataFrame([dumped(int(head["cb"]), block, _bytes(curve))], columns=names)

        def betas(state: DataFrame, moved) -> DataFrame:
            """(cb, beta) at the next trial, which `moved` gives from a block's state."""

            def run(frames):
                for frame in frames:
                    yield pd.DataFrame([(int(row["cb"]), _bytes(moved(rebuilt(row)))) for _, row in frame.iterrows()], columns=["cb", "beta"])

            return state.mapInPandas(run, "cb int, beta binary")

        def received(moved):
            """Blocks make the same move again, and take the gradient there."""

            def run(sent: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
                if not len(state):  # the losses
                    return pd.DataFrame([(-1, *[None] * (len(names) - 2), _bytes(sum(_array(b, k) for b in sent["sums"])))], columns=names)
                row = state.iloc[0]
                block = rebuilt(row)
                moved(block)
                return pd.DataFrame([dumped(int(row["cb"]), block, row["curve"], *map(_bytes, block.receive(spread(sent, len(block.u)))))], columns=names)

            return run

        def moving(search: Search):
            weights, step, taken = search.weights.copy(), search.steps.copy(), search.taken.copy()

            def run(block: Block) -> np.ndarray:
                block.commit(taken)
                return block.move(weights, step)

            return run

        search = Search(setting)
        state = shelf.keep(self._sent(matrix, None).groupBy("cb").cogroup(self.columns.groupBy("cb")).applyInPandas(begin, state_schema), "state-0", 2)
        n = 2 * PAIRS + 1
        for i in range(1, setting.steps + 1):
            moved = moving(search)
            own = state.filter("cb >= 0").join(self.columns, "cb")
            sent = self._sent(matrix, betas(own, moved))
            state = shelf.keep(sent.groupBy("cb").cogroup(own.groupBy("cb")).applyInPandas(received(moved), state_schema), f"state-{i}", 2)
            shelf.drop(f"state-{i - 1}")
            got = state.select("cb", "dots", "penalty", "along", "loss").collect()  # a row for each block of features
            cols = [r for r in got if r["cb"] >= 0]
            loss = next(_array(r["loss"], k) for r in got if r["cb"] < 0)
            search.learn(loss + sum(_array(r["penalty"], k) for r in cols), sum(_array(r["dots"], k, n, n) for r in cols), sum(_array(r["along"], k) for r in cols))
            if not search.open.any():
                break
        taken = search.taken.copy()

        def last(block: Block) -> np.ndarray:
            block.commit(taken)
            return block.beta(block.u)

        out = shelf.keep(betas(state.filter("cb >= 0").join(self.columns, "cb"), last), "beta", 2)
        matrix.unpersist()
        return out

    def run(self) -> "Fit":
        self.beta = self._run_whole() if self.small else self._run_steps()
        return self

    def coefficients(self) -> DataFrame:
        """(feature, coefs): a coefficient for each problem."""
        k = len(self.setting.problems)

        def split(frames):
            for frame in frames:
                for cb, b in zip(frame["cb"], frame["beta"], strict=True):
                    beta = _array(b, -1, k)
                    yield pd.DataFrame({"cb": int(cb), "c": np.arange(len(beta)), "coefs": list(beta)})

        each = self.beta.mapInPandas(split, "cb int, c int, coefs array<double>")
        shared = self.features.select("feature", "cb", "c").join(each, ["cb", "c"]).select("feature", "coefs")
        if self.own is None:
            return shared
        setting = self.setting

        def pulled(frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            """What the rows' own features get, by a unit of x / factor."""
            if not len(frame):
                return pd.DataFrame([], columns=["obs_id", "pull"])
            frame = frame.sort_values("cb")
            rows = Rows.of(frame, setting)
            b = rows.moved(rows.margins({int(cb): _array(beta, -1, k) for cb, beta in zip(got["cb"], got["beta"], strict=True)}, k))
            at = np.flatnonzero(rows.own.any(1))
            pull = np.divide(b[at], rows.own[at], out=np.zeros((len(at), k)), where=rows.own[at] > 0)
            return pd.DataFrame({"obs_id": np.asarray(frame.iloc[0]["obs"], np.int64)[at], "pull": list(pull)}, columns=["obs_id", "pull"])

        pulls = self.matrix.groupBy("rb").cogroup(self._gathered(self.beta, k).groupBy("rb")).applyInPandas(pulled, "obs_id long, pull array<double>")
        seed_of = F.array(*(F.lit(p.seed) for p in setting.problems))
        coefs = F.transform("pull", lambda p, i: F.when(F.get("active", F.get(seed_of, i)), p * F.col("x") / F.col("factor")).otherwise(0.0))
        return shared.unionByName(self.own.join(pulls, "obs_id").select("feature", coefs.alias("coefs")))

    def held_out(self) -> DataFrame:
        """(obs_id, seed, fold, c, y, w, prob) of rows under the problems that hold their fold out."""
        setting, k = self.setting, len(self.setting.problems)
        columns = ["obs_id", "seed", "fold", "c", "y", "w", "prob"]

        def run(frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            if not len(frame):
                return pd.DataFrame([], columns=columns)
            frame = frame.sort_values("cb")
            rows, head = Rows.of(frame, setting), frame.iloc[0]
            beta = {int(cb): _array(b, -1, k) for cb, b in zip(got["cb"], got["beta"], strict=True)}
            z = rows.margins(beta, k)
            folds, obs = np.asarray(head["folds"], int).reshape(len(rows.y), -1), np.asarray(head["obs"], np.int64)
            out = []
            for i, p in enumerate(setting.problems):
                at = np.flatnonzero(folds[:, p.seed] == p.fold) if p.fold else []
                if len(at):
                    prob = 1 / (1 + np.exp(-np.clip(z[at, i], -500, 500)))
                    out.append(pd.DataFrame({"obs_id": obs[at], "seed": p.seed, "fold": p.fold, "c": p.c, "y": rows.y[at].astype(int), "w": rows.w[at], "prob": prob}))
            return pd.concat(out)[columns] if out else pd.DataFrame([], columns=columns)

        asked = self._gathered(self.beta, k)
        return self.matrix.groupBy("rb").cogroup(asked.groupBy("rb")).applyInPandas(run, "obs_id long, seed int, fold int, c double, y int, w double, prob double")
