"""Logistic fits on few dense features, any number of rows, many fits at once.

Where answers are real numbers, counted patterns are as many as rows, so fits on
patterns don't help. Here rows stay where they are: in each iteration a task adds up, for
every open problem, the loss, its gradient and its Hessian, (p + 1)(p + 3) numbers for p
features; the sums of all tasks meet by problem, and the driver, which has nothing but these, takes a damped Newton
step (for |beta|_1 a proximal one, by coordinate descent on the quadratic model).
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import linear, metrics
from .resample import draws

FREE = 1e-8  # ridge of fits without penalty, as in the fits on patterns


@dataclass(frozen=True)
class Problem:
    """Rows of `group` with fold > 0 other than `fold` are trained on (fold 0: all of them).
    With `flat` the intercept is penalised as the others are (l2). With a replicate, a row
    weighs as often as it is drawn there (`resample.draws`); rows then have numbers a and b."""

    group: int
    columns: tuple[int, ...]
    penalty: str | None
    c: float = 1.0
    fold: int = 0
    flat: bool = False
    replicate: int | None = None

    def __post_init__(self):
        if self.penalty not in (None, "l2", "l1", "l1_sklearn"):
            raise ValueError(f"unknown penalty {self.penalty!r}")

    @property
    def absolute(self) -> bool:
        return self.penalty in ("l1", "l1_sklearn")

    @property
    def scale(self) -> float:
        return 1.0 if self.penalty is None else self.c

    @property
    def ridge(self) -> float:
        return {None: FREE, "l2": 1.0}.get(self.penalty, 0.0)


def table(df: DataFrame, features: list[str], group: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """group, fold (0: not trained on), y, w and the features as one array; null features are 0."""
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features)).cast("array<double>")
    return df.select((F.col(group) if group else F.lit(0)).cast("int").alias("group"), F.col("fold").cast("int").alias("fold"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), x.alias("x"), *keep)


def _designs(frame: pd.DataFrame, by_columns: dict) -> list:
    """(problems, design with a column of ones, y, w, folds) for each group and set of columns in the frame."""
    out = []
    for group, own in frame.groupby("group", sort=False):
        wanted = by_columns.get(group)
        if wanted:
            x = np.stack(own["x"].to_numpy())
            y, w, fold = (own[c].to_numpy() for c in ("y", "w", "fold"))
            numbers = tuple(own[c].to_numpy() for c in ("a", "b")) if "a" in own else None
            out += [(ids, np.hstack([x[:, list(columns)], np.ones((len(x), 1))]), y, w, fold, numbers) for columns, ids in wanted.items()]
    return out


def _by_columns(problems: list[Problem], which) -> dict:
    out: dict = defaultdict(lambda: defaultdict(list))
    for i in which:
        out[problems[i].group][problems[i].columns].append(i)
    return {g: dict(v) for g, v in out.items()}


def _sums(rows: DataFrame, problems: list[Problem], theta: list[np.ndarray], which: list[int]) -> dict[int, np.ndarray]:
    """For each of the problems (loss, gradient, Hessian) at its coefficients, flat."""
    wanted, at = _by_columns(problems, which), {i: theta[i] for i in which}
    folds, reps = {i: problems[i].fold for i in which}, {i: problems[i].replicate for i in which}

    def run(frames):
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for ids, a, y, w, fold, numbers in _designs(frame, wanted):
                z = a @ np.stack([at[i] for i in ids], 1)
                weight = w[:, None] * ((fold[:, None] > 0) & (fold[:, None] != np.array([folds[i] for i in ids])))
                if numbers is not None:
                    weight = weight * draws(*numbers, np.ones(len(y), int), np.array([reps[i] for i in ids]))
                p = linear.sigmoid(z)
                loss = (weight * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
                slope, curve = a.T @ (weight * (p - y[:, None])), weight * p * (1 - p)
                for j, i in enumerate(ids):
                    own = np.concatenate([[loss[j]], slope[:, j], ((a * curve[:, j : j + 1]).T @ a).reshape(-1)])
                    total[i] = total[i] + own if i in total else own
        yield pd.DataFrame({"problem": list(total), "sums": [v.tobytes() for v in total.values()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"problem": frame["problem"].iloc[:1], "sums": [sum(np.frombuffer(b) for b in frame["sums"]).tobytes()]})

    schema = "problem int, sums binary"
    got = rows.mapInPandas(run, schema).groupBy("problem").applyInPandas(add, schema).collect()  # a row for each problem
    return {r["problem"]: np.frombuffer(r["sums"]) for r in got}


def _proximal(hessian: np.ndarray, gradient: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The step that lowers the quadratic model plus the sizes of all but the last coordinate."""
    step, slope = np.zeros_like(theta), gradient.copy()
    for _ in range(200):
        moved = 0.0
        for j in range(len(theta)):
            h = max(hessian[j, j], 1e-12)
            now = theta[j] + step[j]
            new = now - slope[j] / h
            if j < len(theta) - 1:
                new = np.sign(new) * max(abs(new) - 1 / h, 0.0)
            if new != now:
                step[j] += new - now
                slope += (new - now) * hessian[:, j]
                moved = max(moved, abs(new - now))
        if moved < 1e-11:
            break
    return step


def fit_all(rows: DataFrame, problems: list[Problem], steps: int = 60, tolerance: float = 1e-8) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) of each problem; problems without rows are zero."""
    ship(rows.sparkSession)
    n = len(problems)
    theta = [np.zeros(len(p.columns) + 1) for p in problems]
    start, step, scale, best, open_ = list(theta), [np.zeros_like(t) for t in theta], np.ones(n), np.full(n, np.inf), set(range(n))
    for _ in range(steps):
        trial = [s + k * d for s, k, d in zip(start, scale, step, strict=True)]
        got = _sums(rows, problems, trial, sorted(open_))
        for i in sorted(open_):
            if i not in got:
                open_.discard(i)
                continue
            p, size = problems[i], len(trial[i])
            weights = np.array([1.0] * (size - 1) + [float(p.flat)])
            loss, gradient, hessian = p.scale * got[i][0], p.scale * got[i][1 : size + 1], p.scale * got[i][size + 1 :].reshape(size, size)
            penalty = np.abs(trial[i][:-1]).sum() if p.absolute else 0.5 * p.ridge * (weights * trial[i] ** 2).sum()
            value = loss + penalty
            if value > best[i] + 1e-12 * (1 + abs(best[i])):
                scale[i] /= 2
                if scale[i] < 1e-6:
                    open_.discard(i)
                continue
            gain, moved = best[i] - value, np.abs(trial[i] - start[i]).max() if np.isfinite(best[i]) else np.inf
            start[i], theta[i], best[i], scale[i] = trial[i], trial[i], value, 1.0
            if moved < tolerance or gain < 1e-13 * (1 + abs(value)):
                open_.discard(i)
                continue
            hessian = hessian + np.diag(1e-10 + p.ridge * weights)
            step[i] = _proximal(hessian, gradient, trial[i]) if p.absolute else -np.linalg.solve(hessian, gradient + p.ridge * weights * trial[i])
        if not open_:
            break
    return [(t[:-1], float(t[-1])) for t in theta]


def scores(rows: DataFrame, problems: list[Problem], fits: list[tuple[np.ndarray, float]], held_out: bool) -> DataFrame:
    """(problem, y, w, prob): rows of each problem's group; with `held_out` those of its fold."""
    wanted = _by_columns(problems, range(len(problems)))
    at = [np.append(b, b0) for b, b0 in fits]
    folds = [p.fold for p in problems]

    def run(frames):
        for frame in frames:
            for ids, a, y, w, fold, _ in _designs(frame, wanted):
                for i in ids:
                    own = fold == folds[i] if held_out else np.ones(len(y), bool)
                    if own.any():
                        yield pd.DataFrame({"problem": i, "y": y[own].astype(int), "w": w[own], "prob": linear.sigmoid(a[own] @ at[i])})

    return rows.mapInPandas(run, "problem int, y int, w double, prob double")


def assessed(rows: DataFrame, problems: list[Problem], fits: list[tuple[np.ndarray, float]], held_out: bool = True, use_accuracy: bool = False) -> list[float | None]:
    """The area under the ROC curve (or the accuracy) of each problem's scores."""
    each = scores(rows, problems, fits, held_out)
    found = each.groupBy("problem").agg(metrics.accuracy(weight="w").alias("s")) if use_accuracy else metrics.auc(each, ["problem"], "w").withColumnRenamed("auc", "s")
    got = {r["problem"]: r["s"] for r in found.collect()}  # a row for each problem
    return [got.get(i) for i in range(len(problems))]


def fit_grids(rows: DataFrame, wanted: list[tuple[int, tuple[int, ...]]], penalty: str | None, folds: int, use_accuracy: bool = False, grid=linear.C_GRID) -> list[tuple[np.ndarray, float, float]]:
    """For each (group, columns): (coefficients, intercept, C) at the smallest C whose
    mean over the folds is best. All strengths, folds and sets are fitted together."""
    if penalty is None:
        return [(b, b0, float("inf")) for b, b0 in fit_all(rows, [Problem(g, c, None) for g, c in wanted])]
    grid = sorted(float(c) for c in grid)
    problems = [Problem(g, cols, penalty, c, f) for g, cols in wanted for c in grid for f in range(folds + 1)]
    fits = fit_all(rows, problems)
    held = [i for i, p in enumerate(problems) if p.fold]
    score = dict(zip(held, assessed(rows, [problems[i] for i in held], [fits[i] for i in held], True, use_accuracy), strict=True))
    out = []
    for k in range(len(wanted)):
        base, best, chosen = k * len(grid) * (folds + 1), -np.inf, 0
        for j in range(len(grid)):
            own = [score[i] for i in range(base + j * (folds + 1) + 1, base + (j + 1) * (folds + 1)) if score[i] is not None]
            mean = float(np.mean(own)) if own else 0.0
            if mean > best + 1e-12:
                best, chosen = mean, j
        out.append((*fits[base + chosen * (folds + 1)], grid[chosen]))
    return out


def fit_sparse(rows: DataFrame, group: int, columns: tuple[int, ...], most: int, counted: tuple[bool, ...] | None = None, path=linear.C_PATH, together: int = 20) -> tuple[np.ndarray, float, float]:
    """The largest C on the path whose |beta|_1 fit has at most `most` coefficients (of
    the counted columns): stretches of the path are fitted together."""
    counts = np.ones(len(columns), bool) if counted is None else np.array(counted)
    for at in range(0, len(path), together):
        stretch = [float(c) for c in path[at : at + together]]
        for c, (beta, b) in zip(stretch, fit_all(rows, [Problem(group, columns, "l1", c) for c in stretch]), strict=True):
            if ((np.abs(beta) > 1e-10) & counts).sum() <= most:
                return np.where(np.abs(beta) > 1e-10, beta, 0.0), b, c
    raise ValueError(f"no fit with at most {most} features")
