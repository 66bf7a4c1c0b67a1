"""Softmax regression with a group penalty (the sum over features of the Euclidean norm
of their class weights), over any number of rows and for several strengths at once.

The curvature of the loss is bounded by half the second moments of the features, which
one job adds up; then each iteration is one job for the gradients of all strengths, and
the bounded model with the penalty is solved on the driver, whose numbers are features x classes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shelf
from ..shipping import ship


def classes_of(df: DataFrame, label: str) -> list:
    """The labels in order (a row for each class)."""
    return [r[0] for r in df.filter(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]


def _stack(frame: pd.DataFrame) -> np.ndarray:
    x = np.stack(frame["x"].to_numpy())
    return np.hstack([x, np.ones((len(x), 1))])


def _total(sums: DataFrame) -> dict[int, np.ndarray]:
    """Sums by key; a task sends one row for each."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": frame["key"].iloc[:1], "sums": [sum(np.frombuffer(b) for b in frame["sums"]).tobytes()]})

    return {r["key"]: np.frombuffer(r["sums"]) for r in sums.groupBy("key").applyInPandas(add, "key int, sums binary").collect()}


def _moments(rows: DataFrame, width: int) -> tuple[np.ndarray, float]:
    def run(frames):
        total = np.zeros(width * width + 1)
        for frame in frames:
            a, w = _stack(frame), frame["w"].to_numpy()
            total += np.append(((a * w[:, None]).T @ a).reshape(-1), w.sum())
        yield pd.DataFrame({"key": [0], "sums": [total.tobytes()]})

    got = _total(rows.mapInPandas(run, "key int, sums binary")).get(0, np.zeros(width * width + 1))
    return got[:-1].reshape(width, width), float(got[-1])


def _gradients(rows: DataFrame, thetas: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    def run(frames):
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            a, w, y = _stack(frame), frame["w"].to_numpy(), frame["y"].to_numpy()
            for k, theta in thetas.items():
                z = a @ theta
                z -= z.max(1, keepdims=True)
                norm = np.log(np.exp(z).sum(1))
                at = (np.arange(len(y)), y)
                p = np.exp(z - norm[:, None])
                loss = float(w @ (norm - z[at]))
                p[at] -= 1
                own = np.append((a.T @ (p * w[:, None])).reshape(-1), loss)
                total[k] = total[k] + own if k in total else own
        yield pd.DataFrame({"key": list(total), "sums": [v.tobytes() for v in total.values()]})

    shape = next(iter(thetas.values())).shape
    return {k: (float(v[-1]), v[:-1].reshape(shape)) for k, v in _total(rows.mapInPandas(run, "key int, sums binary")).items()}


def _solved(theta: np.ndarray, gradient: np.ndarray, curve: np.ndarray, strength: float, sweeps: int = 500) -> np.ndarray:
    """Minimises gradient . step + step' curve step / 2 + strength * norms of the rows but the last, by blocks."""
    new, slope = theta.copy(), gradient.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(theta)):
            h = max(curve[j, j], 1e-12)
            to = new[j] - slope[j] / h
            if j < len(theta) - 1:
                norm = np.linalg.norm(to)
                to = to * max(0.0, 1 - strength / (h * norm)) if norm > 0 else to
            step = to - new[j]
            if step.any():
                slope += np.outer(curve[:, j], step)
                new[j] = to
                moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-12:
            break
    return new


def fit(df: DataFrame, features: list[str], strengths: list[float], label: str = "y", weight: str | None = None, steps: int = 300, tolerance: float = 1e-7) -> tuple[list, dict[float, tuple[np.ndarray, np.ndarray]]]:
    """(labels, strength -> (coefficients by class and feature, intercepts)). Objective:
    weighted mean of the log-loss plus strength * penalty. Rows without label or weight
    are left out, null features are 0; without rows all is zero. Intercepts sum to zero."""
    ship(df.sparkSession)
    labels = classes_of(df, label)
    at = F.create_map(*(F.lit(v) for pair in enumerate(labels) for v in reversed(pair))) if labels else None
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    k, width = max(1, len(labels)), len(features) + 1
    out = {s: (np.zeros((k, len(features))), np.zeros(k)) for s in strengths}
    if not labels:
        return labels, out
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features)).cast("array<double>")
    rows = df.filter(F.col(label).isNotNull() & w.isNotNull()).select(x.alias("x"), at[F.col(label)].cast("int").alias("y"), w.alias("w"))
    rows = rows.groupBy("x", "y").agg(F.sum("w").alias("w"))  # equal rows count once
    rows = Shelf(df.sparkSession, "softmax").keep(rows, "rows")
    moments, total = _moments(rows, width)
    if not total:
        return labels, out
    curve = 0.5 * moments / total
    theta = {i: np.zeros((width, k)) for i in range(len(strengths))}
    ahead, pace, last, open_ = dict(theta), dict.fromkeys(theta, 1.0), {}, set(theta)
    for _ in range(steps):
        got = _gradients(rows, {i: ahead[i] for i in open_})
        for i in sorted(open_):
            loss, gradient = got[i]
            value = loss / total + strengths[i] * np.linalg.norm(ahead[i][:-1], axis=1).sum()
            if value > last.get(i, np.inf) + 1e-15 and pace[i] > 1:  # momentum went too far: begin again from here
                pace[i], ahead[i] = 1.0, theta[i]
                last[i] = np.inf
                continue
            last[i] = value
            new = _solved(ahead[i], gradient / total, curve, strengths[i])
            moved = np.abs(new - theta[i]).max()
            faster = (1 + np.sqrt(1 + 4 * pace[i] ** 2)) / 2
            ahead[i] = new + (pace[i] - 1) / faster * (new - theta[i])
            theta[i], pace[i] = new, faster
            if moved < tolerance:
                open_.discard(i)
        if not open_:
            break
    for i, s in enumerate(strengths):
        b = theta[i][-1]
        out[s] = (theta[i][:-1].T.copy(), b - b.mean())
    return labels, out


def predict(df: DataFrame, features: list[str], labels: list, coefs: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """Adds probs (by class, in the labels' order) and predicted, in expressions."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    scores = [sum((F.lit(float(b)) * v for b, v in zip(row, x, strict=True)), F.lit(float(b0))) for row, b0 in zip(coefs, intercepts, strict=True)]
    out = df.withColumn("_z", F.array(*scores))
    out = out.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    whole = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
    out = out.withColumn("probs", F.transform("_e", lambda e: e / whole))
    best = F.array_position("probs", F.array_max("probs")).cast("int")
    return out.withColumn("predicted", F.element_at(F.array(*map(F.lit, labels)), best)).drop("_z", "_e")
