"""Logistic regression on compressed counts.

Rows with equal features and label are one weighted pattern, which is exact for
every fit here; patterns of discrete answers are few whatever the number of rows.
Fits are NumPy functions on patterns; grouped fits run one group per task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C_GRID = np.logspace(-4, 4, 10)
C_PATH = np.logspace(2, -4, 200)


def compress(df: DataFrame, features: list[str], label: str = "y", weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    return df.groupBy(*(by or []), *features, label).agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-8, steps: int = 100) -> tuple[np.ndarray, float, bool]:
    """Minimises sum w * logloss + ridge/2 |beta|^2 (free intercept) by damped Newton
    steps; the small default ridge keeps separated data finite. -> beta, intercept, converged."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-10
    theta = np.zeros(a.shape[1])

    def loss(t):
        z = a @ t
        return float(w @ (np.logaddexp(0, z) - y * z) + 0.5 * (penalty * t) @ t)

    now = loss(theta)
    for _ in range(steps):
        p = sigmoid(a @ theta)
        gradient = a.T @ (w * (p - y)) + penalty * theta
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-12)
        step = np.linalg.solve(hessian, gradient)
        scale = 1.0
        while scale > 1e-8 and loss(theta - scale * step) > now + 1e-12:
            scale /= 2
        theta = theta - scale * step
        before, now = now, loss(theta)
        if np.abs(scale * step).max() < 1e-9 or abs(before - now) < 1e-12 * (1 + abs(now)):
            return theta[:-1], float(theta[-1]), True
    return theta[:-1], float(theta[-1]), False


def lasso(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float, start: np.ndarray | None = None, sweeps: int = 500) -> tuple[np.ndarray, float]:
    """Minimises |beta|_1 + C * sum w * logloss (free intercept): coordinate descent
    on quadratic models; where a model with the true curvature does not lower the
    objective, the next one takes the largest curvature that the loss can have."""
    a = x.astype(float)
    beta = np.zeros(a.shape[1]) if start is None else start[:-1].copy()
    b = 0.0 if start is None else float(start[-1])

    def objective(beta, b):
        z = a @ beta + b
        return float(np.abs(beta).sum() + c * (w @ (np.logaddexp(0, z) - y * z)))

    def model_step(beta, b, curve, slope):
        beta, residual = beta.copy(), slope / curve
        size = curve @ (a * a)
        for _ in range(100):
            step = (curve @ residual) / curve.sum()
            b += step
            residual = residual - step
            moved = abs(step)
            for j in np.flatnonzero(size > 1e-14):
                rho = curve @ (a[:, j] * residual) + size[j] * beta[j]
                new = np.sign(rho) * max(abs(rho) - 1.0, 0.0) / size[j]
                if new != beta[j]:
                    residual = residual - (new - beta[j]) * a[:, j]
                    moved = max(moved, abs(new - beta[j]))
                    beta[j] = new
            if moved < 1e-9:
                break
        return beta, b

    now, safe = objective(beta, b), False
    for _ in range(sweeps):
        p = sigmoid(a @ beta + b)
        curve = c * w * (0.25 if safe else np.maximum(p * (1 - p), 1e-6))
        new_beta, new_b = model_step(beta, b, curve, c * w * (y - p))
        new = objective(new_beta, new_b)
        if not np.isfinite(new) or new > now + 1e-10 * (1 + abs(now)):
            if safe:
                break
            safe = True
            continue
        moved = max(np.abs(new_beta - beta).max(initial=0.0), abs(new_b - b))
        beta, b, now, safe = new_beta, new_b, new, safe and moved > 1e-3
        if moved < 1e-7:
            break
    return beta, b


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: str | None, c: float = 1.0) -> tuple[np.ndarray, float]:
    """penalty: None, l2, l1 or l1_sklearn (the same)."""
    if penalty is None:
        beta, b, _ = newton(x, y, w)
        return beta, b
    if penalty == "l2":
        beta, b, _ = newton(x, y, c * w, 1.0)
        return beta, b
    if penalty in ("l1", "l1_sklearn"):
        return lasso(x, y, w, c)
    raise ValueError(f"unknown penalty {penalty!r}")


def auc(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> float | None:
    order = np.argsort(p, kind="stable")
    y, p, w = y[order], p[order], w[order]
    pos, neg = w * (y == 1), w * (y == 0)
    if pos.sum() == 0 or neg.sum() == 0:
        return None
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    gp, gn = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
    before = np.cumsum(gn) - gn
    return float((gp * (before + gn / 2)).sum() / (pos.sum() * neg.sum()))


def accuracy(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> float:
    return float((w * ((p > 0.5) == (y == 1))).sum() / w.sum())


def fit_grid(x: np.ndarray, y: np.ndarray, w: np.ndarray, fold: np.ndarray, penalty: str, use_accuracy: bool = False, grid: np.ndarray = C_GRID) -> tuple[np.ndarray, float, float]:
    """C of the best mean fold score (smallest on ties), refitted on all rows."""
    if set(np.unique(y)) - {0, 1}:
        raise ValueError("labels must be 0 or 1")
    best, chosen = -np.inf, float(grid[0])
    for c in sorted(grid):
        scores = []
        for f in np.unique(fold):
            test = fold == f
            beta, b = fit(x[~test], y[~test], w[~test], penalty, c)
            p = sigmoid(x[test] @ beta + b)
            s = accuracy(y[test], p, w[test]) if use_accuracy else auc(y[test], p, w[test])
            if s is not None:
                scores.append(s)
        score = float(np.mean(scores)) if scores else 0.0
        if score > best + 1e-12:
            best, chosen = score, float(c)
    beta, b = fit(x, y, w, penalty, chosen)
    return beta, b, chosen


def fit_sparse(x: np.ndarray, y: np.ndarray, w: np.ndarray, most: int, path: np.ndarray = C_PATH, counted: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """The first (largest) C on the path whose L1 fit has at most `most` features (of the counted ones)."""
    for c in path:
        beta, b = lasso(x, y, w, c)
        if ((beta != 0) & (True if counted is None else counted)).sum() <= most:
            return beta, b, float(c)
    raise ValueError(f"no fit with at most {most} features")


def group_lasso(x: np.ndarray, y: np.ndarray, strength: float = 0.001, rate: float = 0.5, steps: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression with the sum over features of the Euclidean norm of their
    class weights as penalty: proximal gradient steps."""
    classes = int(y.max()) + 1
    onehot = np.eye(classes)[y]
    beta, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    rate = min(rate, 1 / max(1e-9, 0.5 * (np.linalg.norm(x, 2) ** 2) / len(x)))
    for _ in range(steps):
        z = x @ beta + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = beta - rate * x.T @ (p - onehot) / len(x)
        norm = np.linalg.norm(step, axis=1, keepdims=True)
        new = step * np.maximum(0, 1 - rate * strength / np.maximum(norm, 1e-15))
        b -= rate * (p - onehot).mean(0)
        if np.abs(new - beta).max() < 1e-9:
            return new, b
        beta = new
    return beta, b


def grouped_fit(patterns: DataFrame, by: list[str], features: list[str], penalty: str | None, c: float = 1.0) -> DataFrame:
    """One fit per group of compressed patterns: (by, coefs array, intercept). A
    group's patterns are bounded by the answers' combinations, not by the rows."""
    import pandas as pd

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in patterns.schema if f.name in by), "coefs array<double>, intercept double"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        beta, b = fit(frame[features].to_numpy(float), frame["y"].to_numpy(float), frame["w"].to_numpy(float), penalty, c)
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in by}, "coefs": beta.tolist(), "intercept": b}])

    return patterns.groupBy(*by).applyInPandas(run, schema)
