"""Stepwise Bayesian concept search: Laplace marginals, a Metropolis-Hastings step, bootstrap refits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shelf
from ..shipping import ship
from . import newton, select
from .linear import fit, sigmoid
from .order import seeded_key
from .resample import draws

RIDGE_C = 1000.0


@dataclass(frozen=True)
class Data:
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray


def _design(d: Data) -> np.ndarray:
    return np.hstack([d.x.astype(float), np.ones((len(d.x), 1))])


def _map(d: Data) -> np.ndarray:
    """Ridge estimate with the intercept as a penalised column."""
    a = _design(d)
    theta = np.zeros(a.shape[1])
    for _ in range(100):
        p = sigmoid(a @ theta)
        h = (a * (d.w * p * (1 - p))[:, None]).T @ a + np.eye(a.shape[1]) / RIDGE_C
        step = np.linalg.solve(h, a.T @ (d.w * (p - d.y)) + theta / RIDGE_C)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return theta


def _hessian(d: Data, theta: np.ndarray) -> np.ndarray:
    a = _design(d)
    p = sigmoid(a @ theta)
    return (a * (d.w * p * (1 - p))[:, None]).T @ a + np.eye(a.shape[1]) / RIDGE_C


def log_likelihood(d: Data, theta: np.ndarray) -> float:
    p = np.clip(sigmoid(_design(d) @ theta), 1e-15, 1 - 1e-15)
    return float(d.w @ (d.y * np.log(p) + (1 - d.y) * np.log(1 - p)))


def log_weight(train: Data, test: Data, prior: float) -> float:
    """log of likelihood(test) * sqrt(det H1) * exp(-(delta' H1 delta) / 2) / sqrt(det H) * prior,
    delta between the estimates on all rows and on the train rows."""
    both = Data(np.vstack([train.x, test.x]), np.concatenate([train.y, test.y]), np.concatenate([train.w, test.w]))
    all_, first = _map(both), _map(train)
    h1, h = _hessian(train, first), _hessian(both, all_)
    delta = all_ - first
    return log_likelihood(test, all_) + 0.5 * np.linalg.slogdet(h1)[1] - 0.5 * float(delta @ h1 @ delta) - 0.5 * np.linalg.slogdet(h)[1] + float(np.log(prior))


def mh_move(candidates: list[str], priors: dict[str, float], existing: str, weight, rng: np.random.Generator) -> tuple[str, float, str]:
    """Draws a candidate by forward weight and accepts it with min(1, sum forward / sum
    backward): forward sums weigh candidates by the prior of what they replace, backward
    sums the other candidates and the existing concept by the drawn one's prior.
    weight(name) -> log of likelihood * own prior. -> (next, chance, drawn)."""
    logs = np.array([weight(c) for c in candidates])
    old = weight(existing)
    top = max(logs.max(), old)
    raw = np.exp(logs - top)
    total = raw.sum()
    i = int(rng.choice(len(candidates), p=raw / total)) if total > 0 else int(rng.integers(len(candidates)))
    drawn = candidates[i]
    others = np.delete(raw, i).sum() + np.exp(old - top)
    backward = others * priors[drawn]
    chance = min(1.0, float(total * priors[existing] / backward)) if backward > 0 else 1.0
    return (drawn if rng.random() < chance else existing), chance, drawn


def mh_step(candidates: list[str], priors: dict[str, float], existing: str, weight, rng: np.random.Generator) -> tuple[str, float]:
    return mh_move(candidates, priors, existing, weight, rng)[:2]


def greedy_slot(scores: dict[str, float], coefs: dict[str, float], slots: int) -> list[str]:
    """Up to two slots: best marginal scores; beyond, the largest coefficients."""
    by = scores if slots <= 2 else {c: abs(v) for c, v in coefs.items()}
    return sorted(by, key=lambda c: (-by[c], c))[:slots]


def log_weights(matrix: DataFrame, kept: dict[int, list[str]], candidates: dict[int, list[str]]) -> dict[tuple[int, str], float]:
    """`log_weight` (prior 1) of every candidate of every chain beside its kept columns, in
    one grouped job over counted patterns; beyond select.MOST_PATTERNS by sums over the rows.
    matrix: seed, part, y, sample_weight and a column for each name."""
    ship(matrix.sparkSession)
    patterns = select.candidate_patterns(matrix, kept, candidates, ["part"])
    if patterns is None:
        return {}
    if select.too_many(patterns):
        return _log_weights_by_rows(matrix, kept, candidates)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array([[*b, v] for b, v in zip(frame["base"], frame["value"], strict=True)], float)
        y, w, train = frame["y"].to_numpy(float), frame["w"].to_numpy(float), (frame["part"] == "train").to_numpy()
        value = log_weight(Data(x[train], y[train], w[train]), Data(x[~train], y[~train], w[~train]), 1.0)
        return pd.DataFrame({"seed": frame["seed"].iloc[:1], "candidate": frame["candidate"].iloc[:1], "log_weight": [value]})

    got = patterns.groupBy("seed", "candidate").applyInPandas(run, "seed int, candidate string, log_weight double").collect()  # a row for each candidate
    # padded columns are 0 everywhere: each adds the same ridge to both determinants
    return {(r["seed"], r["candidate"]): r["log_weight"] for r in got}


def _log_weights_by_rows(matrix: DataFrame, kept: dict[int, list[str]], candidates: dict[int, list[str]]) -> dict[tuple[int, str], float]:
    names = sorted({n for v in (*kept.values(), *candidates.values()) for n in v})
    at = {n: i for i, n in enumerate(names)}
    cut = matrix.filter(F.col("seed").isin(*candidates)).withColumns({"fold": (F.col("part") == "train").cast("int"), "w": F.col("sample_weight")})
    rows = Shelf(matrix.sparkSession, "marginals").keep(newton.table(cut, names, "seed"), "rows")
    every, test = rows.withColumn("fold", F.lit(1)), rows.withColumn("fold", 1 - F.col("fold"))
    each = [(s, c) for s, pool in candidates.items() for c in pool]
    problems = [newton.Problem(s, tuple(at[n] for n in (*kept[s], c)), "l2", RIDGE_C, flat=True) for s, c in each]
    whole, first = (newton.fit_all(r, problems) for r in (every, rows))
    thetas = [[np.append(b, b0) for b, b0 in fits] for fits in (whole, first)]
    ids = list(range(len(problems)))
    sums = [newton._sums(r, problems, t, ids) for r, t in ((every, thetas[0]), (rows, thetas[1]), (test, thetas[0]))]
    out = {}
    for i, key in enumerate(each):
        size = len(thetas[0][i])
        h, h1 = (s[i][size + 1 :].reshape(size, size) + np.eye(size) / RIDGE_C for s in sums[:2])
        delta = thetas[0][i] - thetas[1][i]
        held = -float(sums[2][i][0]) if i in sums[2] else 0.0
        out[key] = held + 0.5 * np.linalg.slogdet(h1)[1] - 0.5 * float(delta @ h1 @ delta) - 0.5 * np.linalg.slogdet(h)[1]
    return out


def bootstrap_refits(df: DataFrame, features: list[str], replicates: int, seed: int = 0, label: str = "y", weight: str | None = None, key: str = "obs_id", penalty: str | None = None, c: float = 1.0) -> DataFrame:
    """(rep, coefs, intercept): refits on resampled rows, each drawn a Poisson number of
    times by a hash of (seed, key, replicate). Rows of equal values are one counted cell;
    replicates are dealt over tasks, each with all cells. Beyond select.MOST_PATTERNS cells,
    the replicates are problems whose sums run over the rows. Rows without label or weight
    are left out, null features are 0; without rows there are no refits."""
    ship(df.sparkSession)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.filter(F.col(label).isNotNull() & w.isNotNull())
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)]
    names = [f"f{i}" for i in range(len(features))]
    cells = rows.groupBy(*values, F.col(label).cast("int").alias("y"), w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("_key"))
    hashed = seeded_key(seed, F.col("_key"))
    number = lambda df, h, i: df.withColumn("ab"[i], F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long"))
    cells = Shelf(df.sparkSession, "refits").keep(number(number(cells, hashed, 0), hashed, 1).drop("_key"), "cells")
    if cells.count() > select.MOST_PATTERNS:
        each = rows.select(*values, F.lit(1).alias("fold"), F.col(label).alias("y"), w.alias("w"), F.col(key).alias("_key"))
        hashed = seeded_key(seed, F.col("_key"))
        table = newton.table(number(number(each, hashed, 0), hashed, 1), names, keep=("a", "b"))
        table = Shelf(df.sparkSession, "refits").keep(table, "rows")
        fits = newton.fit_all(table, [newton.Problem(0, tuple(range(len(names))), penalty, c, replicate=r) for r in range(replicates)])
        return df.sparkSession.createDataFrame([(r, b.tolist(), b0) for r, (b, b0) in enumerate(fits)], "rep int, coefs array<double>, intercept double")
    frame = cells.toPandas()
    x, y, w_, n, a, b = frame[names].to_numpy(float), *(frame[k].to_numpy() for k in ("y", "w", "n", "a", "b"))

    def run(frames):
        for own in frames:
            reps = own["rep"].to_numpy()
            drawn = draws(a, b, n, reps) * w_[:, None]
            out = []
            for i, r in enumerate(reps):
                on = drawn[:, i] > 0
                beta, b0 = fit(x[on], y[on].astype(float), drawn[on, i], penalty, c) if on.any() else (np.zeros(x.shape[1]), 0.0)
                out.append((int(r), beta.tolist(), float(b0)))
            yield pd.DataFrame(out, columns=["rep", "coefs", "intercept"])

    tasks = max(1, min(replicates, 4 * df.sparkSession.sparkContext.defaultParallelism))
    reps = df.sparkSession.range(0, replicates if len(frame) else 0, 1, tasks).select(F.col("id").cast("int").alias("rep"))
    return reps.mapInPandas(run, "rep int, coefs array<double>, intercept double")
