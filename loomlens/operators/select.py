"""Concept selection: sparse baseline, greedy steps with rotation."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shelf
from . import linear, newton
from .order import seeded_key

#: Counted patterns that one task or the driver takes; where there are more (answers that
#: are real numbers), fits add up gradients and Hessians over the rows instead.
MOST_PATTERNS = 50_000


def patterns_of(matrix: DataFrame, features: list[str], by: list[str] | None = None, weight: str | None = "sample_weight") -> pd.DataFrame | None:
    """Compressed counts on the driver: as many rows as there are combinations of
    answers, part, fold and label; None if they are more than MOST_PATTERNS."""
    counted = Shelf(matrix.sparkSession, "patterns").keep(linear.compress(matrix, features, "y", weight, by), "counted")
    return counted.toPandas() if counted.count() <= MOST_PATTERNS else None


def _chosen(beta: np.ndarray, n: int, fixed: int, goal: int) -> list[int]:
    """Positions of the first `fixed` columns, of the non-zero others, and of the first unselected ones up to the goal."""
    found = [i for i in range(fixed, n) if beta[i] != 0]
    return [*range(fixed), *found, *[i for i in range(fixed, n) if i not in found][: max(0, goal - len(found))]]


def baseline(patterns: pd.DataFrame, concepts: list[str], goal: int, controls: list[str] | None = None) -> dict:
    """patterns: part, controls, concepts, y, w. Sparse path on train rows (controls take part, are
    not counted and stay), padded with the first unselected concepts up to the goal,
    refitted without penalty."""
    names, fixed = [*(controls or []), *concepts], len(controls or [])
    train, test = (patterns[patterns["part"] == p] for p in ("train", "test"))
    x, y, w = train[names].to_numpy(float), train["y"].to_numpy(float), train["w"].to_numpy(float)
    beta, _, _ = linear.fit_sparse(x, y, w, goal, counted=np.arange(len(names)) >= fixed)
    chosen = _chosen(beta, len(names), fixed, goal)
    coef, intercept, converged = linear.newton(x[:, chosen], y, w)
    score = lambda part: linear.auc(part["y"].to_numpy(float), linear.sigmoid(part[names].to_numpy(float)[:, chosen] @ coef + intercept), part["w"].to_numpy(float)) if len(part) else None
    return {"concepts": [names[i] for i in chosen], "coefs": coef.tolist(), "intercept": intercept, "auc": score(train), "test_auc": score(test), "converged": converged}


def baseline_of(matrix: DataFrame, concepts: list[str], goal: int, controls: list[str] | None = None) -> dict:
    """`baseline` of the rows of a matrix: part, y, sample_weight and a column for each name."""
    names, fixed = [*(controls or []), *concepts], len(controls or [])
    patterns = patterns_of(matrix, names, ["part"])
    if patterns is not None:
        return baseline(patterns, concepts, goal, controls)
    rows = newton.table(matrix.withColumns({"fold": (F.col("part") == "train").cast("int"), "w": F.col("sample_weight")}), names)
    rows = Shelf(matrix.sparkSession, "baseline").keep(rows, "rows")
    beta, _, _ = newton.fit_sparse(rows, 0, tuple(range(len(names))), goal, tuple(i >= fixed for i in range(len(names))))
    chosen = _chosen(beta, len(names), fixed, goal)
    problem = [newton.Problem(0, tuple(chosen), None)]
    fit = newton.fit_all(rows, problem)
    auc = lambda kind: newton.assessed(rows.filter(kind), problem, fit, False)[0]
    return {"concepts": [names[i] for i in chosen], "coefs": fit[0][0].tolist(), "intercept": fit[0][1], "auc": auc("fold > 0"), "test_auc": auc("fold = 0"), "converged": True}


def final_fit(matrix: DataFrame, names: list[str], penalty: str | None, use_accuracy: bool = False) -> dict:
    """Refit on all rows of a matrix (fold, y, sample_weight, columns), C by its folds."""
    patterns = patterns_of(matrix, names, ["fold"])
    if patterns is not None:
        x, y, w = patterns[names].to_numpy(float), patterns["y"].to_numpy(float), patterns["w"].to_numpy(float)
        if penalty is None:
            beta, b, _ = linear.newton(x, y, w)
        else:
            beta, b, _ = linear.fit_grid(x, y, w, patterns["fold"].to_numpy(), penalty, use_accuracy)
        p = np.clip(linear.sigmoid(x @ beta + b), 1e-15, 1 - 1e-15)
        return {"coefs": beta.tolist(), "intercept": b, "auc": linear.auc(y, p, w), "log_lik": float(w @ (y * np.log(p) + (1 - y) * np.log(1 - p)))}
    rows = newton.table(matrix.withColumn("w", F.col("sample_weight")), names)
    rows = Shelf(matrix.sparkSession, "final").keep(rows, "rows")
    columns = tuple(range(len(names)))
    beta, b, _ = newton.fit_grids(rows, [(0, columns)], penalty, _folds(rows), use_accuracy)[0]
    problem = [newton.Problem(0, columns, penalty)]
    p = F.greatest(F.least(F.col("prob"), F.lit(1 - 1e-15)), F.lit(1e-15))
    loglik = newton.scores(rows, problem, [(beta, b)], False).agg(F.sum(F.col("w") * F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p)))).first()[0]
    return {"coefs": beta.tolist(), "intercept": b, "auc": newton.assessed(rows, problem, [(beta, b)], False)[0], "log_lik": float(loglik)}


def _folds(rows: DataFrame) -> int:
    return rows.agg(F.max("fold")).first()[0] or 1


def score_candidates(matrix: DataFrame, kept: dict[int, list[str]], candidates: dict[int, list[str]], risk: dict[str, bool | None], penalty: str = "l2", use_accuracy: bool = False, check_sign: bool = False, k: int = 5) -> DataFrame:
    """(seed, candidate, score, coef): every candidate of every seed fitted on the
    train rows of [kept, candidate] and scored on the test rows, one group per task.

    matrix: seed, part, fold, y, sample_weight and one column per concept. Rows are
    compressed per (seed, candidate) before they are grouped, so a group holds
    answer patterns, not notes. If a group had more than MOST_PATTERNS of them, all
    fits add up gradients and Hessians over the rows."""
    spark = matrix.sparkSession
    patterns = candidate_patterns(matrix, kept, candidates, ["part", "fold"])
    if patterns is None:
        return spark.createDataFrame([], "seed int, candidate string, score double, coef double")
    if too_many(patterns):
        return _scored_by_rows(matrix, kept, candidates, risk, penalty, use_accuracy, check_sign)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array([[*b, v] for b, v in zip(frame["base"], frame["value"], strict=True)], float)
        y, w, train = frame["y"].to_numpy(float), frame["w"].to_numpy(float), (frame["part"] == "train").to_numpy()
        beta, b, _ = linear.fit_grid(x[train], y[train], w[train], frame["fold"].to_numpy()[train], penalty, use_accuracy)
        p = linear.sigmoid(x[~train] @ beta + b)
        score = linear.accuracy(y[~train], p, w[~train]) if use_accuracy else linear.auc(y[~train], p, w[~train])
        name = frame["candidate"].iloc[0]
        wanted = risk.get(name)
        if check_sign and wanted is not None and not (beta[-1] > 0 if wanted else beta[-1] < 0):
            score = 0.0
        return pd.DataFrame({"seed": [frame["seed"].iloc[0]], "candidate": [name], "score": [score or 0.0], "coef": [beta[-1]]})

    return patterns.groupBy("seed", "candidate").applyInPandas(run, "seed int, candidate string, score double, coef double")


def candidate_patterns(matrix: DataFrame, kept: dict[int, list[str]], candidates: dict[int, list[str]], by: list[str]) -> DataFrame | None:
    """(seed, candidate, *by, y, base, value, w): counted patterns of [kept, candidate] for
    every candidate of every seed, written; None without candidates."""
    parts, most = [], max((len(v) for v in kept.values()), default=0)
    for seed, pool in candidates.items():
        if not pool:
            continue
        own = matrix.filter(F.col("seed") == seed)
        base = [F.col(c).cast("double") for c in kept[seed]]
        padded = F.array(*base, *([F.lit(0.0)] * (most - len(base)))).cast("array<double>")
        options = F.array(*(F.struct(F.lit(c).alias("candidate"), F.col(c).cast("double").alias("value")) for c in pool))
        rows = own.select("seed", *by, "y", "sample_weight", padded.alias("base"), F.inline(options))
        parts.append(rows.groupBy("seed", "candidate", *by, "y", "base", "value").agg(F.sum("sample_weight").alias("w")))
    if not parts:
        return None
    patterns = parts[0]
    for p in parts[1:]:
        patterns = patterns.unionByName(p)
    return Shelf(matrix.sparkSession, "candidates").keep(patterns, "patterns")


def too_many(patterns: DataFrame) -> bool:
    """Whether a candidate has more patterns than one task should take."""
    return (patterns.groupBy("seed", "candidate").count().agg(F.max("count")).first()[0] or 0) > MOST_PATTERNS


def _scored_by_rows(matrix: DataFrame, kept: dict[int, list[str]], candidates: dict[int, list[str]], risk: dict[str, bool | None], penalty: str | None, use_accuracy: bool, check_sign: bool) -> DataFrame:
    names = sorted({n for v in (*kept.values(), *candidates.values()) for n in v})
    at = {n: i for i, n in enumerate(names)}
    cut = matrix.filter(F.col("seed").isin(*candidates)).withColumns({"fold": F.when(F.col("part") == "train", F.col("fold")).otherwise(0), "w": F.col("sample_weight")})
    rows = Shelf(matrix.sparkSession, "by-rows").keep(newton.table(cut, names, "seed"), "rows")
    each = [(s, c) for s, pool in candidates.items() for c in pool]
    columns = [(s, tuple(at[n] for n in (*kept[s], c))) for s, c in each]
    fits = newton.fit_grids(rows, columns, penalty, _folds(rows), use_accuracy)
    tests = [newton.Problem(s, cols, penalty) for s, cols in columns]  # fold 0: the rows that are not trained on
    found = newton.assessed(rows, tests, [(b, b0) for b, b0, _ in fits], True, use_accuracy)
    out = []
    for (s, c), (beta, _, _), score in zip(each, fits, found, strict=True):
        wanted = risk.get(c)
        agrees = not check_sign or wanted is None or (beta[-1] > 0 if wanted else beta[-1] < 0)
        out.append((s, c, float(score or 0.0) if agrees else 0.0, float(beta[-1])))
    return matrix.sparkSession.createDataFrame(out, "seed int, candidate string, score double, coef double")


def pick(scores: DataFrame, by: list[str], tie: int = 0) -> DataFrame:
    """Best candidate per group; scores within float tolerance tie and are settled
    by a seeded hash. Two aggregates, no window."""
    best = scores.groupBy(*by).agg(F.max("score").alias("_best"))
    close = scores.join(best, by).filter(F.abs(F.col("score") - F.col("_best")) <= 1e-8 + 1e-5 * F.abs("_best"))
    return close.groupBy(*by).agg(F.min_by(F.struct("candidate", "score", "coef"), seeded_key(tie, F.col("candidate"))).alias("_pick")).select(*by, "_pick.*")


def hashed_choice(options: list[str], seed: int) -> str:
    return min(options, key=lambda o: hashlib.md5(f"{seed}:{o}".encode()).hexdigest())


def rotate(current: list[str], chosen: list[str], holdout: int) -> list[str]:
    """The chosen concepts go first, the last `holdout` ones leave."""
    return [*chosen, *current[: len(current) - holdout]]
