"""Fits by summed gradients and Hessians equal those on counted patterns and dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.operators import linear, newton, select

RNG = np.random.default_rng(11)
N, NAMES = 300, ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def made(spark):
    x = np.stack([RNG.normal(0, 1, N), (RNG.random(N) < 0.4).astype(float), RNG.normal(2, 3, N), RNG.random(N)], 1)
    y = (RNG.random(N) < linear.sigmoid(x @ np.array([1.2, -1.0, 0.3, 0.0]) - 0.5)).astype(float)
    w, fold = RNG.random(N) + 0.5, RNG.integers(0, 4, N)
    rows = [(i, 1 + i % 2, "train" if fold[i] else "test", int(fold[i]), int(y[i]), float(w[i]), *map(float, x[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "obs_id long, seed int, part string, fold int, y int, sample_weight double, a double, b double, c double, d double").repartition(5)
    return df, x, y, w, fold


@pytest.mark.parametrize("penalty", [None, "l2", "l1"])
def test_many_fits_equal_dense_ones(spark, made, penalty):
    df, x, y, w, fold = made
    rows = newton.table(df.withColumn("w", F.col("sample_weight")), NAMES, "seed")
    problems = [newton.Problem(g, cols, penalty, c, f) for g in (1, 2) for cols in ((0, 1, 2, 3), (2, 0)) for c in (0.05, 5.0) for f in (0, 2)]
    fits = newton.fit_all(rows, problems)
    group = 1 + np.arange(N) % 2
    for p, (beta, b) in zip(problems, fits):
        on = (group == p.group) & (fold > 0) & (fold != p.fold)
        want, b0 = linear.fit(x[on][:, list(p.columns)], y[on], w[on], penalty, p.c)
        assert beta == pytest.approx(want, abs=1e-5) and b == pytest.approx(b0, abs=1e-5)
    got = newton.assessed(rows, problems, fits, True)
    for p, (beta, b), s in zip(problems, fits, got):
        on = (group == p.group) & (fold == p.fold)
        assert s == pytest.approx(linear.auc(y[on], linear.sigmoid(x[on][:, list(p.columns)] @ beta + b), w[on]), abs=1e-9)


def both_ways(monkeypatch, run):
    one = run()
    monkeypatch.setattr(select, "MOST_PATTERNS", 0)
    return one, run()


def same(a, b):
    return a == pytest.approx(b, abs=2e-5)


@pytest.mark.parametrize("penalty", ["l2", "l1"])
def test_candidates_by_rows(spark, made, monkeypatch, penalty):
    df = made[0]
    run = lambda: {(r.seed, r.candidate): (r.score, r.coef) for r in select.score_candidates(df, {1: ["a"], 2: ["a", "b"]}, {1: ["b", "c", "d"], 2: ["c"]}, {"d": True, "b": True}, penalty, check_sign=True).collect()}
    one, other = both_ways(monkeypatch, run)
    assert one.keys() == other.keys() == {(1, "b"), (1, "c"), (1, "d"), (2, "c")}
    assert all(same(one[k], other[k]) for k in one) and one[1, "b"][0] == 0.0  # its sign disagrees


def test_baseline_by_rows(spark, made, monkeypatch):
    df = made[0]
    one, other = both_ways(monkeypatch, lambda: select.baseline_of(df, ["b", "c", "d"], 2, ["a"]))
    assert one["concepts"] == other["concepts"] and one["concepts"][0] == "a" and len(one["concepts"]) == 3
    assert same(one["coefs"], other["coefs"]) and all(same(one[k], other[k]) for k in ("intercept", "auc", "test_auc"))


@pytest.mark.parametrize("penalty", ["l2", None])
def test_final_fit_by_rows(spark, made, monkeypatch, penalty):
    df = made[0].withColumn("fold", F.col("obs_id") % 3 + 1)
    one, other = both_ways(monkeypatch, lambda: select.final_fit(df, NAMES, penalty))
    assert same(one["coefs"], other["coefs"]) and all(same(one[k], other[k]) for k in ("intercept", "auc")) and one["log_lik"] == pytest.approx(other["log_lik"], rel=1e-6)


def test_null_features_are_zero_and_empty_groups_stay_zero(spark):
    df = spark.createDataFrame([(1, 1.0, None, 1.0), (0, 1.0, 2.0, 1.0), (1, 1.0, 1.0, 1.0)], "y int, w double, a double, fold double")
    rows = newton.table(df, ["a"])
    fits = newton.fit_all(rows, [newton.Problem(0, (0,), "l2"), newton.Problem(5, (0,), "l2")])
    want, b0 = linear.fit(np.array([[0.0], [2.0], [1.0]]), np.array([1.0, 0.0, 1.0]), np.ones(3), "l2", 1.0)
    assert fits[0][0] == pytest.approx(want, abs=1e-6) and fits[1][0].tolist() == [0.0]
    with pytest.raises(ValueError):
        newton.Problem(0, (0,), "l7")
