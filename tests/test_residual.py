"""Residual phrases: one fit over strengths, folds and seeds, against dense solvers."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.operators import linear, residual, sparse_logistic
from loomlens.operators.residual import Side
from loomlens.operators.sparse_logistic import Problem
from loomlens.queries import QUERIES

GRID = [0.01, 0.1, 1.0, 10.0]


def made(n, seed=0, vocabulary=24):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        tokens = [f"w{j}" for j in range(vocabulary) if rng.random() < 0.5 / (1 + j % 7)]
        concept = float("w1" in tokens and rng.random() < 0.8)
        score = 1.5 * ("w0" in tokens) - 2 * ("w3" in tokens) + 1.2 * ("w5" in tokens) + 2 * concept - 0.5
        folds = [1 + rng.randrange(3), rng.choice([0, 1 + rng.randrange(3)])]
        out.append((i, ", ".join(tokens), concept, rng.gauss(0, 1), int(rng.random() < 1 / (1 + np.exp(-score))), rng.choice([1.0, 2.0, 0.5]), folds))
    return out


SCHEMA = "obs_id long, phrases string, concept double, control double, y int, sample_weight double, folds array<int>"


def dense(rows, side, words, columns, factors, c, fold, penalty):
    """Coefficients of the scaled design, by the dense solvers, and a scorer."""
    x = np.array([[*(float(w in r[1].split(", ")) for w in words), *(r[SCHEMA_AT[k]] * f for k, f in zip(columns, factors))] for r in rows])
    y, w, own = (np.array([r[4] for r in rows], float), np.array([r[5] for r in rows]), np.array([r[6][side] for r in rows]))
    train = (own > 0) & (own != fold)
    beta, b = linear.fit(x[train], y[train], w[train], penalty, c)
    held = own == fold
    score = linear.auc(y[held], linear.sigmoid(x[held] @ beta + b), w[held]) if fold else None
    return beta, score


SCHEMA_AT = {"concept": 2, "control": 3}


@pytest.mark.parametrize("penalty", ["l2", "l1"])
def test_grid_equals_dense_fits(spark, penalty):
    rows = made(2000 if penalty == "l2" else 500)
    df = spark.createDataFrame(rows, SCHEMA)
    sides = [Side(("concept",), ("control",)), Side((), (), ("w1", "w13", "w4x"))]
    coefs, chosen = residual.fit_residuals(df, sides, "phrases", penalty, GRID, factor=1000.0, scale_controls=False, tolerance=1e-6)
    got = {(r.side, r.feature): (r.coef, r.freq) for r in coefs.collect()}
    every = [f"w{j}" for j in range(24)]
    for side, words in enumerate([every, [w for w in every if w != "w13"]]):
        columns, factors = (["concept", "control"], [1000.0, 1.0]) if side == 0 else ([], [])
        means = {c: np.mean([dense(rows, side, words, columns, factors, c, f, penalty)[1] for f in (1, 2, 3)]) for c in GRID}
        assert chosen[side] in [c for c in GRID if means[c] >= max(means.values()) - 1e-4]
        words = [*words, ""]  # a note without phrases has the empty one, which takes part and is not shown
        beta, _ = dense(rows, side, words, columns, factors, chosen[side], 0, penalty)
        own = [r for r in rows if r[6][side] > 0]
        assert {f for s, f in got if s == side} == set(words) - {""}
        for w, b in zip(words[:-1], beta):
            assert got[side, w][0] == pytest.approx(b, abs=3e-3)
            assert got[side, w][1] == pytest.approx(sum(w in r[1].split(", ") for r in own) / len(own))


@pytest.mark.parametrize("absolute", [False, True])
def test_blocks_equal_one_task(spark, monkeypatch, absolute):
    """The same steps as jobs over blocks of rows and features."""
    rows = made(240, 3, 12)
    df = spark.createDataFrame(rows, SCHEMA).select("obs_id", "y", F.col("sample_weight").alias("w"), "folds", F.split("phrases", ", ").alias("t"))
    entries = df.select("obs_id", F.explode("t").alias("feature"), F.lit(1.0).alias("x")).unionByName(df.select("obs_id", F.lit("b").alias("feature"), F.lit(1.0).alias("x")))
    features = entries.select("feature").distinct().select("feature", F.when(F.col("feature") == "b", 0.0).otherwise(1.0).alias("factor"), F.array(F.lit(True), F.col("feature") != "w2").alias("active"))
    problems = [Problem(0, 0, 1.0), Problem(0, 2, 0.1), Problem(1, 0, 1.0)]
    fit = lambda: sparse_logistic.Fit(df, entries, features, problems, absolute, tolerance=1e-3, steps=12).run()
    one = fit()
    monkeypatch.setattr(sparse_logistic, "ROW_BLOCK", 100)
    monkeypatch.setattr(sparse_logistic, "STATE_BYTES", 8 * (4 + sparse_logistic.PAIRS) * len(problems) * 6)
    monkeypatch.setattr(sparse_logistic, "FAN", 2)
    cut = fit()
    assert (one.row_blocks, one.feature_blocks) == (1, 1) and cut.row_blocks > 2 and cut.feature_blocks > 1
    a, b = ({r.feature: r.coefs for r in f.coefficients().collect()} for f in (one, cut))
    assert a.keys() == b.keys() and a["w2"][2] == b["w2"][2] == 0.0
    assert all(x == pytest.approx(y, abs=1e-6) for f in a for x, y in zip(a[f], b[f]))
    held = [{(r.obs_id, r.seed, r.fold, r.c): round(r.prob, 6) for r in f.held_out().collect()} for f in (one, cut)]
    assert held[0] == held[1] and len(held[0]) == sum(r[6][0] == 2 for r in rows)


def test_single_fit_and_its_frequencies(spark, sf_dir):
    """Every phrase of the labelled notes takes part; freq is what SQL counts."""
    top = QUERIES["x02_residual_words"](spark, sf_dir).collect()
    assert len(top) == 40 and [abs(r.coef) for r in top] == sorted((abs(r.coef) for r in top), reverse=True)
    notes = duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' d JOIN '{sf_dir}/labels.parquet' l USING (doc_id) WHERE text IS NOT NULL").fetchall()
    df = residual.phrase_rows(spark.createDataFrame(notes, "text string").withColumn("obs_id", F.monotonically_increasing_id()), "text")
    want = {r.token: r.prevalence for r in residual.token_prevalence(df, len(notes), 0.0).collect()}
    assert all(r.freq == pytest.approx(want[r.feature]) for r in top)


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, None, 0.0, 1, 1.0, [1, 1]), (2, "a, b,, a", 1.0, None, 0, 1.0, [1, 0]), (3, "a", 1.0, 0.0, None, 1.0, [1, 1]), (4, "a", 1.0, 0.0, 1, None, [1, 1]), (5, "b", 0.0, 0.0, 1, 1.0, [1, 0]), (6, "c", 0.0, 0.0, 1, 1.0, [0, 0])], SCHEMA)
    coefs, chosen = residual.fit_residuals(df, [Side(("concept",), ("control",))], "phrases", "l2", [1.0])
    got = {r.feature: (r.coef, r.freq) for r in coefs.collect()}
    assert got.keys() == {"a", "b"} and abs(got["a"][0]) < 0.01 and got["a"][1] == pytest.approx(1 / 3) and chosen == [1.0]
    assert residual.fit_residuals(df.limit(0), [Side()], "phrases", "l2", [1.0])[0].collect() == []
    assert residual.fit_residual(df.limit(0), [], "phrases").collect() == []
    free = residual.fit_residual(df, [], "phrases", penalty=None).collect()
    assert {r.feature for r in free} == {"a", "b", "c"} and all(np.isfinite(r.coef) for r in free)
    with pytest.raises(ValueError):
        residual.fit_residual(df, [], "phrases", penalty="l7")
    with pytest.raises(ValueError):
        residual.fit_residual(df, [], "phrases", kind="words")
    assert residual.fit_residual(df, [], "phrases", kind="tfidf", c=1.0).count() >= 2


def test_features_of_one_row_need_no_state(spark, monkeypatch):
    """Phrases of a single note leave the fit and come back: as the dense solver has them, in tasks and by steps."""
    rows = [(*r[:6], [r[6][0], 1 + i % 3 if i % 2 else 0]) for i, r in enumerate(made(150, 5, 8))]
    df = spark.createDataFrame(rows, SCHEMA).select("obs_id", "y", F.col("sample_weight").alias("w"), "folds", F.split("phrases", ", ").alias("t"))
    each = lambda name, x: df.select("obs_id", name.alias("feature"), F.lit(x).alias("x"))
    alone = each(F.concat(F.lit("own"), "obs_id"), 1.5).unionByName(each(F.concat(F.lit("half"), "obs_id"), 1.0).filter("obs_id % 2 = 0"))
    entries = df.select("obs_id", F.explode("t").alias("feature"), F.lit(1.0).alias("x")).unionByName(each(F.lit("b"), 1.0)).unionByName(alone)
    name = F.col("feature")
    features = entries.select("feature").distinct().select("feature", F.when(name == "b", 0.0).when(name.startswith("half"), 0.5).otherwise(1.0).alias("factor"), F.array(F.lit(True), ~name.startswith("half")).alias("active"))
    problems = [Problem(0, 0, 50.0), Problem(0, 2, 0.1), Problem(1, 0, 1.0), Problem(1, 1, 3.0)]
    fit = lambda steps=200: sparse_logistic.Fit(df, entries, features, problems, tolerance=1e-7, steps=steps).run()
    held = fit()
    assert held.small
    monkeypatch.setattr(sparse_logistic, "ROW_BLOCK", 70)
    monkeypatch.setattr(sparse_logistic, "STATE_BYTES", 8 * (4 + sparse_logistic.PAIRS) * len(problems) * 4)
    monkeypatch.setattr(sparse_logistic, "HELD", 1e9)
    blocks = fit(5)  # of which a task holds all
    assert blocks.small
    monkeypatch.setattr(sparse_logistic, "HELD", 0)
    steps = fit(5)
    assert not steps.small and steps.row_blocks > 1 and steps.feature_blocks > 1
    shared = {w for r in rows for w in r[1].split(", ")} | {"b"}
    assert held.sizes[1] == len(shared)
    a, b, c = ({r.feature: r.coefs for r in f.coefficients().collect()} for f in (held, blocks, steps))
    assert a.keys() == b.keys() == c.keys() and len(a) == len(shared) + 225
    assert all(x == pytest.approx(y, abs=1e-4) for f in a for x, y in zip(b[f], c[f]))
    probs = [{(r.obs_id, r.c): r.prob for r in f.held_out().collect()} for f in (blocks, steps)]
    assert probs[0] == pytest.approx(probs[1], abs=1e-4)
    names = sorted(set(a) - {"b"})
    for k, p in enumerate(problems):
        factor = np.array([np.sqrt(0.5) if n.startswith("half") else 1.0 for n in names])  # the solver's penalty is 1 for all
        x = np.array([[1.5 * (n == f"own{r[0]}") + (n == f"half{r[0]}") * (p.seed == 0) + (n in r[1].split(", ")) for n in names] for r in rows]) / factor
        train = np.array([r[6][p.seed] > 0 and r[6][p.seed] != p.fold for r in rows])
        beta, free = linear.fit(x[train], np.array([r[4] for r in rows], float)[train], np.array([r[5] for r in rows])[train], "l2", p.c)
        want = dict(zip(names, beta / factor)) | {"b": free}
        assert all(a[n][k] == pytest.approx(want[n], abs=2e-3) for n in a)
