"""Chains of the Bayesian search, their marginals, and bootstrap refits."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.operators import bayes, linear, resample, select
from loomlens.plans.chains import Chains
from loomlens.plans.config import EnsembleConfig

RNG = np.random.default_rng(21)


def rows_of(n):
    a, b, c = (RNG.random(n) < p for p in (0.4, 0.5, 0.3))
    y = RNG.random(n) < linear.sigmoid(1.1 * a + 0.9 * b - 0.8)
    return a.astype(float), b.astype(float), c.astype(float), y.astype(int)


@pytest.fixture(scope="module")
def matrix(spark):
    a, b, c, y = rows_of(240)
    d = RNG.normal(0, 1, 240)
    part = np.where(RNG.random(240) < 0.6, "train", "test")
    w = RNG.choice([1.0, 2.0], 240)
    rows = [(i, s, str(part[i]), int(y[i]), float(w[i]), float(a[i]), float(b[i]), float(c[i]), float(d[i])) for i in range(240) for s in (1, 2)]
    df = spark.createDataFrame(rows, "obs_id long, seed int, part string, y int, sample_weight double, a double, b double, c double, d double")
    return df, np.stack([a, b, c, d], 1), y, w, part


def test_marginals_of_all_chains_in_one_job(spark, matrix, monkeypatch):
    df, x, y, w, part = matrix
    kept, pools = {1: ["a"], 2: []}, {1: ["b", "c", "d"], 2: ["a"]}
    one = bayes.log_weights(df, kept, pools)
    monkeypatch.setattr(select, "MOST_PATTERNS", 0)
    other = bayes.log_weights(df, kept, pools)
    train = part == "train"
    at = {n: i for i, n in enumerate("abcd")}
    for s, pool in pools.items():
        for n in pool:
            cols = [at[k] for k in (*kept[s], n)]
            data = lambda on: bayes.Data(x[on][:, cols], y[on].astype(float), w[on])  # noqa: E731, B023
            want = bayes.log_weight(data(train), data(~train), 1.0)
            assert one[s, n] == pytest.approx(want, abs=1e-5) and other[s, n] == pytest.approx(want, abs=1e-4)


def test_moves_have_the_posterior_as_their_distribution():
    logs = {"a": -3.0, "b": -2.2, "c": -4.0}
    prior = dict.fromkeys(logs, 0.1)
    rng, at, seen = np.random.default_rng(0), "c", collections.Counter()
    for _ in range(20_000):
        others = [n for n in logs if n != at]
        at, chance = bayes.mh_step(others, prior, at, lambda n: logs[n] + np.log(prior[n]), rng)
        seen[at] += 1
    # two states: the chain is exact; three: each step's candidates are the whole rest
    two, at, rng = collections.Counter(), "a", np.random.default_rng(1)
    for _ in range(20_000):
        at, _ = bayes.mh_step(["b" if at == "a" else "a"], prior, at, lambda n: logs[n] + np.log(prior[n]), rng)
        two[at] += 1
    share = np.exp(-2.2) / (np.exp(-2.2) + np.exp(-3.0))
    assert two["b"] / 20_000 == pytest.approx(share, abs=0.015)
    assert seen["b"] > seen["a"] > seen["c"]


class Fixed:
    """Proposes what is not in use, from a pool."""

    def __init__(self, pool):
        self.pool = pool

    def propose(self, words, kept, n):
        return [{"concept": f"Does the note mention {p}?", "pattern": p, "words": [p], "is_risk_factor": True} for p in self.pool if f"Does the note mention {p}?" not in kept][:n]


def notes_of(spark):
    a, b, _, y = rows_of(160)
    rows = [(i, ", ".join((["red"] if a[i] else []) + (["blue"] if b[i] else []) + ["x"]), int(y[i]), 1.0) for i in range(160)]
    return spark.createDataFrame(rows, "obs_id long, text string, y int, sample_weight double")


def setting(**more):
    return EnsembleConfig.from_args(init_seeds=[1, 2], goal_num_meta_concepts=1, max_meta_concepts=2, cv=2, final_learner_type="l2", **more)


def test_two_concepts_by_their_exact_posterior(spark, tmp_path, monkeypatch):
    """One place, two concepts: visits follow the marginals, of which Spark computes each once."""
    notes = notes_of(spark)
    chains = Chains(spark, setting(num_epochs=0, num_greedy_epochs=0), str(tmp_path / "run"), proposer=Fixed(["red", "blue"]), resplit=False)
    chains.fit(notes)
    jobs, log_weights = [], bayes.log_weights
    monkeypatch.setattr(bayes, "log_weights", lambda *a: jobs.append(1) or log_weights(*a))
    names = [f"Does the note mention {p}?" for p in ("red", "blue")]
    chains._ready(notes, names)
    seen = {s: collections.Counter() for s in (1, 2)}
    current = {s: chains._current(s) for s in (1, 2)}
    for _ in range(3000):
        pools = {s: [n for n in names if n not in current[s]] for s in (1, 2)}
        current = chains._sampled(notes, current, {1: [], 2: []}, pools)
        chains.history.iterations += [chains.history.iterations[-1]] * 2  # a step of both chains
        for s in (1, 2):
            seen[s][current[s][0]] += 1
    assert len(jobs) <= 2 and len(chains.moves) == 6000
    for s in (1, 2):
        logs = np.array([chains._known[s, frozenset(), n] for n in names])
        share = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert seen[s][names[0]] / 3000 == pytest.approx(share[0], abs=0.04)


def test_search_resumes_as_if_it_had_not_stopped(spark, tmp_path):
    notes = notes_of(spark)
    more = {"num_greedy_epochs": 1}
    whole = Chains(spark, setting(num_epochs=2, **more), str(tmp_path / "a"), proposer=Fixed(["red", "blue", "x"]))
    whole.fit(notes)
    Chains(spark, setting(num_epochs=1, **more), str(tmp_path / "b"), proposer=Fixed(["red", "blue", "x"])).fit(notes)
    again = Chains.from_checkpoint(spark, str(tmp_path / "b"), setting(num_epochs=1, **more), proposer=Fixed(["red", "blue", "x"]))
    assert again.moves == [] and again.continue_training(notes, 0) is again.history and again.history.length(1) == 2
    again.continue_training(notes, 1)
    assert [r[2] for r in whole.history.iterations if r[0] == 1] == ["baseline", "greedy", "sampled"]
    assert sorted(again.history.coefs) == sorted(whole.history.coefs) and sorted(again.moves) == sorted(whole.moves) and len(again.moves) == 2
    assert again.predict(notes).count() == 160


def test_refits_equal_a_loop(spark, monkeypatch):
    a, b, _, y = rows_of(300)
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), int(y[i]), 1.0 + i % 2) for i in range(300)] + [(300, 1.0, 1.0, None, 1.0)], "obs_id long, a double, b double, y int, w double")
    got = {r.rep: (*r.coefs, r.intercept) for r in bayes.bootstrap_refits(df, ["a", "b"], 40, 5, weight="w").collect()}
    assert sorted(got) == list(range(40))
    cells = resample.cells(df.withColumn("prob", F.col("a") + 2 * F.col("b")), [], 5, "w", "obs_id").collect()
    times = resample.draws(*(np.array([r[c] for r in cells]) for c in ("a", "b", "n")), np.arange(40))
    x = np.array([[r.prob % 2, r.prob // 2] for r in cells])
    for rep in range(40):
        w = times[:, rep] * np.array([r.w for r in cells])
        beta, b0, _ = linear.newton(x[w > 0], np.array([r.y for r in cells], float)[w > 0], w[w > 0])
        assert got[rep] == pytest.approx((*beta, b0), abs=1e-6)
    monkeypatch.setattr(select, "MOST_PATTERNS", 0)  # over rows: the rows' own draws
    rows = {r.rep: (*r.coefs, r.intercept) for r in bayes.bootstrap_refits(df, ["a", "b"], 60, 5, weight="w").collect()}
    spread = np.std(list(rows.values()), 0)
    assert np.allclose(np.mean(list(rows.values()), 0), np.mean(list(got.values()), 0), atol=4 * spread.max() / np.sqrt(40))
    assert bayes.bootstrap_refits(df.limit(0), ["a"], 5).collect() == []
