"""The bootstrap of rank metrics: exact scores, against the same draws by brute force."""

import hashlib
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomlens.operators import linear, metrics, resample
from loomlens.plans.evaluate import evaluate

SCHEMA = "obs_id long, slice string, prob double, y int, w double"


def brute(rows, replicates, seed, weighted, sensitivity=None):
    """rows of one slice -> value per replicate, None where a class is missing."""
    cells = {}
    for key, _, p, y, w in rows:
        if p is not None and y is not None and w is not None:
            cells.setdefault((p, y, w if weighted else 1.0), []).append(key)
    items = sorted(cells.items())
    start = [hashlib.md5(f"{seed}:{min(keys)}".encode()).hexdigest() for _, keys in items]
    a, b = (np.array([int(h[i : i + 8], 16) for h in start]) for i in (0, 8))
    times = resample.draws(a, b, np.array([len(k) for _, k in items]), np.arange(replicates))
    p, y, w = (np.array([c[i] for c, _ in items], float) for i in range(3))
    out = []
    for r in range(replicates):
        weight = times[:, r] * w
        if sensitivity is None:
            out.append(linear.auc(y, p, weight))
            continue
        pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
        good = [1 - weight[(y == 0) & (p >= t)].sum() / neg for t in sorted(set(p), reverse=True) if pos and weight[(y == 1) & (p >= t)].sum() / pos >= sensitivity] if neg else []
        out.append(good[0] if good else None)
    return out


def some_rows(n, seed, slices=("a", "b")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        p = rng.choice([0.5, 0.25, round(rng.random(), 2), rng.random()]) * (1.3 if y else 1) / 2
        out.append((i, rng.choice(slices), p, y, rng.choice([1.0, 2.0, rng.random() + 0.1])))
    return out + [(n, "a", None, 1, 1.0), (n + 1, "a", 0.2, None, 1.0), (n + 2, "b", 0.2, 0, None)]


@pytest.mark.parametrize(("weighted", "sensitivity"), [(True, None), (False, None), (False, 0.9), (True, 0.75)])
def test_replicates_equal_brute_force(spark, weighted, sensitivity):
    rows = some_rows(300, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")  # many parts: slices and equal scores lie across them
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resample.replicate_values(df, ["slice"], 150, 3, "w" if weighted else None, sensitivity).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in ("a", "b"):
        own = [r if weighted else (*r[:4], 1.0) for r in rows if r[1] == name]
        want = {r: v for r, v in enumerate(brute(own, 150, 3, weighted, sensitivity)) if v is not None}
        have = {r.rep: r.value for r in got if r.slice == name}
        assert have.keys() == want.keys()
        assert all(math.isclose(have[r], want[r], abs_tol=1e-9) for r in want)


def test_one_score_for_most_rows(spark):
    """Rows that share score, label and weight are one cell; with weights of their own
    they are dealt over parts although their score is one."""
    same = [(i, "a", 0.5, i % 4 == 0, 1.0) for i in range(9000)] + [(9000 + i, "a", 0.1 + i / 1000, i % 2, 1.0) for i in range(50)]
    df = spark.createDataFrame([(k, s, p, int(y), w) for k, s, p, y, w in same], SCHEMA)
    assert resample.cells(df, ["slice"], 0, "w", "obs_id").count() < 60
    mixed = df.withColumn("w", F.lit(1.0) + F.col("obs_id") / 10_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = resample.cells(mixed, ["slice"], 0, "w", "obs_id").repartitionByRange(4, "slice", "prob", "_key").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in dealt) < 4000
        got = {r.rep: r.value for r in resample.replicate_values(mixed, ["slice"], 20, 5, "w").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute([tuple(r) for r in mixed.collect()], 20, 5, True)
    assert all(math.isclose(got[r], want[r], abs_tol=1e-9) for r in range(20))


def test_rare_events_keep_the_estimate_inside(spark):
    """Scores below 1/2000, perfectly and nearly ordered: nothing is rounded away."""
    rng = random.Random(2)
    rows = [(i, "", (0.0004 if i % 50 == 0 else 0.0001) + rng.random() / 1e5, int(i % 50 == 0), 1.0) for i in range(2000)]
    out = evaluate(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("w", "sample_weight"), 0.9, replicates=200).first()
    assert out.auc_str == "1.000 (1.000, 1.000)" and out.specificity_str == "1.000 (1.000, 1.000)"
    noisy = [(i, s, p * (rng.random() + (0.2 if y else 0)), y, rng.random() + 0.5) for i, s, p, y, _ in rows]
    out = evaluate(spark.createDataFrame(noisy, SCHEMA).withColumnRenamed("w", "sample_weight"), 0.9, replicates=200).first()
    assert out.auc_low < out.auc < out.auc_high and out.spec_low <= out.specificity <= out.spec_high
    assert out.auc_high - out.auc_low < 0.2


def test_draws_are_poisson():
    a, b = np.arange(400) * 7919 % 65536, np.arange(400) * 104729 % 65521
    for n in (1, 4, 32, 33, 1000):
        got = resample.draws(a, b, np.full(400, n), np.arange(500))
        assert abs(got.mean() - n) < 5 * math.sqrt(n / got.size) and abs(got.var() / n - 1) < 0.03
        if n == 1:
            assert abs((got == 0).mean() - math.exp(-1)) < 0.005 and abs((got == 3).mean() - math.exp(-1) / 6) < 0.003


def test_incomplete_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", None, 1, 1.0), (2, "a", 0.2, 0, 1.0), (3, "a", 0.7, 1, 1.0), (4, "a", 0.9, None, 1.0), (5, "b", None, 1, 1.0), (6, "a", 0.1, 1, None)], SCHEMA)
    got = {r.slice: r for r in metrics.metric_rows(df, ["slice"], 0.9, "w").collect()}
    assert (got["a"].auc, got["a"].specificity, got["a"].n_samples, got["a"].positive_rate, got["a"].n_left_out) == (1.0, 1.0, 2, 0.5, 3)
    assert (got["b"].auc, got["b"].n_samples, got["b"].n_left_out) == (None, 0, 1)
    assert df.agg(metrics.log_likelihood()).first()[0] == pytest.approx(math.log(0.8) + math.log(0.7) + math.log(0.1))
    assert df.agg(metrics.accuracy(weight="w")).first()[0] == 1.0
    assert resample.bootstrap(df.limit(0), ["slice"], 10, 1).collect() == []
    assert resample.bootstrap(df.filter("slice = 'b'"), ["slice"], 10, 1).collect() == []


def test_memory_does_not_grow_with_the_part(monkeypatch):
    """A large part's replicates are drawn and kept in pieces, with the same sums."""
    rng = np.random.default_rng(4)
    n, reps = 40_000, np.arange(100)
    frame = pd.DataFrame({"prob": rng.random(n), "y": rng.integers(0, 2, n), "w": 1.0, "n": 1, "a": rng.integers(0, 2**32, n), "b": rng.integers(0, 2**32, n)})
    tracemalloc.start()
    total = np.zeros((2, 100))
    for where, pos, neg in resample._Drawn(frame).weights(reps):
        total[:, where] = pos.sum(0), neg.sum(0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # 64 MB hold the weights of all replicates
    times = resample.draws(*(frame[c].to_numpy() for c in "abn"), reps)
    assert (total[0] == times[frame["y"] == 1].sum(0)).all() and (total[1] == times[frame["y"] == 0].sum(0)).all()


def test_parts_follow_the_cells(spark, monkeypatch):
    """Small pieces and many parts give what one part gives."""
    rows = some_rows(300, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    get = lambda: {(r.slice, r.rep): r.value for r in resample.replicate_values(df, ["slice"], 60, 3, sensitivity=0.9).collect()}
    one = get()
    monkeypatch.setattr(resample, "PART", 40)
    assert one and get() == pytest.approx(one, abs=1e-12)
