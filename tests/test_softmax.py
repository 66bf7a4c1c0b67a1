"""Group-penalised softmax fits against the dense solver; hierarchies without linkage."""

import numpy as np
import pytest

from loomlens.operators import cluster, linear, softmax

RNG = np.random.default_rng(4)


@pytest.fixture(scope="module")
def made(spark):
    n = 240
    x = np.stack([RNG.normal(0, 1, n), (RNG.random(n) < 0.4).astype(float), RNG.normal(1, 2, n), RNG.normal(0, 1, n)], 1)
    z = x @ np.array([[1.5, 0.0, -1.0], [-1.0, 1.0, 0.0], [0.0, 0.6, -0.6], [0.0, 0.0, 0.0]])
    y = (z + RNG.gumbel(0, 1, z.shape)).argmax(1)
    rows = [(*map(float, x[i]), "red green blue".split()[y[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y string").repartition(4), x, y


def test_equal_to_a_dense_solver_at_several_strengths(spark, made):
    df, x, y = made
    order = [2, 1, 0]  # blue, green, red
    strengths = [0.3, 0.03, 0.003]
    labels, fits = softmax.fit(df, list("abcd"), strengths)
    assert labels == ["blue", "green", "red"]
    own = np.array([order.index(v) for v in y])
    for s in strengths:
        beta, b = linear.group_lasso(x, own, s, steps=40_000)
        coefs, intercepts = fits[s]
        assert coefs == pytest.approx(beta.T, abs=2e-4) and intercepts == pytest.approx(b - b.mean(), abs=2e-4)
        assert (np.abs(coefs).sum(0) == 0).tolist() == (np.abs(beta.T).sum(0) == 0).tolist()
    assert not fits[0.3][0][:, 3].any() and fits[0.003][0][:, 0].any()


def test_predictions_and_weights(spark, made):
    df, x, y = made
    labels, fits = softmax.fit(df, list("abcd"), [0.01])
    coefs, intercepts = fits[0.01]
    rows = softmax.predict(df, list("abcd"), labels, coefs, intercepts).collect()
    for r in rows[:20]:
        z = np.array([r.a, r.b, r.c, r.d]) @ coefs.T + intercepts
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.probs == pytest.approx(p.tolist()) and r.predicted == labels[int(p.argmax())]
    from pyspark.sql import functions as F

    twice = df.withColumn("w", F.lit(2.0)).unionByName(df.limit(3).withColumns({"w": F.lit(None).cast("double")})).unionByName(df.limit(2).withColumns({"w": F.lit(5.0), "y": F.lit(None).cast("string")}))
    again = softmax.fit(twice, list("abcd"), [0.01], weight="w")[1][0.01]
    assert again[0] == pytest.approx(coefs, abs=1e-5)
    assert softmax.fit(df.limit(0), ["a"], [0.1]) == ([], {0.1: (pytest.approx(np.zeros((1, 1))), pytest.approx(np.zeros(1)))})


def test_hierarchy_without_linkage(spark):
    names = lambda t: t["name"] if "children" not in t else [names(c) for c in t["children"]]
    assert cluster.fallback_hierarchy([]) is None and cluster.fallback_hierarchy(["a"]) == {"name": "a"}
    assert cluster.fallback_hierarchy(list("abc")) == {"name": "root", "children": [{"name": c} for c in "abc"]}
    assert names(cluster.fallback_hierarchy(list("abcde"))) == [[["a", "b"], ["c", "d"]], "e"]
    assert names(cluster.fallback_hierarchy(list("abcdefg"))) == [[["a", "b"], ["c", "d"]], [["e", "f"], "g"]]
    zero = spark.createDataFrame([(i, c, 0.0) for i in range(4) for c in range(4)], "obs_id long, concept_id int, answer double")
    assert names(cluster.shown(zero, {0: "zero"})) == [["zero", 1], [2, 3]]
    some = spark.createDataFrame([(i, c, float((i + c) % 2)) for i in range(6) for c in range(3)], "obs_id long, concept_id int, answer double")
    assert cluster.shown(some)["size"] == 3
