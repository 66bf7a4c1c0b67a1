"""The inverted file against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.operators import context, vector_index
from loomlens.queries import QUERIES

RNG = np.random.default_rng(2)


def clustered(spark, n=600, dim=8, groups=12):
    centers = RNG.normal(0, 1, (groups, dim))
    rows = [(i, (centers[i % groups] + RNG.normal(0, 0.25, dim)).tolist(), f"k{i % 50}") for i in range(n)]
    rows += [(n + i, rows[7][1], "copy") for i in range(200)]  # a list with many copies
    rows += [(2000, None, "a"), (2001, [0.0] * dim, "b"), (2002, [1.0, 2.0], "c"), (2003, [1.0, None, *[0.0] * (dim - 2)], "d"), (None, [1.0] * dim, "e"), (2004, [2.0, 4.0], "f")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, near string").repartition(5)
    return df.withColumn("list", F.lit("clash")).withColumn("salt", F.lit("clash"))


def hits(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 9)) for r in df.collect())


@pytest.mark.parametrize("near", [None, "near"])
def test_all_lists_give_the_exact_result(spark, monkeypatch, near):
    monkeypatch.setattr(context, "ITEM_BLOCK", 32)
    monkeypatch.setattr(context, "QUERY_BLOCK", 5)
    items = clustered(spark)
    stated = items.filter("vec_id % 20 = 0 OR vec_id = 2002").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.Index.build(items, near_key=near, lists=10)
    sizes = [r.n for r in index.table.select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 600 + 200 + 3 and max(sizes) <= 3 * 32  # every row once, the copies in several blocks
    exact = hits(context.nearest(items, stated, 4, 0.3, near_key=near))
    assert hits(index.search(stated, 4, 10, 0.3)) == exact and any(q == 2002 for q, *_ in exact)
    few = index.search(stated, 4, 2, 0.3)
    assert 0.9 <= vector_index.recall(few, context.nearest(items, stated, 4, 0.3, near_key=near)) <= 1.0


def test_probes_follow_the_measured_recall(spark):
    """Vectors without clusters need more lists; the target is met all the same."""
    rows = [(i, RNG.normal(0, 1, 12).tolist()) for i in range(900)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    stated = items.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found, share, probes = vector_index.nearest(items, stated, 5, -1.0, target=0.9)
    assert probes > 1 and share >= 0.9
    assert vector_index.recall(found, context.nearest(items, stated, 5, -1.0)) >= 0.85


def test_given_vectors(spark, sf_dir):
    exact = QUERIES["q35_similar_vectors"](spark, sf_dir)
    found = QUERIES["x06_index_search"](spark, sf_dir)
    assert vector_index.recall(found, exact) >= 0.9
    assert {r.recall >= 0.9 for r in found.select("recall").distinct().collect()} == {True}


def test_empty_tables(spark):
    items = clustered(spark)
    none = items.limit(0)
    stated = items.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    assert vector_index.nearest(none, stated)[0].collect() == []
    assert vector_index.nearest(items, stated.limit(0))[0].collect() == []


def test_lookup_takes_few_of_many_hits(spark):
    notes = spark.createDataFrame([(i, f"The word number {i} is in this sentence. And the other one here too.") for i in range(400)], "obs_id long, text string")
    rows = context.lookup(notes.repartition(7), ["the", "number 39", "none"], most=3).collect()
    assert sorted((r.phrase, r.obs_id) for r in rows) == [("number 39", 39), ("number 39", 390), ("number 39", 391), *[("the", i) for i in range(3)]]
    hits_ = context.first_of(spark.range(5000).select(F.lit("p").alias("phrase"), "id"), "phrase", ["id"], 4)
    assert [f.id for f in hits_.first().found] == [0, 1, 2, 3]
