"""Whole results where queries or operators once gave a part."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from loomlens.operators import annotate, context
from loomlens.plans.config import EnsembleConfig
from loomlens.plans.trainer import Trainer
from loomlens.queries import QUERIES
from loomlens.sources import tables


def brute_nearest(items, queries, k=3, least=0.4):
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    out = []
    for q, v in queries:
        found = []
        for i, w, near in items:
            if w and len(w) == len(v) and any(w):
                s = sum(x * y for x, y in zip(unit(v), unit(w), strict=True))
                if s >= least:
                    found.append((-s, i, near))
        seen, kept = set(), []
        for s, i, near in sorted(found):
            if near is None or near not in seen:
                seen.add(near)
                kept.append((-s, i))
        out += [(q, n + 1, i, round(s, 9)) for n, (s, i) in enumerate(kept[:k])]
    return sorted(out)


@pytest.mark.parametrize("near", [None, "near"])
def test_nearest_in_blocks(spark, monkeypatch, near):
    monkeypatch.setattr(context, "ITEM_BLOCK", 7)
    monkeypatch.setattr(context, "QUERY_BLOCK", 3)
    items = [(i, [float((i * 7 + d * d * 3) % 11) - 4 for d in range(4)], f"k{i % 13}") for i in range(100)]
    items += [(100 + i, items[5][1], "same") for i in range(30)] + [(200, None, "a"), (201, [0.0] * 4, "b"), (202, [1.0, 2.0], "c"), (203, [1.0, None, 2.0, 3.0], "d")]
    table = spark.createDataFrame(items, "vec_id long, embedding array<double>, near string").repartition(5)
    stated = table.filter("vec_id % 10 = 0 AND vec_id < 130").select(F.col("vec_id").alias("query_id"), "embedding")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 9)) for r in context.nearest(table, stated, near_key=near).collect())
    usable = [(i, v, n if near else None) for i, v, n in items if i < 202]
    assert got == brute_nearest(usable, [(i, v) for i, v, _ in items if i % 10 == 0 and i < 130])


def test_all_stated_vectors_are_searched(spark, sf_dir):
    got = sorted((r.query_id, r.rank, r.vec_id, r.similarity) for r in QUERIES["q35_similar_vectors"](spark, sf_dir).collect())
    sql = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM '{sf_dir}/embeddings.parquet'),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) AS s FROM e, e q WHERE q.vec_id % 100 = 0)
    SELECT query_id, rank, vec_id, round(s, 5) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 3 AND s >= 0.4 ORDER BY ALL"""
    assert got == [tuple(r) for r in duckdb.sql(sql).fetchall()]
    assert len({r[0] for r in got}) > 3


def test_partition_load_is_whole(spark, sf_dir):
    got = sorted((r.obs_id, r.partition, r.sample_weight, r.control) for r in QUERIES["q06_partition_load"](spark, sf_dir).collect())
    sql = f"""SELECT doc_id, 'train', 1.0::DOUBLE, n_chars FROM '{sf_dir}/documents.parquet' WHERE text IS NOT NULL AND substr(md5('7:' || doc_id), 1, 1) < '8' ORDER BY ALL"""
    assert got == [tuple(r) for r in duckdb.sql(sql).fetchall()]
    assert len(got) > 50


def test_first_rows_of_a_partition(spark):
    notes = spark.createDataFrame([(i, None if i == 2 else f"t{i}") for i in range(9, -1, -1)], "obs_id long, text string")
    index = spark.createDataFrame([(i, "test" if i == 0 else "train") for i in range(10)], "obs_id long, partition string")
    first = tables.load_partition(notes, index, "train", most=3)
    assert sorted(r.obs_id for r in first.collect()) == [1, 3, 4]
    assert tables.load_partition(notes, index, "train").count() == 8


def test_trainer_asks_about_new_notes(spark, tmp_path):
    """Notes that the cache lacks are answered for cached concepts too, each pair once."""
    asked = []

    class Counting(annotate.PatternAnnotator):
        def annotate(self, sections, concepts, keep):
            asked.append((sorted(r[0] for r in sections.select(keep[0]).distinct().collect()), [c["name"] for c in concepts]))
            return super().annotate(sections, concepts, keep)

    trainer = Trainer(spark, EnsembleConfig.from_args(init_seeds=[1]), str(tmp_path), Counting())
    text = trainer.config.data.text_summary_column
    notes = lambda ids: spark.createDataFrame([(i, 1, 1.0, "red" if i % 2 else "blue") for i in ids], f"obs_id long, y int, sample_weight double, `{text}` string")
    names = trainer._register([{"concept": w, "pattern": w} for w in ("red", "blue")])
    trainer._annotate(notes([1, 2]), names[:1])
    trainer._annotate(notes([1, 2, 3, 4]), names)
    trainer._annotate(notes([1, 2, 3, 4]), names)
    assert sorted(asked) == [([1, 2], ["c0"]), ([1, 2, 3, 4], ["c1"]), ([3, 4], ["c0"])]
    rows = {r.obs_id: (r.c0, r.c1) for r in trainer._matrix(notes([1, 2, 3, 4]), names).collect()}
    assert rows == {1: (1.0, 0.0), 2: (0.0, 1.0), 3: (1.0, 0.0), 4: (0.0, 1.0)}
    assert trainer.cache.count() == 8


def test_bootstrap_has_all_replicates(spark, sf_dir):
    row = QUERIES["q27_bootstrap_ci"](spark, sf_dir).first()
    assert row.n_replicates == 1000 and row.low < row.auc < row.high
