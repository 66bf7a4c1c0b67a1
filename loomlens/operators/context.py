"""Where phrases occur: sentences, similarity search, evidence lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sentences(df: DataFrame, text: str, keep: list[str], least: int = 20) -> DataFrame:
    """Trimmed parts between full stops of more than `least` characters."""
    parts = F.transform(F.split(F.col(text), r"\.", -1), lambda s: F.trim(s))
    return df.select(*keep, F.posexplode(parts).alias("position", "sentence")).filter(F.length("sentence") > least)


#: Rows of a block of items and of queries: what one step holds is bounded by both.
ITEM_BLOCK, QUERY_BLOCK = 4096, 256
BLOCK = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()))


def blocks(df: DataFrame, key: str, vector: str, near_key: str | None, size: int, buckets: int) -> DataFrame:
    """(bucket, dim, ids, data, near): up to `size` vectors of one length in a row, as
    bytes of doubles; bucket: the turn of the block. Rows without id, without vector
    or with a null in it are left out: they have no cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                for i in range(0, part.num_rows, size):
                    ids, vectors, near = part.slice(i, size).columns
                    row = [turn % buckets, int(dim), ids.to_numpy().tobytes(), vectors.flatten().to_numpy().tobytes(), near.to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, BLOCK, strict=True)], names=["bucket", "dim", "ids", "data", "near"])
                    turn += 1

    whole = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    near = F.col(near_key).cast("string") if near_key else F.lit(None).cast("string")
    rows = df.filter(whole).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), near.alias("near"))
    return rows.mapInArrow(run, "bucket int, dim int, ids binary, data binary, near array<string>")


def summed(a: np.ndarray, b: np.ndarray, i, j) -> np.ndarray:
    """Dot products of rows i of a and j of b, added in the order of the elements, so
    that equal vectors have equal products wherever they lie."""
    out = np.zeros(len(a[i]))
    for x, y in zip(a.T, b.T, strict=True):
        out += x[i] * y[j]
    return out


def unit_rows(data: bytes, dim: int) -> np.ndarray:
    v = np.frombuffer(data).reshape(-1, dim)
    every = slice(None)
    with np.errstate(divide="ignore", invalid="ignore"):
        return v / np.sqrt(summed(v, v, every, every))[:, None]


def best_of_block(items: np.ndarray, ids: np.ndarray, near: np.ndarray | None, queries: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, item row, similarity) of the k best of a block for each query; of
    items with one `near` code the best. The product of matrices only finds rows
    that may be among them."""
    rough = queries @ items.T
    rough[np.isnan(rough)] = -np.inf
    columns = rough
    if near is not None:
        order = np.argsort(near, kind="stable")
        columns = np.maximum.reduceat(rough[:, order], np.flatnonzero(np.diff(near[order], prepend=near[order][0] - 1)), axis=1)
    limit = np.partition(columns, -k, axis=1)[:, -k] if columns.shape[1] > k else np.full(len(queries), -np.inf)
    q, i = np.nonzero(rough >= np.maximum(limit, least)[:, None] - 1e-9)
    s = summed(queries, items, q, i)
    order = np.lexsort((ids[i], -s, q))
    q, i, s = (x[order][(s >= least)[order]] for x in (q, i, s))
    if near is not None:
        first = np.sort(np.unique(np.stack([q, near[i]]), axis=1, return_index=True)[1])
        q, i, s = q[first], i[first], s[first]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], i[keep], s[keep]


def nearest(items: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int = 3, least: float = 0.4, item: str = "vec_id", vector: str = "embedding", near_key: str | None = None, query: str = "query_id") -> DataFrame:
    """Per query the k items of largest cosine of at least `least`, equal ones by id;
    of items with one near_key the best stays. queries: a table (query, vector) of
    any size, or a list of them.

    Plan: both tables become blocks of bounded size; item blocks are dealt over
    buckets, each of which gets all query blocks. A pair of blocks is one product of
    matrices and gives at most k rows per query; the best of them are kept by an
    aggregate of k rows per task. Nothing goes through the driver."""
    spark = items.sparkSession
    if isinstance(queries, list):
        queries = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], f"{query} long, {vector} array<double>")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks(queries, query, vector, None, QUERY_BLOCK, buckets).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    pairs = blocks(items, item, vector, near_key, ITEM_BLOCK, buckets).join(asked, ["bucket", "dim"]).select("dim", "ids", "data", "near", "q_ids", "q_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                dim, ids, data, near, q_ids, q_data = (c[n] for c in batch.columns)
                dim, ids, q_ids = dim.as_py(), np.frombuffer(ids.as_py(), np.int64), np.frombuffer(q_ids.as_py(), np.int64)
                codes = near.values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if near_key else None
                q, i, s = best_of_block(unit_rows(data.as_py(), dim), ids, codes, unit_rows(q_data.as_py(), dim), k, least)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(ids[i]), pa.array(s), near.values.take(pa.array(i))], names=["query_id", item, "similarity", "_near"])

    return ranked(pairs.mapInArrow(run, f"query_id long, `{item}` long, similarity double, _near string"), k, item, near_key is not None)


def ranked(hits: DataFrame, k: int, item: str, near: bool) -> DataFrame:
    """(query_id, rank, item, similarity) of the k best hits of each query; of hits
    with one _near the best. At most k rows of each of 64 parts are gathered for a query."""
    if near:
        best = F.max_by(F.struct(item, "similarity"), F.struct("similarity", -F.col(item))).alias("_b")
        hits = hits.groupBy("query_id", "_near").agg(best).select("query_id", "_b.*")
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("_m"), F.col(item).alias(item)))), 1, k)
    local = Window.partitionBy("query_id", F.pmod(F.hash(item), F.lit(64))).orderBy(F.col("similarity").desc(), item)
    few = hits.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= k)
    found = few.groupBy("query_id").agg(top.alias("_top")).select("query_id", F.posexplode("_top").alias("_p", "_t"))
    return found.select("query_id", (F.col("_p") + 1).cast("long").alias("rank"), F.col(f"_t.{item}").alias(item), (-F.col("_t._m")).alias("similarity"))


PARTS = 64  # parts of a phrase's hits of which the first ones are taken before they meet


def first_of(hits: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """(by, found): the first k hits of each `by`, as an array of (order, rest) structs. A phrase may be
    in nearly every note: a part of its hits keeps k before they meet in one task."""
    local = Window.partitionBy(by, F.pmod(F.hash(*order), F.lit(PARTS))).orderBy(*order)
    few = hits.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= k)
    rest = [c for c in hits.columns if c not in (by, *order)]
    return few.groupBy(by).agg(F.slice(F.sort_array(F.collect_list(F.struct(*order, *rest))), 1, k).alias("found"))


def lookup(notes: DataFrame, phrases: list[str], text: str = "text", key: str = "obs_id", most: int = 2, regex: bool = False) -> DataFrame:
    """(phrase, obs_id, sentence): the first matching sentence of each note for each
    phrase, of the first `most` notes by key. Literal by default."""
    rows = sentences(notes, text, [key])
    low = F.lower("sentence")
    hits = [F.struct(F.lit(p).alias("phrase"), (F.regexp_like(low, F.lit(p.lower())) if regex else low.contains(p.lower())).alias("hit")) for p in phrases]
    found = rows.select(key, "position", "sentence", F.inline(F.array(*hits))).filter("hit")
    first = found.groupBy("phrase", key).agg(F.min_by("sentence", "position").alias("sentence"))
    return first_of(first, "phrase", [key], most).select("phrase", F.inline("found"))


def contexts(phrases: DataFrame, evidence: DataFrame, exact: DataFrame, similar: DataFrame, quota: int) -> DataFrame:
    """Contexts of each phrase in the order evidence, exact, semantic, up to the
    quota, and a tag: evidence or exact (the quota is full by then), semantic (its
    hits added some), partial (some, none semantic), none.
    Each source: (phrase, obs_id, context)."""
    every = evidence.withColumn("source", F.lit(1)).unionByName(exact.withColumn("source", F.lit(2))).unionByName(similar.withColumn("source", F.lit(3)))
    best = first_of(every, "phrase", ["source", "obs_id", "context"], quota)
    out = phrases.select("phrase").join(best, "phrase", "left")
    count = lambda s: F.size(F.filter("found", lambda f: f["source"] <= s))
    tag = F.when(F.col("found").isNull(), "none").when(count(1) >= quota, "evidence").when(count(2) >= quota, "exact").when(count(3) > count(2), "semantic").otherwise("partial")
    return out.select("phrase", tag.alias("tag"), F.transform("found", lambda f: f["context"]).alias("contexts"))


def evidence_hits(evidence: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase, obs_id, context) from (obs_id, evidence map): the entry of a phrase,
    equal or with either text within the other; one hit per note, equal ones first."""

    def hit(phrase: str) -> Column:
        p = F.lit(phrase.lower())
        entries = F.map_entries("evidence")
        equal = F.filter(entries, lambda e: F.lower(e["key"]) == p)
        within = F.filter(entries, lambda e: F.contains(F.lower(e["key"]), p) | F.contains(p, F.lower(e["key"])))
        return F.get(F.concat(equal, within), F.lit(0))["value"]

    made = F.array(*(F.struct(F.lit(p).alias("phrase"), hit(p).alias("context")) for p in phrases))
    return evidence.select("obs_id", F.inline(made)).filter(F.col("context").isNotNull()).select("phrase", "obs_id", "context")


def similar_sentences(items: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int = 3, least: float = 0.4, width: int = 250) -> DataFrame:
    """Nearest sentences (sentence_id, sentence, vector) per stated query: of those
    whose first 50 characters agree without case the best stays; texts are cut to
    `width` characters."""
    keyed = items.withColumn("_near", F.lower(F.substring("sentence", 1, 50)))
    found = nearest(keyed, queries, k, least, "sentence_id", "vector", "_near")
    return found.join(items.select("sentence_id", F.substring("sentence", 1, width).alias("sentence")), "sentence_id")
