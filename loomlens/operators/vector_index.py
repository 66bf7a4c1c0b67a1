"""Approximate nearest vectors by an inverted file.

Centroids come from a bounded sample (the SAMPLE rows of smallest seeded hash), every row is assigned
to the list of its nearest centroid, and a query looks at the lists of its `probes`
nearest centroids only. How many those must be is measured: against the exact search for TRIED of
the queries, up to the target recall (all lists, hence the exact result, if fewer don't do).

Vectors without id, null ones and those with a null are left out, as in the exact search;
vectors of another width than the sample's most frequent one have a list of their
width, which queries of that width look at. Lists are stored in blocks of bounded size
by id, so that one which holds many rows (copies) is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shelf
from ..shipping import ship
from . import context
from .order import seeded_key

SAMPLE = 20_000  # rows that centroids are fitted to
MOST_LISTS = 4096
ROUNDS = 12
TRIED = 64  # queries whose exact result recall is measured by
TARGET = 0.95


def centroids_of(vectors: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means from evenly spaced rows of the sample; empty ones stay."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors[size[:, 0] > 0] / size[size[:, 0] > 0]
    if not len(unit):
        return np.zeros((0, vectors.shape[1]))
    out = unit[np.linspace(0, len(unit) - 1, min(lists, len(unit))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(unit @ out.T, 1)
        total = np.zeros_like(out)
        np.add.at(total, own, unit)
        norm = np.linalg.norm(total, axis=1)
        out[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return out


def _rows(df: DataFrame, key: str, vector: str, near_key: str | None) -> DataFrame:
    near = F.col(near_key).cast("string") if near_key else F.lit(None).cast("string")
    whole = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    return df.filter(whole).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), near.alias("near"))


def _listed(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(list, id, v, near) for each of the nearest `probes` lists of a row; list < 0: by width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                n = part.num_rows
                if dim != centroids.shape[1] or not len(centroids):
                    at, lists = np.arange(n), np.full(n, -int(dim))
                else:
                    near = np.nan_to_num(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim), posinf=0, neginf=0) @ centroids.T
                    most = min(probes, len(centroids))
                    lists = np.argsort(-near, axis=1, kind="stable")[:, :most].reshape(-1)
                    at = np.repeat(np.arange(n), most)
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *taken.columns], names=["list", "id", "v", "near"])

    return rows.mapInArrow(run, "list int, id long, v array<double>, near string")


def _blocks(listed: DataFrame, size: int) -> DataFrame:
    """(list, dim, ids, v, near) in blocks of about `size` rows of one list."""
    # a row for each list, of which there are at most MOST_LISTS and one for each odd width
    counts = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {k: -(-n // size) for k, n in counts.items() if n > size}
    salt = F.lit(0)
    if parts:
        table = F.create_map(*(F.lit(x) for kv in parts.items() for x in kv))
        salt = F.pmod(F.xxhash64("id"), F.coalesce(F.try_element_at(table, F.col("list")), F.lit(1))).cast("int")
    packed = listed.groupBy("list", salt.alias("salt")).agg(F.sort_array(F.collect_list(F.struct("id", "near", "v"))).alias("rows"))
    each = lambda f: F.transform("rows", lambda r: r[f])
    return packed.select("list", F.size(F.col("rows")[0]["v"]).alias("dim"), each("id").alias("ids"), F.flatten(each("v")).alias("data"), each("near").alias("near"))


@dataclass
class Index:
    centroids: np.ndarray
    table: DataFrame
    near: bool

    @classmethod
    def build(cls, items: DataFrame, item: str = "vec_id", vector: str = "embedding", near_key: str | None = None, lists: int | None = None, sample: int = SAMPLE, seed: int = 0) -> "Index":
        """Lists: about the square root of the number of rows, unless given."""
        ship(items.sparkSession)
        rows = _rows(items, item, vector, near_key)
        picked = rows.select("v").orderBy(seeded_key(seed, F.col("id")), "id").limit(sample).toArrow()
        taken = picked.column("v").to_pylist()
        dims = np.bincount([len(v) for v in taken]) if taken else np.zeros(1, int)
        dim = int(np.argmax(dims))
        own = [v for v in taken if len(v) == dim]
        found = np.array(own, float).reshape(len(own), dim)
        found = found[np.isfinite(found).all(1)]
        n = lists or min(MOST_LISTS, max(1, int(rows.count() ** 0.5)))
        centroids = centroids_of(found, n)
        shelf = Shelf(items.sparkSession, "index")
        listed = shelf.keep(_listed(rows, centroids, 1), "listed")
        table = shelf.keep(_blocks(listed, context.ITEM_BLOCK), "blocks")
        shelf.drop("listed")
        return cls(centroids, table, near_key is not None)

    def search(self, queries: DataFrame, k: int, probes: int, least: float = -1.0, item: str = "vec_id", vector: str = "embedding", query: str = "query_id") -> DataFrame:
        """(query_id, rank, item, similarity) of the best in the probed lists, ordered as in the exact search."""
        shelf, near = Shelf(queries.sparkSession, "search"), self.near
        asked = shelf.keep(_listed(_rows(queries, query, vector, None), self.centroids, probes), "asked")
        blocks = _blocks(asked, context.QUERY_BLOCK).select("list", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
        pairs = self.table.join(shelf.keep(blocks, "queries"), "list").select("dim", "ids", "data", "near", "q_ids", "q_data")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    dim, ids, data, names, q_ids, q_data = (c[n] for c in batch.columns)
                    dim, (ids, q_ids) = dim.as_py(), (x.values.to_numpy() for x in (ids, q_ids))
                    codes = names.values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if near else None
                    unit = [context.unit_rows(x.values.to_numpy(zero_copy_only=False).astype(float).tobytes(), dim) for x in (data, q_data)]
                    q, i, s = context.best_of_block(unit[0], ids, codes, unit[1], k, least)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(ids[i]), pa.array(s), names.values.take(pa.array(i))], names=["query_id", item, "similarity", "_near"])

        return context.ranked(pairs.mapInArrow(run, f"query_id long, `{item}` long, similarity double, _near string"), k, item, near)


def recall(found: DataFrame, exact: DataFrame, item: str = "vec_id") -> float:
    """Share of the exact hits that were found (1 without hits)."""
    both = exact.select("query_id", item).join(found.select("query_id", F.col(item), F.lit(1).alias("_hit")), ["query_id", item], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(1.0))).first()[0]


def nearest(items: DataFrame, queries: DataFrame, k: int = 3, least: float = 0.4, item: str = "vec_id", vector: str = "embedding", near_key: str | None = None, query: str = "query_id", target: float = TARGET, index: Index | None = None) -> tuple[DataFrame, float, int]:
    """The search through an index at the smallest tried number of probes that reaches the
    target. -> (hits, measured recall, probes)."""
    index = index or Index.build(items, item, vector, near_key)
    shelf = Shelf(items.sparkSession, "tuning")
    tried = shelf.keep(queries.orderBy(seeded_key(1, F.col(query)), query).limit(TRIED).repartition(4), "tried")
    exact = shelf.keep(context.nearest(items, tried, k, least, item, vector, near_key, query), "exact")
    lists, probes = max(1, len(index.centroids)), 1
    probes = max(1, lists // 32)
    while True:
        share = 1.0 if probes >= lists else recall(index.search(tried, k, probes, least, item, vector, query), exact, item)
        if share >= target or probes >= lists:
            break
        probes = min(lists, probes * 2)
    return index.search(queries, k, probes, least, item, vector, query), share, probes
