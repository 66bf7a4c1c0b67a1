"""Correlation distance between concepts and single linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shelf


def valid_concepts(annotations: DataFrame, concept: str = "concept_id") -> DataFrame:
    """Concepts with answers, all finite, not all zero."""
    finite = ~(F.isnan("answer") | F.col("answer").isNull() | F.col("answer").isin(float("inf"), float("-inf")))
    return annotations.groupBy(concept).agg(F.min(finite).alias("ok"), F.max(F.abs("answer")).alias("top")).filter("ok and top > 0").select(concept)


def distances(annotations: DataFrame, concept: str = "concept_id", key: str = "obs_id") -> DataFrame:
    """(a, b, corr, distance) for a < b: 1 - |r|; with a constant vector 0 where all
    answers are equal, else 1. Pairs are made within a note's own answers (the
    number of concepts squared, whatever the number of notes) from one grouped row,
    and summed map-side."""
    per_note = annotations.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(concept).alias("c"), F.col("answer").alias("v")))).alias("_all"))
    pair = F.flatten(F.transform("_all", lambda x, i: F.transform(F.slice("_all", i + 2, F.size("_all")), lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b"), x["v"].alias("x"), y["v"].alias("y")))))
    pairs = per_note.select(F.inline(pair))
    stats = pairs.groupBy("a", "b").agg(F.covar_pop("x", "y").alias("cov"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.max(F.abs(F.col("x") - F.col("y"))).alias("gap"))
    r = F.try_divide(F.col("cov"), F.col("sx") * F.col("sy"))
    flat = (F.col("sx") == 0) | (F.col("sy") == 0)
    d = F.when(flat, F.when(F.col("gap") == 0, 0.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(r)))
    return stats.select("a", "b", F.when(~flat, r).alias("corr"), F.coalesce(d, F.lit(1.0)).alias("distance"))


def single_linkage(pairs: list[tuple], leaves: list) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, distance, size) from all pairs (a, b, distance) of a
    bounded number of concepts: edges by rising distance, joined by union-find; new
    nodes are numbered after the leaves. Fewer than two leaves give none."""
    if len(leaves) < 2:
        return []
    at = {x: i for i, x in enumerate(leaves)}
    parent, node, size = list(range(len(leaves))), list(range(len(leaves))), [1] * len(leaves)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    merges = []
    for d, i, j in sorted((d, *sorted((at[a], at[b]))) for a, b, d in pairs):
        x, y = root(i), root(j)
        if x == y:
            continue
        size[x] += size[y]
        merges.append((*sorted((node[x], node[y])), float(d), size[x]))
        parent[y], node[x] = x, len(leaves) + len(merges) - 1
    return merges


def tree(merges: list[tuple[int, int, float, int]], leaves: list) -> dict | None:
    """Nested nodes; the root is the last merge."""
    nodes: list[dict] = [{"name": x, "height": 0.0} for x in leaves]
    for left, right, d, n in merges:
        nodes.append({"children": [nodes[left], nodes[right]], "height": d, "size": n})
    return nodes[-1] if nodes else None


def hierarchy(annotations: DataFrame, concept: str = "concept_id") -> tuple[list, list[tuple[int, int, float, int]]]:
    """Leaves and merges of the valid concepts (a list bounded by the concept set)."""
    annotations = Shelf(annotations.sparkSession, "hierarchy").keep(annotations.select("obs_id", concept, "answer"), "answers")  # what made them runs once
    ok = valid_concepts(annotations, concept)
    leaves = sorted(r[0] for r in ok.collect())
    if len(leaves) < 2:
        return leaves, []
    found = distances(annotations.join(F.broadcast(ok), concept, "left_semi"), concept).select("a", "b", "distance").collect()
    return leaves, single_linkage([tuple(r) for r in found], leaves)


def fallback_hierarchy(concepts: list) -> dict | None:
    """A hierarchy where there are no merges: one concept is a leaf, two or three lie
    under one root, more are paired level by level in their order, an odd last node going up as it is.
    Concepts are a bounded list."""
    nodes: list[dict] = [{"name": c} for c in concepts]
    if len(nodes) < 2:
        return nodes[0] if nodes else None
    if len(nodes) <= 3:
        return {"name": "root", "children": nodes}
    while len(nodes) > 1:
        pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        nodes = [p[0] if len(p) == 1 else {"name": f"cluster_{i}", "children": p} for i, p in enumerate(pairs)]
    return nodes[0]


def shown(annotations: DataFrame, names: dict | None = None, concept: str = "concept_id") -> dict | None:
    """The tree of the valid concepts' linkage, or the fallback where fewer than two have one."""
    leaves, merges = hierarchy(annotations, concept)
    called = lambda c: (names or {}).get(c, c)
    if merges:
        return tree(merges, [called(c) for c in leaves])
    every = sorted(r[0] for r in annotations.select(concept).distinct().collect())  # a row for each concept
    return fallback_hierarchy([called(c) for c in every])
