"""Splits and folds by seeded hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import seeded_key, with_rank


def _keys(df: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Distinct keys (with their smallest label): a key that repeats is one unit of a
    split, so that its rows never lie on both sides."""
    if label is None:
        return df.select(key).filter(F.col(key).isNotNull()).distinct()
    labelled = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    return labelled.groupBy(key).agg(F.min(label).alias(label))


def _joined(df: DataFrame, made: DataFrame, key: str, column: str) -> DataFrame:
    """The column back at all rows of its key; null where the key or each label of it is."""
    return df.drop(column).join(made.select(key, column), key, "left")


def stratified(df: DataFrame, key: str, label: str, train_share: float, seed: int) -> DataFrame:
    """Adds part (train or test; null without key or label). The train part has
    floor(n * share) keys; class quotas are rounded by largest remainder, smaller label
    first on ties."""
    whole, df = df, _keys(df, key, label)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()  # a row per class
    total = int(sum(r["n"] for r in counts) * train_share)
    quota = {r[label]: int(r["n"] * train_share) for r in counts}
    rest = sorted(counts, key=lambda r: (-(r["n"] * train_share - int(r["n"] * train_share)), r[label]))
    for r in rest[: total - sum(quota.values())]:
        quota[r[label]] += 1
    limit = F.lit(0)
    for y, n in quota.items():
        limit = F.when(F.col(label) == y, F.lit(n)).otherwise(limit)
    ranked = with_rank(df.withColumn("_order", seeded_key(seed, F.col(key))), [label], "_order", "_rank")
    return _joined(whole, ranked.withColumn("part", F.when(F.col("_rank") <= limit, "train").otherwise("test")), key, "part")


def folds(df: DataFrame, key: str, label: str, k: int, seed: int | str = 0) -> DataFrame:
    """Adds fold 1..k: equal parts of each class in seeded order, the first ones
    larger by one where the class does not divide; null without key or label. The seed
    must not be that of a split of the same rows, else parts and folds coincide."""
    whole, df = df, _keys(df, key, label)
    ranked = with_rank(df.withColumn("_order", seeded_key(seed, F.col(key))), [label], "_order", "_rank")
    size, extra = F.floor(F.col("_rank_of") / k), F.col("_rank_of") % k
    i = F.col("_rank") - 1
    large = extra * (size + 1)
    fold = F.when(i < large, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - large) / F.greatest(size, F.lit(1))))
    return _joined(whole, ranked.withColumn("fold", (fold + 1).cast("int")), key, "fold")


def fold_count(smallest_class: int, k: int = 5) -> int:
    return 2 if smallest_class < 3 else k


def global_split(df: DataFrame, key: str, test_share: float, seed: int) -> DataFrame:
    """The first n - floor(share * n) keys in seeded order are train; null without key."""
    whole, df = df, _keys(df, key)
    ranked = with_rank(df.withColumn("_order", seeded_key(seed, F.col(key))), [], "_order", "_rank")
    train = F.col("_rank_of") - F.floor(F.col("_rank_of") * test_share)
    return _joined(whole, ranked.withColumn("partition", F.when(F.col("_rank") <= train, "train").otherwise("test")), key, "partition")


def first_owner(rows: DataFrame, concept: Column, order: list[str]) -> DataFrame:
    """The first row of each concept in the given order (min over a struct: the sum
    is combined map-side, no window)."""
    rest = [c for c in rows.columns if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return rows.groupBy(concept.alias("_key")).agg(first).select("_first.*")
