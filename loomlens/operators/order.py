"""Ranks and running sums without a single task for all rows.

A global window would send every row to one task. Here rows are first dealt into
buckets that keep the order; ranks and sums within a bucket are moved up by the
totals of the buckets before it, a small table whose size does not depend on the
number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(seed: Column | int | str, key: Column) -> Column:
    """Hash whose order is the engine's deterministic randomness."""
    return F.md5(F.concat_ws(":", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), key.cast("string")).cast("binary"))


def with_rank(df: DataFrame, by: list[str], order: str, name: str = "rank", prefix: int = 4) -> DataFrame:
    """1-based rank in the order of the hexadecimal text column `order` within `by`,
    and the group's size as `{name}_of`. Buckets: the first `prefix` characters (65536 of them)."""
    bucketed = df.withColumn("_bucket", F.substring(order, 1, prefix))
    sizes = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), f"{name}_of": F.sum("_n").over(group)}).drop("_n")
    own = Window.partitionBy(*by, "_bucket").orderBy(order)
    ranked = bucketed.withColumn("_own", F.row_number().over(own)).join(sizes, [*by, "_bucket"])
    return ranked.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_bucket", "_before", "_own")


def score_bucket(score: Column, per_unit: int) -> Column:
    """Buckets of equal width in the logit of the score: scores of rare events, which
    lie close to 0 or 1, spread over many. Keeps the order: division and logarithm do."""
    p = F.least(F.greatest(score, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.floor(F.ln(p / (1 - p)) * per_unit)


def running(df: DataFrame, by: list[str], score: str, sums: dict[str, str], buckets: int = 128, descending: bool = False) -> DataFrame:
    """Sums per distinct score, and for each `x` of sums also `{x}_before` (all rows that
    come earlier) and `{x}_total` (the whole group). Scores go to `buckets` buckets per
    unit of their logit, about 9000 in all (scores outside of [0, 1] to the last ones). buckets = 0: one
    window for each group, where the number of its distinct scores is bounded."""
    sign = -1 if descending else 1
    cells = df.groupBy(*by, score).agg(*(F.sum(F.col(c)).alias(n) for n, c in sums.items()))
    if not buckets:
        own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        earlier = own.orderBy(F.col(score).desc() if descending else F.col(score).asc()).rowsBetween(Window.unboundedPreceding, -1)
        return cells.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in sums} | {f"{n}_total": F.sum(n).over(own) for n in sums})
    cells = cells.withColumn("_bucket", score_bucket(F.col(score), buckets) * sign)
    totals = cells.groupBy(*by, "_bucket").agg(*(F.sum(n).alias(f"_{n}") for n in sums))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_bucket", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_base") for n in sums), *(F.sum(f"_{n}").over(group).alias(f"{n}_total") for n in sums))
    own = Window.partitionBy(*by, "_bucket").orderBy(F.col(score).desc() if descending else F.col(score).asc()).rowsBetween(Window.unboundedPreceding, -1)
    out = cells.join(totals, [*by, "_bucket"])
    for n in sums:
        out = out.withColumn(f"{n}_before", F.col(f"_{n}_base") + F.coalesce(F.sum(n).over(own), F.lit(0)))
    return out.drop("_bucket", *(f"_{n}_base" for n in sums))
