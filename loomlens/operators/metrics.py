"""Classification metrics over scored rows (y 0/1, prob, weight), by any slice columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, fixed
from .order import running


def whole(weight: str | None = None) -> Column:
    """Whether a row has a score, a label and a weight; others take no part in a metric."""
    out = F.col("prob").isNotNull() & F.col("y").isNotNull()
    return out if weight is None else out & F.col(weight).isNotNull()


def auc(df: DataFrame, by: list[str], weight: str | None = None, buckets: int = 128) -> DataFrame:
    """Weighted area under the ROC curve: pairs of a positive and a negative, ties
    half. Null where a slice has one class only."""
    df = df.filter(whole(weight))
    w = F.lit(1.0) if weight is None else F.col(weight)
    sums = df.select(*by, "prob", F.when(F.col("y") == 1, w).otherwise(0.0).alias("_pos"), F.when(F.col("y") == 0, w).otherwise(0.0).alias("_neg"))
    cells = running(sums, by, "prob", {"pos": "_pos", "neg": "_neg"}, buckets)
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return cells.groupBy(*by).agg(F.try_divide(won, F.max("pos_total") * F.max("neg_total")).alias("auc"))


def multiclass_auc(df: DataFrame, by: list[str], classes: dict, weight: str | None = None) -> DataFrame:
    """Mean over the classes of the area of each against the rest. classes: value of
    y -> column with its score (in [0, 1]). Null if a class lacks rows or has all.
    All classes are group keys of one plan."""
    each = F.array(*(F.struct(F.lit(str(c)).alias("_class"), (F.col("y") == F.lit(c)).cast("int").alias("_is"), F.col(p).cast("double").alias("_p")) for c, p in classes.items()))
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = df.select(*by, w.alias("_w"), F.explode(each).alias("_e")).select(*by, "_w", F.col("_e._class"), F.col("_e._is").alias("y"), F.col("_e._p").alias("prob"))
    one = auc(rows, [*by, "_class"], "_w")
    whole = F.when(F.count("auc") == len(classes), F.avg("auc"))
    return one.groupBy(*by).agg(whole.alias("auc"))


def specificity_at(df: DataFrame, by: list[str], sensitivity: float, weight: str | None = None, buckets: int = 128) -> DataFrame:
    """1 - false positive rate at the highest threshold whose sensitivity reaches
    the target (all thresholds are looked at, none is merged)."""
    df = df.filter(whole(weight))
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    sums = df.select(*by, "prob", F.when(F.col("y") == 1, w).otherwise(0).alias("_pos"), F.when(F.col("y") == 0, w).otherwise(0).alias("_neg"))
    cells = running(sums, by, "prob", {"pos": "_pos", "neg": "_neg"}, buckets, descending=True)
    tpr = F.try_divide(F.col("pos_before") + F.col("pos"), F.col("pos_total"))
    fpr = F.try_divide(F.col("neg_before") + F.col("neg"), F.col("neg_total"))
    return cells.filter(tpr >= sensitivity).withColumn("_s", 1 - fpr).groupBy(*by).agg(F.max_by("_s", "prob").alias("specificity"), F.max("prob").alias("threshold"))


def roc_points(df: DataFrame, by: list[str]) -> DataFrame:
    df = df.filter(whole())
    sums = df.select(*by, "prob", (F.col("y") == 1).cast("long").alias("_pos"), (F.col("y") == 0).cast("long").alias("_neg"))
    cells = running(sums, by, "prob", {"pos": "_pos", "neg": "_neg"}, descending=True)
    return cells.select(*by, F.col("prob").alias("threshold"), F.try_divide(F.col("neg_before") + F.col("neg"), F.col("neg_total")).alias("fpr"), F.try_divide(F.col("pos_before") + F.col("pos"), F.col("pos_total")).alias("tpr"))


def accuracy(threshold: float = 0.5, weight: str | None = None) -> Column:
    w = F.lit(1.0) if weight is None else F.col(weight)
    right = (F.col("prob") > threshold).cast("int") == F.col("y")
    return F.sum(F.when(whole(weight) & right, w).when(whole(weight), 0.0)) / F.sum(F.when(whole(weight), w))


def log_likelihood() -> Column:
    p = clip(F.col("prob"))
    return F.sum(F.when(F.col("prob").isNull(), None).when(F.col("y") == 1, F.ln(p)).when(F.col("y").isNotNull(), F.ln(1 - p)))


def interval_text(value: Column, low: Column, high: Column) -> Column:
    said = lambda x: F.coalesce(fixed(x, 3), F.lit("null"))
    return F.when(low.isNull(), F.concat(said(value), F.lit(" (CI unavailable)"))).otherwise(F.concat(said(value), F.lit(" ("), said(low), F.lit(", "), said(high), F.lit(")")))


def calibration(df: DataFrame, edges: list[float]) -> DataFrame:
    """Mean label and score per bin; the bin is the number of interior edges strictly
    below the score; empty bins do not appear. Scores outside [0, 1] raise."""
    inner = F.array(*(F.lit(float(e)) for e in edges[1:-1]))
    p = F.when((F.col("prob") < 0) | (F.col("prob") > 1), F.raise_error(F.lit("scores must lie in [0, 1]")).cast("double")).otherwise(F.col("prob"))
    checked = df.withColumn("_p", p)
    bin_ = F.size(F.filter(inner, lambda e: e < F.col("_p")))
    return checked.groupBy(bin_.alias("bin")).agg(F.avg("y").alias("mean_y"), F.avg("_p").alias("mean_prob"), F.count(F.lit(1)).alias("n"))


def quantile_edges(df: DataFrame, bins: int) -> list[float]:
    inner = df.agg(F.percentile("prob", F.array(*(F.lit(i / bins) for i in range(1, bins))))).first()[0]
    return [0.0, *inner, 1.0]


def with_slices(df: DataFrame, domain: str, control: str, cutoff: float) -> DataFrame:
    """Each row under `all`, its domain, and its side of the cutoff: one plan for all
    slices instead of a query for each."""
    side = F.when(F.col(control) < cutoff, F.lit(f"age_below_{cutoff:g}")).otherwise(F.lit(f"age_above_{cutoff:g}"))
    return df.withColumn("slice", F.explode(F.array(F.lit("all"), F.col(domain), side)))


def metric_rows(df: DataFrame, by: list[str], sensitivity: float, weight: str | None = None) -> DataFrame:
    """auc (weighted), specificity (unweighted), n_samples and positive_rate of the rows
    that have a score, a label and a weight; n_left_out counts the others."""
    ok = whole(weight)
    clipped = df.filter(ok).withColumn("prob", clip(F.col("prob")))
    base = df.groupBy(*by).agg(F.count_if(ok).alias("n_samples"), F.avg(F.when(ok, F.col("y"))).alias("positive_rate"), F.count_if(~ok).alias("n_left_out"))
    return base.join(auc(clipped, by, weight), by, "left").join(specificity_at(clipped, by, sensitivity).drop("threshold"), by, "left")
