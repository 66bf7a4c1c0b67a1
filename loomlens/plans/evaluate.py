"""Evaluation of predictions: slices, intervals, prevalences. The scored rows are
written once to the shared folder and serve every slice; slices are group keys, so nothing is
annotated again and no job runs for a slice of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..operators import annotate, metrics, resample
from ..shared import Shelf
from ..sources.tables import without_overlap


def simple_metrics(rows: DataFrame) -> DataFrame:
    """rows: y, prob -> auc, accuracy at 0.5, n_samples, positive_rate."""
    base = rows.agg(metrics.accuracy().alias("accuracy"), F.count(F.lit(1)).alias("n_samples"), F.avg("y").alias("positive_rate"))
    return metrics.auc(rows, []).withColumn("_k", F.lit(1)).join(base.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each


def evaluate(rows: DataFrame, sensitivity: float = 0.98, domain: str | None = None, age: str | None = None, cutoff: float | None = None, replicates: int = 1000, seed: int = 0, key: str = "obs_id", weight: str | None = "sample_weight") -> DataFrame:
    """rows: key, y, prob, weight and slice columns. Per slice: auc (weighted) and
    specificity (unweighted) with percentile intervals and their texts."""
    labels = [F.lit("all")]
    if domain:
        labels.append(F.col(domain).cast("string"))
    if age and cutoff is not None:
        labels.append(F.when(F.col(age) < cutoff, F.lit(f"age_below_{cutoff:g}")).otherwise(F.lit(f"age_above_{cutoff:g}")))
    columns = [key, "y", "prob", *([weight] if weight else [])]
    sliced = rows.withColumn("domain_slice", F.explode(F.array(*labels))).select("domain_slice", *dict.fromkeys(columns))
    sliced = Shelf(rows.sparkSession, "evaluate").keep(sliced, "sliced")
    by = ["domain_slice"]
    out = metrics.metric_rows(sliced, by, sensitivity, weight)
    a = resample.bootstrap(sliced, by, replicates, seed, weight, key=key).select(*by, F.col("low").alias("auc_low"), F.col("high").alias("auc_high"))
    s = resample.bootstrap(sliced.filter(metrics.whole(weight)), by, replicates, seed, sensitivity=sensitivity, key=key).select(*by, F.col("low").alias("spec_low"), F.col("high").alias("spec_high"))
    joined = out.join(a, by, "left").join(s, by, "left")
    return joined.withColumns({"auc_str": metrics.interval_text(F.col("auc"), F.col("auc_low"), F.col("auc_high")), "specificity_str": metrics.interval_text(F.col("specificity"), F.col("spec_low"), F.col("spec_high"))})


def predictions(notes: DataFrame, predicted: DataFrame, training: DataFrame | None = None, key: str = "obs_id") -> DataFrame:
    """Notes that training did not see, with prob_0 and prob_1 by key."""
    rows = without_overlap(notes, training, key) if training is not None else notes
    return rows.join(predicted, key)


def prevalence_table(annotations: DataFrame) -> DataFrame:
    out = annotate.prevalence(annotations)
    said = lambda c: F.coalesce(fixed(F.col(c), 2), F.lit("null"))
    return out.withColumn("text", F.concat(said("prevalence"), F.lit(" ("), said("low"), F.lit(", "), said("high"), F.lit(")")))
