"""Scores of linear models over the long annotation table, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sigmoid


def window(history: DataFrame, last: int | None = None, baseline: bool = False) -> DataFrame:
    """Iterations to use: the last N of each seed, or iteration 0."""
    if baseline:
        return history.filter("iter = 0")
    if last is None:
        return history
    ends = history.groupBy("seed").agg(F.max("iter").alias("_end"))
    return history.join(ends, "seed").filter(F.col("iter") > F.col("_end") - last).drop("_end")


def exclude(history_coef: DataFrame, concepts: list[str]) -> DataFrame:
    """Coefficients of the named concepts are 0 in each seed's last iteration."""
    ends = history_coef.groupBy("seed").agg(F.max("iter").alias("_end"))
    out = history_coef.join(ends, "seed")
    return out.withColumn("coef", F.when(F.col("concept").isin(concepts) & (F.col("iter") == F.col("_end")), 0.0).otherwise(F.col("coef"))).drop("_end")


def scores(annotations: DataFrame, history_iter: DataFrame, history_coef: DataFrame) -> DataFrame:
    """(obs_id, seed, iter, prob): one join on the concept and one sum per note and
    model. Models are few (seeds x iterations x goal rows), notes are not: the model
    side is small enough for Spark to broadcast by its own size check."""
    models = history_coef.join(history_iter.select("seed", "iter", "intercept"), ["seed", "iter"])
    notes = annotations.withColumn("concept_id", F.col("concept_id").cast("int"))
    joined = notes.join(models.select("seed", "iter", "concept_id", "coef", "intercept"), "concept_id")
    total = joined.groupBy("obs_id", "seed", "iter").agg((F.sum(F.col("answer") * F.col("coef")) + F.max("intercept")).alias("_z"))
    return total.select("obs_id", "seed", "iter", sigmoid(F.col("_z")).alias("prob"))


def seed_mean(model_scores: DataFrame) -> DataFrame:
    return model_scores.groupBy("seed", "obs_id").agg(F.avg("prob").alias("prob_1")).withColumn("prob_0", 1 - F.col("prob_1"))


def mean(model_scores: DataFrame) -> DataFrame:
    """Every (seed, iteration) weighs the same."""
    return model_scores.groupBy("obs_id").agg(F.avg("prob").alias("prob_1")).withColumn("prob_0", 1 - F.col("prob_1"))


def inclusion(history_coef: DataFrame, last: int = 5) -> DataFrame:
    """Occurrences of a concept in a seed's last min(last, n) iterations per iteration."""
    sizes = history_coef.groupBy("seed").agg(F.max("iter").alias("_end"), F.countDistinct("iter").alias("_n"))
    recent = history_coef.join(sizes, "seed").filter(F.col("iter") > F.col("_end") - F.least(F.lit(last), F.col("_n")))
    return recent.groupBy("seed", "concept").agg((F.count(F.lit(1)) / F.max(F.least(F.lit(last), F.col("_n")))).alias("inclusion"))
