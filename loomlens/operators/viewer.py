"""Reviewer-facing queries: filtered pages, assigned concepts, exports, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(query: str, columns: list[str]) -> Column:
    """Literal search without case in any of the columns; null is empty."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(query.lower())
    return hit


def filtered(rows: DataFrame, query: str | None = None, columns: list[str] | None = None, partition: str | None = None, annotations: DataFrame | None = None, concept_id: int | None = None, key: str = "obs_id") -> DataFrame:
    """Search and partition and assigned concept, each where given."""
    if query:
        rows = rows.filter(matches(query, columns or ["text"]))
    if partition is not None:
        rows = rows.filter(F.col("partition") == partition)
    if concept_id is not None:
        held = annotations.filter((F.col("concept_id") == concept_id) & (F.col("answer") > 0.5)).select(key)
        rows = rows.join(held, key, "left_semi")
    return rows


def page(rows: DataFrame, number: int, size: int = 20, key: str = "obs_id") -> DataFrame:
    return rows.orderBy(key).offset((number - 1) * size).limit(size)


def assigned(annotations: DataFrame, names: Column, key: str = "obs_id", order: str = "concept_id") -> DataFrame:
    """Names of concepts with an answer over 0.5, in concept order, as an array."""
    held = annotations.filter("answer > 0.5").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), names.alias("name")))).alias("_all"))
    return held.select(key, F.transform("_all", lambda x: x["name"]).alias("assigned"))


def grouped(marks: DataFrame, key: str = "obs_id") -> DataFrame:
    """Reviewers' text selections (obs_id, source, text, concept) by observation."""
    return marks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("source", "text", "concept"))).alias("marks"))


def with_notes(groups: DataFrame, notes: DataFrame, key: str = "obs_id") -> DataFrame:
    return groups.join(notes, key, "left")


def example_rows(summaries: DataFrame) -> DataFrame:
    """One JSON text per summary; needs id, summary and label, takes length_of_stay
    and outcome where they exist."""
    need = ["id", "summary", "label"]
    missing = [c for c in need if c not in summaries.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    also = [c for c in ("length_of_stay", "outcome") if c in summaries.columns]
    return summaries.select(F.to_json(F.struct(*need, *also)).alias("json"))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def without(df: DataFrame, parts: tuple[str, ...] = ("pred_prob", "risk_class", "risk_score"), names: tuple[str, ...] = ("enc_id", "y", "sentence")) -> DataFrame:
    """Drops columns whose name holds a part, and the named ones."""
    return df.drop(*(c for c in df.columns if c in names or any(p in c for p in parts)))
