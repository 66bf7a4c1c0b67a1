"""Answers of a language model: parsing, repair, scatter, evidence, cards."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RESPONSE, VALUE_TYPES


def repair(text: str | None) -> str | None:
    """Valid JSON from a cut-off or over-long object: closes open strings and
    brackets and drops what follows the last complete value. Null if nothing helps."""
    if text is None:
        return None
    begin = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    body, stack, inside, escaped = text[begin:], [], False, False
    safe: list[tuple[int, tuple[str, ...]]] = []
    for i, ch in enumerate(body):
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if not stack or stack.pop() != ch:
                break
            safe.append((i + 1, tuple(stack)))
            if not stack:
                break
        elif ch == ",":
            safe.append((i, tuple(stack)))
    whole = body + ('"' if inside else "") + "".join(reversed(stack))
    for candidate in [whole, *(body[:i] + "".join(reversed(s)) for i, s in reversed(safe))]:
        try:
            return json.dumps(json.loads(candidate))
        except ValueError:
            continue
    return None


def repaired(text: Column) -> Column:
    """Repairs only what does not parse as it is."""

    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        return series.map(repair)

    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(run(text))


def answers(responses: DataFrame, key: list[str], json_col: str, n_questions: Column | int) -> DataFrame:
    """(key, question, answer): one row for each question 1..n. A null or broken
    response gives zeros, questions out of range are dropped, of repeated ones the
    last wins, and a question without an answer has 0."""
    n = n_questions if isinstance(n_questions, Column) else F.lit(n_questions)
    parsed = F.from_json(F.col(json_col), f"extractions array<{RESPONSE.simpleString()}>")["extractions"]
    return responses.select(*key, n.cast("int").alias("_n"), parsed.alias("_items")).select(*key, F.posexplode(scattered(F.col("_items"), F.col("_n"))).alias("question", "answer")).withColumn("question", F.col("question") + 1)


def scattered(items: Column, n: Column) -> Column:
    """Array of n answers from array<struct<question, answer>>."""
    last = lambda q: F.element_at(F.filter(F.coalesce(items, F.array().cast(f"array<{RESPONSE.simpleString()}>")), lambda r: (r["question"] == q) & r["answer"].isNotNull()), -1)
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    some = lambda q: F.size(F.filter(F.coalesce(items, F.array().cast(f"array<{RESPONSE.simpleString()}>")), lambda r: (r["question"] == q) & r["answer"].isNotNull())) > 0
    return F.transform(numbers, lambda q: F.when(some(q), last(q)["answer"]).otherwise(F.lit(0.0)))


def evidence_map(pairs: Column) -> Column:
    """Phrase -> evidence from array<struct<phrase, evidence>>: phrases are split at
    commas and trimmed, empty ones dropped, later ones win."""
    flat = F.flatten(F.transform(pairs, lambda p: F.transform(F.split(p["phrase"], ","), lambda x: F.struct(F.trim(x).alias("key"), p["evidence"].alias("value")))))
    kept = F.filter(flat, lambda e: e["key"] != "")
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def valid_concept(concept: Column, words: Column) -> Column:
    return concept.isNotNull() & (F.length(F.trim(concept)) > 0) & (F.size(F.coalesce(words, F.array().cast("array<string>"))) > 0)


def valid_value_type(kind: Column) -> Column:
    return kind.isin(*VALUE_TYPES)


def with_priors(candidates: DataFrame, priors: DataFrame, default: float = 0.1) -> DataFrame:
    """candidates (candidate_id, ...) with prior from priors (candidate_id, prior
    [, position]): of several for a candidate the one of the last position, and
    without positions the largest."""
    known = priors.filter("prior is not null")
    best = F.max_by("prior", "position") if "position" in priors.columns else F.max("prior")
    named = known.groupBy("candidate_id").agg(best.alias("prior"))
    return candidates.drop("prior").join(named, "candidate_id", "left").withColumn("prior", F.coalesce("prior", F.lit(default)))


def card_row(cards: DataFrame) -> DataFrame:
    """Nested cards as flat text rows."""
    spans = F.array_join(F.transform("evidence", lambda e: F.concat_ws(" | ", e["span"], e["date"], e["loc"])), "; ")
    return cards.select(
        "concept", "value_type",
        F.array_join("rubric.positive", "; ").alias("positive"),
        F.array_join("rubric.negative", "; ").alias("negative"),
        spans.alias("evidence"),
        F.to_json("derived").alias("derived"),
        F.coalesce("prior", F.lit(0.1)).alias("prior"),
    )
