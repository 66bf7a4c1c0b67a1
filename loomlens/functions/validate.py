"""Validation with quarantine: lenient JSON, coercions and rules, in Catalyst expressions.

A row is accepted if no rule fails, and else rejected with the names of those that do;
both come from one pass, and an `Observation` counts them while it runs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .responses import repair

#: An object whose braces nest up to four deep; strings may hold braces.
_STRING = r'"(?:\\.|[^"\\])*+"'


def _object(depth: int) -> str:
    inner = rf'(?:{_STRING}|[^{{}}"]' + (rf"|{_object(depth - 1)}" if depth else "") + ")*+"
    return rf"\{{{inner}\}}"


OBJECT = _object(3)


def without_comments(text: Column) -> Column:
    """Without what follows // on a line, except in strings."""
    return F.regexp_replace(text, rf"({_STRING})|//[^\n]*", "$1")


def objects(text: Column) -> Column:
    """The JSON objects of a text, in order, as texts; those that don't parse are left out."""
    found = F.regexp_extract_all(without_comments(F.coalesce(text, F.lit(""))), F.lit(f"({OBJECT})"), F.lit(1))
    return F.filter(found, lambda o: F.try_parse_json(o).isNotNull())


@F.pandas_udf(StringType())  # (a type, not its name: no session is needed to import this)
def mended(series: pd.Series) -> pd.Series:
    return series.map(repair)


def merged(df: DataFrame, text: Column, out: str, repairing: bool = True) -> DataFrame:
    """Adds map<string,string> of all objects of a text, later values winning (nested
    ones as JSON texts); null where there is none. A text without any whole object is repaired, no other goes to Python's
    parser."""
    rows = df.withColumn("_whole", objects(text))
    if repairing:
        rows = rows.withColumn("_rest", mended(F.when(F.size("_whole") == 0, without_comments(text))))
        rows = rows.withColumn("_whole", F.when(F.col("_rest").isNotNull(), F.array("_rest")).otherwise(F.col("_whole"))).drop("_rest")
    entries = F.flatten(F.transform("_whole", lambda o: F.map_entries(F.from_json(o, "map<string,string>"))))
    last = F.filter("_entries", lambda e, i: ~F.exists(F.slice("_entries", i + 2, F.size("_entries")), lambda later: later["key"] == e["key"]))
    rows = rows.withColumn("_entries", entries)
    return rows.withColumn(out, F.when(F.size("_whole") > 0, F.map_from_entries(last))).drop("_whole", "_entries")


def as_int(value: Column) -> Column:
    """Whole numbers, also as texts or with a zero fraction; else null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]{1,9}(\.0*)?$"), F.regexp_replace(text, r"\.0*$", "").try_cast("int"))


def as_double(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def filled(text: Column) -> Column:
    """Trimmed, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def judged(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds reasons: the names of the rules that a row breaks (a null rule is broken), in the rules' order."""
    broken = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    return df.withColumn("reasons", F.filter(broken, lambda r: r.isNotNull()))


def quarantine(df: DataFrame, rules: dict[str, Column], save=None) -> tuple[DataFrame, DataFrame, Observation]:
    """(accepted, rejected with reasons, counts). With `save` (a function that writes a
    table and returns it as read) rules run once; the observation has n, accepted and each rule's count then."""
    seen = Observation("quarantine")
    each = judged(df, rules)
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(F.size("reasons") == 0).alias("accepted"), *(F.count_if(F.array_contains("reasons", n)).alias(n) for n in rules)]
    each = each.observe(seen, *counts)
    if save is not None:
        each = save(each)
    return each.filter(F.size("reasons") == 0).drop("reasons"), each.filter(F.size("reasons") > 0), seen


def answer_rules(fields: Column, questions: Column | int) -> dict[str, Column]:
    """Rules of one answer (a map with question and answer)."""
    question, answer = as_int(fields["question"]), as_double(fields["answer"])
    return {
        "no_object": fields.isNotNull(),
        "question": question.isNotNull() & (question >= 1) & (question <= (questions if isinstance(questions, Column) else F.lit(questions))),
        "answer": answer.isNotNull() & (answer >= 0) & (answer <= 1),
    }


def evidence_rules(pairs: Column) -> dict[str, Column]:
    """Rules of array<struct<concept, evidence>>: one at least, nothing blank."""
    return {
        "no_concepts": F.size(F.coalesce(pairs, F.array())) > 0,
        "concept": F.forall(pairs, lambda p: filled(p["concept"]).isNotNull()),
        "evidence": F.forall(pairs, lambda p: filled(p["evidence"]).isNotNull()),
    }
