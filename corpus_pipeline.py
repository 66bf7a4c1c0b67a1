"""Corpus pipeline: language ID, quality, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of `documents`; other columns are dropped. Rows with a null doc_id pass through
each stage by their own text. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.llm import contamination, language, neardup, packing, quality
from loomlens.llm.common import Bloom, Scratch, table
from loomlens.llm.queries import SEQUENCE, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.35
MEMO = 1 << 20  # places of the tokenizer's memo: its workers hold what earlier stages left, too


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is sure of stay."""
    docs = docs.select(*COLUMNS)
    found = language.identify(docs, language.train(docs), extra=["lang", "source", "n_chars"])
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of quality stay."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.assess(docs, model, extra=["lang", "source", "n_chars"]).filter("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays, with one row (its first text).

    Rows whose id may have to be looked at (ids of copies and ids that repeat, by a
    filter of fixed size) are joined with the verdicts; the others are not exchanged."""
    docs = docs.select(*COLUMNS)
    scratch = Scratch(spark, "dedup-stage")
    found = scratch.save(neardup.near_duplicates(spark, docs.select("doc_id", "text"), words=5, num=80, den=100).select("doc_id", "kept"), "found")
    known = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    odd = scratch.save(known.filter("not _kept or _rows > 1"), "odd")
    may = Bloom(odd, "doc_id").may_hold("doc_id")
    judged = docs.filter(may).join(odd, "doc_id", "left").filter(F.coalesce("_kept", F.lit(True)))
    single = judged.filter(F.coalesce("_rows", F.lit(1)) == 1).select(*COLUMNS)
    first = judged.filter("_rows > 1").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("_first"))
    return docs.filter(~may).unionByName(single).unionByName(first.select("doc_id", "_first.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage stay; a row with a null id is judged
    by its own text, rows that share an id by the worst of them."""
    docs = docs.select(*COLUMNS)
    scratch = Scratch(spark, "leak-stage")
    found = contamination.leaks(spark, docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    keys = found.select(F.col("doc_id").alias("_id"), F.col("_own").alias("_leaked"), F.coalesce("doc_id", "_own").alias("_key")).distinct()
    keys = scratch.save(keys, "keys")
    docs = docs.withColumn("_own", contamination.own_key("doc_id", "text"))
    may = Bloom(keys, "_key").may_hold(F.coalesce("doc_id", "_own"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_own").eqNullSafe(F.col("_leaked"))
    return docs.filter(~may).unionByName(docs.filter(may).join(keys, same, "left_anti")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs.select("doc_id", "text"), tokenizer_path(), end_id=1, capacity=SEQUENCE, slots=MEMO)


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifiers and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i > 1:
            scratch.drop(f"{i - 2}-{STAGES[i - 2][0]}")  # read by the stage before last only
    return docs
