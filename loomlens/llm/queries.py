"""Catalog queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, contamination, html_text, infill, language, neardup, packing, quality, records, rules, urls, vector_codes, warc
from .common import table
from .oracles import ORACLES

SEQUENCE = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(spark, table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), end_id=0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), end_id=1, capacity=SEQUENCE)


#: The rules of the url query.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES, urls.train(spark))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.identify(docs, language.train(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.assess(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.round_trip(spark, pages, least=0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return rules.judge(spark, docs).drop("host").withColumn("host_rate", F.round("host_rate", 6))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = contamination.mark(spark, docs, table(spark, sf_dir, "benchmark", "item_id", "text"), keep=["doc_id"])
    return found.withColumn("item_ids", F.concat_ws(",", F.transform("item_ids", lambda i: i.cast("string"))))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents", "doc_id", "text"), words=2, num=80, den=100)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(spark, table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


#: A conversation that the query formats beside those of the table: its texts are control strings of other templates and of this one.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    own = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for i, role in enumerate(("user", "assistant"))]
    added = spark.range(1).select(F.inline(F.array(*own)))
    return chat.digests(chat.format_chats(turns.unionByName(added)))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    restored = infill.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


def queries() -> dict:
    every = (op1_url_filter, op2_token_records, op3_html_text, op4_language, op5_quality, op6_warc, op7_quality_rules, op8_packing, op9_decontamination, op10_near_duplicates, op11_vector_codes, op12_chat_format, op13_infill)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer, a parser or a trained model; they are tested
    against brute force."""
    return dict(ORACLES)
