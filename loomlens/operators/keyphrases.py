"""Keyphrase extraction and two-step (summary, then phrases) extraction through a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.responses import evidence_map
from .annotate import join_sections

Ask = Callable[[list[str]], list[str | None]]


def ask_column(df: DataFrame, ask: Ask, prompt: str, out: str) -> DataFrame:
    """Adds the model's text for a prompt column; rows go in Arrow batches."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != prompt), f"`{out}` string"])

    def run(frames):
        for frame in frames:
            yield frame.assign(**{out: ask(frame.pop(prompt).tolist())})

    return df.mapInPandas(run, schema)


def ask_cached(df: DataFrame, cache: DataFrame, ask: Ask, prompt: str, out: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(answered rows, fresh cache rows): prompts are told apart by their SHA-256, and
    each that the cache (prompt_key, response) lacks is asked once: fresh answers are
    written to `folder` (one that all executors share) first and read back from there."""
    keyed = df.withColumn("prompt_key", F.sha2(prompt, 256))
    new = keyed.select("prompt_key", prompt).dropDuplicates(["prompt_key"]).join(cache.select("prompt_key"), "prompt_key", "left_anti")
    ask_column(new, ask, prompt, "response").select("prompt_key", "response").write.mode("overwrite").parquet(folder)
    fresh = df.sparkSession.read.schema("prompt_key string, response string").parquet(folder)
    known = cache.select("prompt_key", "response").unionByName(fresh)
    return keyed.join(known.withColumnRenamed("response", out), "prompt_key", "left").drop("prompt_key", prompt), fresh


def extract(notes: DataFrame, template: str, ask: Ask, text: str = "text", out: str = "llm_output", limit: int | None = None, key: str = "obs_id") -> DataFrame:
    """(key, out): comma-joined phrases of each note; a null response is empty text."""
    cut = T.sections(notes, text, limit, [key])
    prompts = cut.select(key, "section_id", T.fill(F.lit(template), {"note": F.col("section")}).alias("_prompt"))
    said = ask_column(prompts, ask, "_prompt", "_said")
    joined = join_sections(said, key, "section_id", "_said", ",")
    return notes.select(key).join(joined, key, "left").select(key, F.coalesce("_said", F.lit("")).alias(out))


def two_step(notes: DataFrame, summary_template: str, phrase_template: str, ask: Ask, text: str = "text", limit: int | None = None, key: str = "obs_id", evidence: bool = False) -> DataFrame:
    """(key, llm_summary, llm_output[, evidence]): section summaries joined by spaces,
    then phrases of the summary. With evidence, the second answer is JSON
    {"phrases": [{"phrase", "evidence"}]}."""
    cut = T.sections(notes, text, limit, [key])
    first = ask_column(cut.select(key, "section_id", T.fill(F.lit(summary_template), {"note": F.col("section")}).alias("_p")), ask, "_p", "llm_summary")
    summaries = notes.select(key).join(join_sections(first, key, "section_id", "llm_summary"), key, "left").withColumn("llm_summary", F.coalesce("llm_summary", F.lit("")))
    second = ask_column(summaries.withColumn("_p", T.fill(F.lit(phrase_template), {"note": F.col("llm_summary")})), ask, "_p", "_said")
    if not evidence:
        return second.select(key, "llm_summary", F.coalesce("_said", F.lit("")).alias("llm_output"))
    pairs = F.coalesce(F.from_json("_said", "phrases array<struct<phrase string, evidence string>>")["phrases"], F.array().cast("array<struct<phrase string, evidence string>>"))
    return second.select(key, "llm_summary", F.array_join(F.transform(pairs, lambda p: p["phrase"]), ",").alias("llm_output"), evidence_map(pairs).alias("evidence"))


def configured(notes: DataFrame, config, template: str) -> DataFrame:
    """(key, llm_output) of each note by a `KeyphraseConfig`: one prompt a note, answered
    through the registered client and kept in the folder `cache_file`. An answer is JSON
    {"keyphrases": [...]} or plain comma phrases; a failed one is empty and is asked again by the next run."""
    from .client import Answers, Asker, ClientSettings

    key = notes.columns[config.index_col] if config.index_col is not None else "obs_id"
    missing = sorted({key, "image_path" if config.is_image else config.text_column} - set(notes.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    settings = ClientSettings(config.llm_model_type, max_new_tokens=config.num_new_tokens, batch_size=config.batch_size, seed=config.seed)
    said = F.col("image_path") if config.is_image else F.col(config.text_column)
    slot = config.prompt_placeholder.strip("{}")
    prompts = notes.select(key, F.when(said.isNotNull(), T.fill(F.lit(template), {slot: said})).alias("prompt"))
    got = Answers(notes.sparkSession, config.cache_file).ask(prompts, Asker(settings))
    phrases = F.from_json("response", "keyphrases array<string>")["keyphrases"]
    return got.select(key, F.coalesce(F.array_join(phrases, ","), F.col("response"), F.lit("")).alias("llm_output"))
