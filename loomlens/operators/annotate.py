"""Concept annotation: sections x concepts -> answers, collated to one long table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class Annotator(Protocol):
    """Answers in [0, 1] for rows (keys, section) and a bounded concept list."""

    def annotate(self, sections: DataFrame, concepts: list[dict], keep: list[str]) -> DataFrame: ...


class PatternAnnotator:
    """Offline default: a concept holds where its pattern matches the lower-cased
    section. Pure Catalyst: one scan, one generated row per concept, no join."""

    def annotate(self, sections: DataFrame, concepts: list[dict], keep: list[str]) -> DataFrame:
        said = [F.struct(F.lit(c["concept_id"]).alias("concept_id"), F.regexp_like(F.lower("section"), F.lit(c["pattern"])).cast("double").alias("answer")) for c in concepts]
        return sections.select(*keep, F.inline(F.array(*said)))


    def annotate_whole(self, notes: DataFrame, concepts: list[dict], text: str, limit: int | None, keep: list[str]) -> DataFrame:
        """Collated answers of notes that are one row each: sections stay inside the
        row, so the largest answer over them needs no exchange."""
        cut = T.section_array(F.col(text), limit)

        def held(pattern: str) -> Column:
            return F.exists("_sections", lambda s: F.regexp_like(s, F.lit(pattern))).cast("double")

        said = [F.struct(F.lit(c["concept_id"]).alias("concept_id"), held(c["pattern"]).alias("answer")) for c in concepts]
        return notes.filter(F.col(text).isNotNull()).select(*keep, F.transform(cut, lambda s: F.lower(s)).alias("_sections")).select(*keep, F.inline(F.array(*said)))


class ModelAnnotator:
    """Remote or local model behind a function of (prompts) -> responses, run in
    batches of rows on the executors. `batch_concepts` questions share a prompt."""

    def __init__(self, ask: Callable[[list[str]], list[str | None]], template: str, batch_concepts: int = 20, text_slot: str = "sentence"):
        self.ask, self.template, self.batch_concepts, self.text_slot = ask, template, batch_concepts, text_slot

    def annotate(self, sections: DataFrame, concepts: list[dict], keep: list[str]) -> DataFrame:
        from ..functions.responses import scattered
        from ..schema import RESPONSE

        ask = self.ask
        groups = [concepts[i : i + self.batch_concepts] for i in range(0, len(concepts), self.batch_concepts)]
        made = [
            F.struct(
                F.array(*(F.lit(c["concept_id"]) for c in group)).alias("ids"),
                T.fill(F.lit(self.template), {"prompt_questions": T.numbered(F.array(*(F.lit(c["concept"]) for c in group))), self.text_slot: F.col("section")}).alias("prompt"),
            )
            for group in groups
        ]
        prompts = sections.select(*keep, F.inline(F.array(*made)))

        def run(frames):
            for frame in frames:
                yield frame.assign(response=ask(frame.pop("prompt").tolist()))

        fields = [f for f in prompts.schema.fields if f.name != "prompt"]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "response string"])
        raw = prompts.mapInPandas(run, schema)
        parsed = F.from_json("response", f"extractions array<{RESPONSE.simpleString()}>")["extractions"]
        values = F.arrays_zip(F.col("ids").alias("concept_id"), scattered(parsed, F.size("ids")).alias("answer"))
        return raw.select(*keep, F.inline(values)).toDF(*keep, "concept_id", "answer")


def collate(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Largest answer over a note's sections."""
    return answers.groupBy(*keys, "concept_id").agg(F.max("answer").alias("answer"))


def join_sections(summaries: DataFrame, key: str, order: str, text: str, separator: str = " ") -> DataFrame:
    """Non-empty section texts of a note in order, joined."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    kept = summaries.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    return kept.groupBy(key).agg(F.array_join(parts, separator).alias(text))


def annotate_notes(notes: DataFrame, concepts: list[dict], annotator: Annotator | None = None, text: str = "text", limit: int | None = 1000, key: str = "obs_id", one_row: bool = False) -> DataFrame:
    """(key, concept_id, answer). one_row: each key has one row, which lets the
    pattern annotator collate within it."""
    annotator = annotator or PatternAnnotator()
    if one_row and isinstance(annotator, PatternAnnotator):
        return annotator.annotate_whole(notes, concepts, text, limit, [key])
    cut = T.sections(notes, text, limit, [key])
    return collate(annotator.annotate(cut, concepts, [key]), [key])


def uncached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def merge_cache(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which a fresh answer replaces a cached one."""
    both = cache.withColumn("_version", F.lit(0)).unionByName(fresh.withColumn("_version", F.lit(1)))
    last = F.max_by("answer", "_version").alias("answer")
    return both.groupBy(*keys).agg(last)


def annotate_uncached(notes: DataFrame, concepts: list[dict], cache: DataFrame, annotator: Annotator | None = None, text: str = "text", limit: int | None = 1000) -> DataFrame:
    """Answers for the concepts of which the cache lacks some note, and only for
    those notes; merged into the cache."""
    ids = F.array(*(F.lit(c["concept_id"]) for c in concepts))
    wanted = notes.select("obs_id", F.explode(ids).alias("concept_id"))
    missing = uncached(wanted, cache, ["obs_id", "concept_id"]).select("obs_id").distinct()
    fresh = annotate_notes(notes.join(missing, "obs_id", "left_semi"), concepts, annotator, text, limit)
    return merge_cache(cache.select("obs_id", "concept_id", "answer"), fresh, ["obs_id", "concept_id"])


def prevalence(annotations: DataFrame) -> DataFrame:
    """Mean answer with a normal 95 % interval."""
    sem = F.stddev_samp("answer") / F.sqrt(F.count("answer"))
    out = annotations.groupBy("concept_id").agg(F.avg("answer").alias("prevalence"), sem.alias("sem"), F.count(F.lit(1)).alias("n"))
    half = 1.959963985 * F.col("sem")
    return out.withColumns({"low": F.col("prevalence") - half, "high": F.col("prevalence") + half}).drop("sem")


def class_frequency(annotations: DataFrame, labels: DataFrame, positive_share: float) -> DataFrame:
    """Mean answers within each class, rescaled by the classes' original shares.
    The long table is joined with labels by key; both means come from one pass."""
    joined = annotations.join(labels.select("obs_id", "y"), "obs_id")
    positive = F.avg(F.when(F.col("y") == 1, F.col("answer"))) * positive_share
    negative = F.avg(F.when(F.col("y") == 0, F.col("answer"))) * (1 - positive_share)
    out = joined.groupBy("concept_id").agg(positive.alias("positive_frequency"), negative.alias("negative_frequency"))
    return out.withColumn("total_frequency", F.col("positive_frequency") + F.col("negative_frequency"))


def sample_answers(sample: DataFrame, annotations: DataFrame, concept_id: Column | int) -> DataFrame:
    """Answers of sampled notes (repeated ones too); 0 where there is none."""
    wanted = concept_id if isinstance(concept_id, Column) else F.lit(concept_id)
    asked = sample.withColumn("concept_id", wanted.cast("int"))
    return asked.join(annotations, ["obs_id", "concept_id"], "left").withColumn("answer", F.coalesce("answer", F.lit(0.0)))


def wide(annotations: DataFrame, concepts: list[dict], key: str = "obs_id") -> DataFrame:
    """One column per concept by one conditional aggregate."""
    columns = [F.max(F.when(F.col("concept_id") == c["concept_id"], F.col("answer"))) for c in concepts]
    return annotations.groupBy(key).agg(*(F.coalesce(x, F.lit(0.0)).alias(c["name"]) for x, c in zip(columns, concepts, strict=True)))
