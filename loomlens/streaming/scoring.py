"""Notes that arrive are annotated and scored with a fixed ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import section_array, sigmoid


def score_stream(notes: DataFrame, concepts: list[dict], models: list[dict], text: str = "text", keep: list[str] | None = None, limit: int | None = 1000) -> DataFrame:
    """Stateless per row, so it runs in append mode without a watermark: answers are
    expressions, and each model ({coefs: {concept_id: b}, intercept}) is one too.
    As in batches, a pattern is looked for within sections of `limit` code points,
    and notes without a text are left out."""
    notes = notes.filter(F.col(text).isNotNull())
    cut = section_array(F.col(text), limit)
    held = lambda pattern: F.exists(cut, lambda s: F.regexp_like(F.lower(s), F.lit(pattern)))
    answers = {c["concept_id"]: held(c["pattern"]).cast("double") for c in concepts}
    probs = []
    for m in models:
        z = F.lit(float(m["intercept"]))
        for c, b in m["coefs"].items():
            z = z + float(b) * answers[c]
        probs.append(sigmoid(z))
    mean = probs[0] if len(probs) == 1 else F.aggregate(F.array(*probs), F.lit(0.0), lambda s, x: s + x) / len(probs)
    return notes.select(*(keep or ["obs_id"]), mean.alias("prob_1"))


def append_answers(notes: DataFrame, annotate, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's answers to the cache table; a batch that runs again
    replaces its own folder, so answers are stored once."""

    def store(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return notes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
