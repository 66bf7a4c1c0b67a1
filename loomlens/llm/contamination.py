"""Benchmark decontamination by spaced-seed hashing. DataFrame and SQL functions only.

A seed is a fixed mask over SPAN token positions; tokens at masked-out positions
are ignored, so a hash of the others survives substitutions there. Masks of every
benchmark position are hashed into a table; masks of every document position are
looked up in it. Where they meet, the two texts are compared token by token along
that diagonal: the overlap is the benchmark text as far as it can lie within the
document there. A document is contaminated if at least `share` of the overlap is
equal, or of any window in it of `least` tokens (or of the whole item, if that is
shorter), so that a long item of which only a part was copied is found.

Tokens: lower-cased runs without ASCII white space.

Defined cases: null or empty texts have no tokens and are clean; items of SHORTEST
to SPAN - 1 tokens are matched by the mask that takes all their tokens, shorter
ones are no evidence; rows of one id share the verdict of the worst, a row with a
null id is judged by its own text; a null item_id contaminates but is neither
counted in n_items nor listed in item_ids; empty tables on either side give clean
rows or no rows; other columns are kept.

Plan: one pass over the texts makes seeds and keeps those that a filter of fixed
size (`Bloom`) knows; they meet the seed table by a join of narrow rows, broadcast
only if the benchmark holds at most `broadcast_tokens` tokens (at most masks x
tokens rows of 24 bytes). Texts with a hit are read again, picked by such a filter,
and they alone are exchanged; the way is the same at every size of either table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bloom, Scratch

#: Seed masks (1: the token counts), weight 6 within a span of 10.
MASKS = ("1101100101", "1011010011", "1110001110")
SPAN = 10
SHORTEST = 5
LEAST = 13
SHARE = 0.8
BROADCAST_TOKENS = 200_000
SPACE = r"[\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE), lambda t: t != "")


def seed(array: str, position: str, mask: str, number: int) -> Column:
    """Hash of the masked tokens from a 0-based position on; null if they don't fit."""
    picked = (F.get(F.col(array), F.col(position) + i) for i, bit in enumerate(mask) if bit == "1")
    return F.when(F.col(position) + len(mask) <= F.size(array), F.xxhash64(F.lit(number), *picked))


def positions(df: DataFrame, array: str, name: str, span: int) -> DataFrame:
    """A row for each position at which a mask of `span` fits, or one with null.
    (Outer, so that the optimizer does not repeat the tokenizer in a filter.)"""
    room = F.size(array) - span
    return df.withColumn(name, F.explode_outer(F.when(room >= 0, F.sequence(F.lit(0), room))))


def seeds_of(df: DataFrame, array: str, position: str, masks: list[str]) -> DataFrame:
    return df.withColumn("seed", F.explode_outer(F.array(*(seed(array, position, m, len(m) if m not in MASKS else -MASKS.index(m)) for m in masks))))


def benchmark_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """(seed, item_key, at). Short items have the seed of all their tokens only."""
    long, short = F.size("item") >= SPAN, (F.size("item") < SPAN) & (F.size("item") >= SHORTEST)
    out = seeds_of(positions(items.filter(long), "item", "at", SPAN), "item", "at", list(MASKS))
    if len(masks) > len(MASKS):
        own = items.filter(short).withColumn("at", F.lit(0))
        whole = F.coalesce(*(F.when(F.size("item") == len(m), seed("item", "at", m, len(m))) for m in masks if m not in MASKS))
        out = out.unionByName(own.withColumn("seed", whole))
    return out.select("seed", "item_key", "at").distinct()


def row_key(id_col: str, text_col: str) -> Column:
    """Rows of one id and text have one key."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def own_key(id_col: str, text_col: str) -> Column:
    """What rows with a null id are told apart by (null for others)."""
    return F.when(F.col(id_col).isNull(), row_key(id_col, text_col))


def verified(hits: DataFrame, least: int, share: float) -> DataFrame:
    """The diagonals (words, item, shift) whose overlap or a window of it passes,
    with matched and overlap (tokens)."""
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item"), F.size("words") - F.col("shift"))
    out = hits.withColumns({"_low": low, "_span": high - low, "_need": F.least(F.lit(least), F.size("item"))}).filter(F.col("_span") >= F.col("_need"))
    equal = F.transform(F.sequence(F.col("_low"), F.col("_low") + F.col("_span") - 1), lambda k: F.get("item", k) == F.get("words", k + F.col("shift")))
    out = out.withColumn("_equal", equal).withColumn("matched", F.size(F.filter("_equal", lambda x: x)))
    windows = F.sequence(F.lit(1), F.col("_span") - F.col("_need") + 1)
    near = F.exists(windows, lambda w: F.size(F.filter(F.slice("_equal", w, F.col("_need")), lambda x: x)) >= share * F.col("_need"))
    passes = F.when(F.col("matched") >= share * F.col("_span"), F.lit(True)).when(F.col("matched") >= share * F.col("_need"), near).otherwise(F.lit(False))
    return out.filter(passes).withColumn("overlap", F.col("_span").cast("long")).withColumn("matched", F.col("matched").cast("long"))


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, share: float = SHARE, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(id, _own, item_id, matched, overlap): one row per document and item found in
    it; _own tells apart documents with a null id."""
    scratch = Scratch(spark, "leaks")
    item = tokens(F.col("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), item.alias("item")).withColumn("item_key", F.xxhash64("item_id", F.concat_ws(" ", "item")))
    items = scratch.save(items.dropDuplicates(["item_key"]), "items")
    sizes = items.groupBy(F.least(F.size("item"), F.lit(SPAN)).alias("n")).agg(F.sum(F.size("item")).alias("total")).collect()  # SPAN + 1 rows at most
    masks = [*MASKS, *("1" * n for n in sorted(r["n"] for r in sizes) if SHORTEST <= n < SPAN)]
    table = scratch.save(benchmark_seeds(items, masks).filter("seed is not null"), "seeds")
    small = F.broadcast if sum(r["total"] for r in sizes) <= broadcast_tokens else lambda df: df

    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), row_key(id_col, text_col).alias("_row"))
    rows = seeds_of(positions(base.select("_row", tokens(F.col("_text")).alias("words")), "words", "position", min(map(len, masks))), "words", "position", masks)
    rows = rows.select("_row", "position", "seed").filter(Bloom(table, "seed", bits=64).may_hold("seed"))
    found = rows.join(small(table), "seed").select("_row", "item_key", (F.col("position") - F.col("at")).alias("shift")).distinct()
    found = scratch.save(found, "diagonals")
    texts = base.filter(Bloom(found, "_row").may_hold("_row")).dropDuplicates(["_row"]).select("_id", "_row", tokens(F.col("_text")).alias("words"))
    hits = texts.join(found, "_row").join(small(items), "item_key").withColumn("_own", F.when(F.col("_id").isNull(), F.col("_row")))
    best = F.max(F.struct("matched", "overlap")).alias("best")
    return verified(hits, least, share).groupBy("_id", "_own", "item_id").agg(best).select(F.col("_id").alias(id_col), "_own", "item_id", "best.matched", "best.overlap")


def mark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, **limits) -> DataFrame:
    """The documents (all columns, or `keep`) with contaminated, n_items and
    item_ids (ascending)."""
    found = leaks(spark, docs, benchmark, id_col, text_col, **limits)
    own = [c for c in (keep or docs.columns) if c not in ("contaminated", "n_items", "item_ids")]
    by_doc = found.groupBy(F.col(id_col).alias("_leak_id"), F.col("_own").alias("_leak_own")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.lit(True).alias("_leaked"))
    same = F.col(id_col).eqNullSafe(F.col("_leak_id")) & F.col("_own").eqNullSafe(F.col("_leak_own"))
    both = docs.select(*own, own_key(id_col, text_col).alias("_own")).join(by_doc, same, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return both.select(*own, F.coalesce("_leaked", F.lit(False)).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))
