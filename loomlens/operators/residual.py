"""What the current concepts leave unexplained: phrases with large residual weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import Shelf
from . import linear, metrics
from .split import fold_count
from .split import folds as folds_of

FACTOR_GREEDY, FACTOR_INIT = 1000.0, 100.0


def phrase_rows(notes: DataFrame, phrases: str, key: str = "obs_id") -> DataFrame:
    """(key, token): distinct folded comma phrases of each note."""
    tokens = F.array_distinct(T.comma_tokens(T.fold(F.col(phrases))))
    return notes.select(key, F.explode(tokens).alias("token"))


def token_prevalence(rows: DataFrame, n: int, least: float, key: str = "obs_id") -> DataFrame:
    """Share of notes with a token, at least `least` (inclusive). Rows are distinct
    by (key, token), so a plain count is the document frequency."""
    out = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return out.withColumn("prevalence", F.col("df") / n).filter(F.col("prevalence") >= least)


def scrub(tokens: DataFrame, synonyms: list[str], column: str = "token") -> DataFrame:
    """Drops tokens that contain a kept concept's synonym of over 2 characters;
    tabular features stay. One predicate per synonym (a bounded list), no join."""
    return tokens.filter(scrubbed(F.col(column), synonyms))


def scrubbed(token: Column, synonyms) -> Column:
    """Whether a token stays."""
    hit = F.lit(False)
    for s in sorted({s.lower() for s in synonyms if len(s) > 2}):
        hit = hit | token.contains(s)
    return token.startswith("tabular feature: ") | ~hit


def top_words(coefs: DataFrame, k: int = 40) -> DataFrame:
    """Non-zero coefficients of largest size; equal ones by name."""
    size = F.abs("coef")
    return coefs.filter(size > 0).orderBy(size.desc(), "feature").limit(k)


@dataclass(frozen=True)
class Side:
    """One seed's part of a residual fit: the columns of its concepts and controls, and
    the words whose phrases it leaves out."""

    concepts: tuple[str, ...] = ()
    controls: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()


def _column(name: str) -> str:
    return f"column: {name}"


INTERCEPT = "intercept"


def fit_residuals(rows: DataFrame, sides: list[Side], phrases: str, penalty: str | None = "l2", grid: list[float] | None = None, use_accuracy: bool = False, factor: float = FACTOR_GREEDY, scale_controls: bool = True, least: float = 0.0, kind: str = "count", tolerance: float = 1e-4, steps: int = 200) -> tuple[DataFrame, list[float]]:
    """rows: obs_id, y, sample_weight, folds (array: a fold from 1 for each side that trains
    on the row, else 0), the phrase column and the sides' columns. -> (side, feature, coef,
    freq) of every phrase of each side, and the chosen strengths.

    The strength of each side is that of the best mean score of its folds (the smallest of
    equal ones); all strengths, folds and sides are one fit (`sparse_logistic`). Concept
    columns, scaled by `factor`, are left nearly unpenalised. freq is the share of the side's
    rows with the phrase. Null labels or weights leave a row out; null phrases have none,
    null columns are 0; phrases and rows never come to the driver. No rows give no phrases."""
    from .sparse_logistic import Fit, Problem

    if penalty not in (None, "l2", "l1", "l1_sklearn"):
        raise ValueError(f"unknown penalty {penalty!r}")
    if kind not in ("count", "tfidf"):
        raise ValueError(f"unknown vectorizer {kind!r}")
    absolute = penalty in ("l1", "l1_sklearn")
    grid = sorted(linear.C_GRID.tolist() if grid is None else grid) if penalty else [NEARLY_FREE]
    shelf = Shelf(rows.sparkSession, "residual")
    rows = rows.filter(F.col("y").isNotNull() & F.col("sample_weight").isNotNull() & F.exists("folds", lambda f: f > 0))
    columns = sorted({c for s in sides for c in (*s.concepts, *s.controls)})
    rows = shelf.keep(rows.select("obs_id", F.col("y").cast("int").alias("y"), F.col("sample_weight").cast("double").alias("w"), F.col("folds").cast("array<int>").alias("folds"), F.array_distinct(T.comma_tokens(T.fold(F.coalesce(F.col(phrases), F.lit(""))))).alias("tokens"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns)), "rows")
    known = rows.groupBy().agg(*(F.count_if(F.col("folds")[i] > 0).alias(f"n{i}") for i in range(len(sides))), F.count(F.lit(1)).alias("n"), F.max(F.array_max("folds")).alias("most")).first()  # one row
    sizes = [known[f"n{i}"] for i in range(len(sides))]
    if not known["n"]:
        return rows.sparkSession.createDataFrame([], "side int, feature string, coef double, freq double"), [grid[0]] * len(sides)

    phrase = rows.select("obs_id", "folds", F.explode("tokens").alias("token"))
    words = vocabulary(phrase, sides, sizes, least)
    words = shelf.keep(words, "words")
    # phrases of the same rows (by count and 128 bits of hashes) have one column: their coefficients are equal, the sum stands for them
    same = ["df", "h0", "h1", "active"]
    leads = shelf.keep(words.groupBy(*same).agg(F.min("token").alias("lead"), F.count(F.lit(1)).alias("times")), "leads")

    pull = (1 / factor) if absolute else (1 / factor**2)
    fixed = [(INTERCEPT, 0.0, [True] * len(sides))]
    for c in columns:
        scaled = scale_controls or any(c in s.concepts for s in sides)
        fixed.append((_column(c), pull if scaled else 1.0, [c in (*s.concepts, *s.controls) for s in sides]))
    own = rows.sparkSession.createDataFrame(fixed, "feature string, factor double, active array<boolean>")  # a row for each column
    once = F.lit(1.0) if absolute else 1.0 / F.col("times")
    features = leads.select(F.concat(F.lit("word: "), "lead").alias("feature"), once.alias("factor"), "active").unionByName(own)
    size = F.ln((F.lit(float(known["n"])) + 1) / (F.col("df") + 1)) if kind == "tfidf" else F.lit(1.0)
    said = phrase.join(leads.select(F.col("lead").alias("token"), size.alias("x")), "token").select("obs_id", F.concat(F.lit("word: "), "token").alias("feature"), "x")
    held = F.array(F.struct(F.lit(INTERCEPT).alias("feature"), F.lit(1.0).alias("x")), *(F.struct(F.lit(_column(c)).alias("feature"), F.col(c).alias("x")) for c in columns))
    entries = said.unionByName(rows.select("obs_id", F.inline(held)).filter("x <> 0"))
    folds = range(1, (known["most"] or 1) + 1) if len(grid) > 1 and known["most"] > 1 else ()
    problems = [Problem(i, f, c) for i in range(len(sides)) for c in grid for f in (0, *folds)]
    fit = Fit(rows.select("obs_id", "y", "w", "folds"), entries, features, problems, absolute, tolerance, steps).run()

    chosen = _strengths(fit, len(sides), grid, use_accuracy) if folds else [grid[0]] * len(sides)
    at = F.array(*(F.struct(F.lit(i).alias("side"), F.col("coefs")[problems.index(Problem(i, 0, chosen[i]))].alias("coef")) for i in range(len(sides))))
    coefs = fit.coefficients().filter(F.col("feature").startswith("word: ")).select(F.substring("feature", 7, 1 << 30).alias("lead"), F.inline(at))
    led = leads.join(coefs, "lead").select(*same, "side", (F.col("coef") / F.col("times")).alias("coef"))
    out = words.join(led, same).filter(F.col("active")[F.col("side")] & (F.col("token") != ""))
    return shelf.keep(out.select("side", F.col("token").alias("feature"), "coef", F.col("share")[F.col("side")].alias("freq")), "coefs"), chosen


def vocabulary(phrase: DataFrame, sides: list[Side], sizes: list[int], least: float = 0.0) -> DataFrame:
    """(token, df, h0, h1, active, share) of the phrases that some side keeps, from distinct (obs_id, folds,
    token): a side keeps those of at least `least` of its rows that hold none of its words;
    h0 and h1 are hashes of the rows with the phrase."""
    hashes = [F.bit_xor(F.xxhash64("obs_id")).alias("h0"), F.bit_xor(F.xxhash64(F.lit(1), "obs_id")).alias("h1")]
    counted = phrase.groupBy("token").agg(F.count(F.lit(1)).alias("df"), *hashes, *(F.count_if(F.col("folds")[i] > 0).alias(f"d{i}") for i in range(len(sides))))
    share = [F.col(f"d{i}") / F.lit(float(max(1, n))) for i, n in enumerate(sizes)]
    stays = [(F.col(f"d{i}") > 0) & (share[i] >= least) & scrubbed(F.col("token"), s.synonyms) for i, s in enumerate(sides)]
    return counted.select("token", "df", "h0", "h1", F.array(*stays).alias("active"), F.array(*share).alias("share")).filter(F.exists("active", lambda a: a))


#: C of a fit without penalty: large enough to count as none, small enough to stay finite where words separate the labels.
NEARLY_FREE = 1e6


def _strengths(fit, sides: int, grid: list[float], use_accuracy: bool) -> list[float]:
    """For each side the smallest strength whose mean over the folds is best."""
    held = fit.held_out()
    by = ["seed", "c", "fold"]
    score = held.groupBy(*by).agg(metrics.accuracy(weight="w").alias("s")) if use_accuracy else metrics.auc(held, by, "w").withColumnRenamed("auc", "s")
    means = {(r["seed"], r["c"]): r["m"] for r in score.groupBy("seed", "c").agg(F.avg("s").alias("m")).collect()}  # a row for each side and strength
    out = []
    for i in range(sides):
        best, chosen = float("-inf"), grid[0]
        for c in grid:
            m = means.get((i, c))
            if m is not None and m > best + 1e-9:
                best, chosen = m, c
        out.append(chosen)
    return out


def fit_residual(df: DataFrame, concepts: list[str], phrases: str, label: str = "y", weight: str | None = None, factor: float = FACTOR_GREEDY, controls: list[str] | None = None, scale_controls: bool = True, least: float = 0.0, c: float | None = None, kind: str = "count", k: int = 40, synonyms: list[str] | None = None, penalty: str | None = "l2", grid: list[float] | None = None, folds: int = 5, use_accuracy: bool = False, key: str = "obs_id") -> DataFrame:
    """(feature, coef, freq) of the top residual phrases, all rows taking part; C by
    stratified folds over the grid, or as given."""
    own = [*concepts, *(controls or [])]
    rows = df.select(F.col(key).alias("obs_id"), F.col(label).alias("y"), (F.col(weight) if weight else F.lit(1.0)).alias("sample_weight"), F.col(phrases).alias("_phrases"), *own).filter("y is not null")
    rows = Shelf(df.sparkSession, "residual-rows").keep(rows, "rows")  # what made them runs once
    if c is None and penalty:
        smallest = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
        cut = folds_of(rows.select("obs_id", "y"), "obs_id", "y", fold_count(smallest, folds), "residual")
        rows = rows.join(cut.select("obs_id", "fold").dropDuplicates(["obs_id"]), "obs_id")
    else:
        rows = rows.withColumn("fold", F.lit(1))
    side = Side(tuple(concepts), tuple(controls or ()), tuple(synonyms or ()))
    coefs, _ = fit_residuals(rows.withColumn("folds", F.array("fold")), [side], "_phrases", penalty, grid if c is None else [c], use_accuracy, factor, scale_controls, least, kind)
    return top_words(coefs.drop("side"), k)
