"""Fixed mapping of the driver's tables: notes are documents with a label, y is
`toxic`, low quality weighs double, the domain is the language and the control
column is the length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Concepts of the catalog (patterns are common to Java and RE2).
CONCEPTS = [
    {"concept_id": 0, "name": "insult", "concept": "Does the note mention an insult?", "pattern": "idiot|stupid|pathetic|worthless|moron|scum|loser|clown|trash|disgusting", "words": ["idiot", "stupid", "scum", "trash"], "is_risk_factor": True},
    {"concept_id": 1, "name": "license", "concept": "Does the note mention a license?", "pattern": "licensed under|rights reserved|copyright", "words": ["licensed", "copyright"], "is_risk_factor": False},
    {"concept_id": 2, "name": "number", "concept": "Does the note mention a number?", "pattern": "[0-9]+", "words": ["number"], "is_risk_factor": False},
    {"concept_id": 3, "name": "shouting", "concept": "Does the note mention shouting?", "pattern": "!!", "words": ["shout"], "is_risk_factor": False},
    {"concept_id": 4, "name": "table", "concept": "Does the note mention a table?", "pattern": " [|] ", "words": ["table", "row"], "is_risk_factor": False},
    {"concept_id": 5, "name": "address", "concept": "Does the note mention an address?", "pattern": "[a-z0-9]+@[a-z0-9]+", "words": ["mail"], "is_risk_factor": False},
]
#: An ensemble of two seeds with two iterations each: intercept, coefficients by concept.
MODELS = [
    (1, 0, -2.0, {0: 3.0, 1: 0.5, 2: -0.25}),
    (1, 1, -2.5, {0: 4.0, 3: -0.5, 2: 0.125}),
    (2, 0, -1.5, {0: 2.5, 4: -1.0, 5: 0.75}),
    (2, 1, -2.25, {0: 3.5, 1: -0.25, 5: 0.5}),
]
SECTION = 1000
POSITIVE_SHARE = 0.2
SEED = 7
CUTOFF = 2000
SENSITIVITY = 0.9
REPLICATES = 1000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("obs_id"), "text", F.col("lang").alias("domain"), "source", F.col("n_chars").alias("control"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("quality") == 1, 1.0).otherwise(2.0)
    return load(spark, sf_dir, "labels").select(F.col("doc_id").alias("obs_id"), F.col("toxic").alias("y"), weight.alias("sample_weight"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(labels(spark, sf_dir), "obs_id")


def history(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    iters = spark.createDataFrame([(s, i, b) for s, i, b, _ in MODELS], "seed int, iter int, intercept double")
    coefs = spark.createDataFrame([(s, i, c, CONCEPTS[c]["concept"], b) for s, i, _, coef in MODELS for c, b in coef.items()], "seed int, iter int, concept_id int, concept string, coef double")
    return iters, coefs


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of many chains: each customer's orders in turn are iterations, with the
    priority as the concept and the price as its coefficient."""
    turn = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = load(spark, sf_dir, "orders")
    return rows.select(F.col("o_custkey").cast("int").alias("seed"), (F.row_number().over(turn) - 1).alias("iter"), F.col("o_orderpriority").alias("concept"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").cast("double").alias("coef"))


# ---- the same in SQL


def values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names}))"


CONCEPT_SQL = values([(c["concept_id"], c["name"], c["concept"], c["pattern"]) for c in CONCEPTS], "concept_id, name, concept, pattern")
ITER_SQL = values([(s, i, b) for s, i, b, _ in MODELS], "seed, iter, intercept")
COEF_SQL = values([(s, i, c, CONCEPTS[c]["concept"], b) for s, i, _, coef in MODELS for c, b in coef.items()], "seed, iter, concept_id, concept, coef")
LEDGER_SQL = "(SELECT o_custkey::INT AS seed, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS iter, o_orderpriority AS concept, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice::DOUBLE AS coef FROM orders)"
NOTES_SQL = "(SELECT d.doc_id AS obs_id, d.text, d.lang AS domain, d.source, d.n_chars AS control, l.toxic AS y, CASE WHEN l.quality = 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS sample_weight FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
SECTIONS_SQL = f"(SELECT doc_id AS obs_id, (k // {SECTION})::INT AS section_id, substr(text, k::BIGINT + 1, {SECTION}) AS section FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), {SECTION})) AS k FROM documents))"
ANNOTATIONS_SQL = f"(SELECT obs_id, concept_id::INT AS concept_id, max(CASE WHEN regexp_matches(lower(section), pattern) THEN 1.0 ELSE 0.0 END::DOUBLE) AS answer FROM {SECTIONS_SQL} s, {CONCEPT_SQL} c GROUP BY ALL)"
SCORES_SQL = f"(SELECT a.obs_id, h.seed, h.iter, 1 / (1 + exp(-(sum(a.answer * h.coef::DOUBLE) + max(i.intercept::DOUBLE)))) AS prob FROM {ANNOTATIONS_SQL} a JOIN {COEF_SQL} h USING (concept_id) JOIN {ITER_SQL} i ON i.seed = h.seed AND i.iter = h.iter GROUP BY ALL)"
# scored notes: the mean score plus a tiny share of the length, so that scores spread
SCORED_SQL = f"(SELECT n.obs_id, n.y, n.sample_weight, n.domain, n.control, round(least(0.999, m.p + least(n.control, 50000) / 1000000.0::DOUBLE), 6) AS prob FROM (SELECT obs_id, avg(prob) AS p FROM {SCORES_SQL} GROUP BY obs_id) m JOIN {NOTES_SQL} n USING (obs_id))"


def order_sql(seed: int | str, key: str) -> str:
    return f"md5('{seed}:' || {key})"
