"""The engine's queries over the driver's tables, each with its SQL twin for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses
from ..functions import text as T
from ..operators import annotate, cluster, context, ensemble, linear, metrics, resample, residual, select, split, vector_index, viewer
from ..operators.order import seeded_key
from ..shared import Shelf
from ..sources import tables
from . import setting as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(x: Column) -> Column:
    return F.round(x, 6)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.annotate_notes(S.documents(spark, sf_dir), S.CONCEPTS, limit=S.SECTION, one_row=True)


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the labelled notes. Texts are answered where they are read: answers, not texts, meet the labels."""
    answers = annotate.annotate_notes(S.documents(spark, sf_dir).select("obs_id", "text"), S.CONCEPTS, limit=S.SECTION, one_row=True)
    # an inner join: a semi-join would be pushed below the answers, and meet the texts
    return ensemble.scores(answers.join(S.labels(spark, sf_dir).select("obs_id").distinct(), "obs_id"), *S.history(spark))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = labelled_scores(spark, sf_dir).groupBy("obs_id").agg(F.avg("prob").alias("_p"))
    spread = F.least(F.lit(0.999), F.col("_p") + F.least(F.col("control"), F.lit(50000)) / 1000000.0)
    about = S.documents(spark, sf_dir).select("obs_id", "domain", "control").join(S.labels(spark, sf_dir), "obs_id")
    rows = means.join(about, "obs_id").withColumn("prob", r6(spread)).drop("_p")
    return Shelf(spark, "scored").keep(rows, "scored")  # a metric reads them several times


# ---- sections and annotations


@query(f"SELECT obs_id, section_id, section FROM {S.SECTIONS_SQL}")
def q01_sections(spark, sf_dir):
    return T.sections(S.documents(spark, sf_dir), "text", S.SECTION, ["obs_id"])


@query(f"SELECT obs_id, section_id, concept_id::INT AS concept_id, CASE WHEN regexp_matches(lower(section), pattern) THEN 1.0 ELSE 0.0 END::DOUBLE AS answer FROM {S.SECTIONS_SQL} s, {S.CONCEPT_SQL} c")
def q02_section_annotations(spark, sf_dir):
    cut = T.sections(S.documents(spark, sf_dir), "text", S.SECTION, ["obs_id"])
    return annotate.PatternAnnotator().annotate(cut, S.CONCEPTS, ["obs_id", "section_id"])


@query(f"SELECT obs_id, concept_id, answer FROM {S.ANNOTATIONS_SQL}")
def q03_collated_annotations(spark, sf_dir):
    return annotate.annotate_notes(S.documents(spark, sf_dir), S.CONCEPTS, limit=S.SECTION)


@query(f"SELECT concept_id, count(*) AS n, round(avg(answer), 6) AS prevalence, round(avg(answer) - 1.959963985 * stddev_samp(answer) / sqrt(count(*)), 6) AS low, round(avg(answer) + 1.959963985 * stddev_samp(answer) / sqrt(count(*)), 6) AS high FROM {S.ANNOTATIONS_SQL} GROUP BY concept_id")
def q04_prevalence(spark, sf_dir):
    return annotate.prevalence(annotated(spark, sf_dir)).select("concept_id", "n", *(r6(F.col(c)).alias(c) for c in ("prevalence", "low", "high")))


@query(f"SELECT concept_id, round(p, 6) AS positive_frequency, round(n, 6) AS negative_frequency, round(p + n, 6) AS total_frequency FROM (SELECT a.concept_id, avg(a.answer) FILTER (l.toxic = 1) * {S.POSITIVE_SHARE}::DOUBLE AS p, avg(a.answer) FILTER (l.toxic = 0) * (1 - {S.POSITIVE_SHARE}::DOUBLE) AS n FROM {S.ANNOTATIONS_SQL} a JOIN labels l ON l.doc_id = a.obs_id GROUP BY a.concept_id)")
def q05_class_conditional_freq(spark, sf_dir):
    labels = S.labels(spark, sf_dir)
    notes = S.documents(spark, sf_dir).join(labels.select("obs_id"), "obs_id", "left_semi")
    answers = annotate.annotate_notes(notes, S.CONCEPTS, limit=S.SECTION, one_row=True)
    out = annotate.class_frequency(answers, labels, S.POSITIVE_SHARE)
    return out.select("concept_id", *(r6(F.col(c)).alias(c) for c in ("positive_frequency", "negative_frequency", "total_frequency")))


# ---- ingest and joins

INDEX_SQL = f"(SELECT doc_id AS obs_id, CASE WHEN substr({S.order_sql(S.SEED, 'doc_id')}, 1, 1) < '8' THEN 'train' ELSE 'test' END AS partition FROM documents)"


def index(spark, sf_dir) -> DataFrame:
    first = F.substring(seeded_key(S.SEED, F.col("obs_id")), 1, 1)
    return S.documents(spark, sf_dir).select("obs_id", F.when(first < "8", "train").otherwise("test").alias("partition"))


@query(f"SELECT n.obs_id, i.partition, n.sample_weight, n.control FROM (SELECT d.doc_id AS obs_id, 1.0::DOUBLE AS sample_weight, d.text, d.n_chars AS control FROM documents d) n JOIN {INDEX_SQL} i USING (obs_id) WHERE i.partition = 'train' AND n.text IS NOT NULL")
def q06_partition_load(spark, sf_dir):
    return tables.load_partition(S.documents(spark, sf_dir), index(spark, sf_dir), "train").select("obs_id", "partition", "sample_weight", "control")


@query("SELECT d.doc_id AS obs_id, d.lang AS domain, 'quality ' || l.quality AS llm_output FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def q07_concept_attach(spark, sf_dir):
    summaries = S.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("obs_id"), F.concat(F.lit("quality "), F.col("quality")).alias("llm_output"))
    return tables.attach(S.documents(spark, sf_dir), summaries, "llm_output").select("obs_id", "domain", "llm_output")


@query(f"SELECT s.obs_id, s.draw, 0::INT AS concept_id, coalesce(a.answer, 0.0)::DOUBLE AS answer FROM (SELECT doc_id AS obs_id, unnest(range(0, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END))::INT AS draw FROM documents) s LEFT JOIN (SELECT * FROM {S.ANNOTATIONS_SQL} WHERE answer > 0) a ON a.obs_id = s.obs_id AND a.concept_id = 0")
def q08_sample_mapping_zero_fill(spark, sf_dir):
    draws = F.explode(F.sequence(F.lit(0), F.when(F.col("obs_id") % 2 == 0, 1).otherwise(0)))
    sample = S.documents(spark, sf_dir).select("obs_id", draws.alias("draw"))
    held = annotate.annotate_notes(S.documents(spark, sf_dir), S.CONCEPTS[:1], limit=S.SECTION, one_row=True).filter("answer > 0")
    return annotate.sample_answers(sample, held, 0).select("obs_id", "draw", "concept_id", "answer")


@query("SELECT doc_id AS obs_id, lang AS domain, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q09_overlap_exclusion(spark, sf_dir):
    return tables.without_overlap(S.documents(spark, sf_dir), S.labels(spark, sf_dir), "obs_id").select("obs_id", "domain", "source")


# ---- splits

SPLIT_SQL = f"""(WITH r AS (SELECT doc_id AS obs_id, toxic AS y, row_number() OVER (PARTITION BY toxic ORDER BY {S.order_sql(S.SEED, 'doc_id')}) AS k FROM labels),
c AS (SELECT y, count(*) AS n, floor(count(*) * 0.5)::BIGINT AS base, count(*) * 0.5 - floor(count(*) * 0.5) AS rem FROM r GROUP BY y),
q AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= (SELECT floor(sum(n) * 0.5) - sum(base) FROM c) THEN 1 ELSE 0 END AS quota FROM c)
SELECT r.obs_id, r.y, CASE WHEN r.k <= q.quota THEN 'train' ELSE 'test' END AS part FROM r JOIN q USING (y))"""


def parts(spark, sf_dir) -> DataFrame:
    return split.stratified(S.labels(spark, sf_dir).select("obs_id", "y"), "obs_id", "y", 0.5, S.SEED)


@query(f"SELECT obs_id, y, part FROM {SPLIT_SQL}")
def q10_stratified_split(spark, sf_dir):
    return parts(spark, sf_dir).select("obs_id", "y", "part")


@query(f"SELECT doc_id AS obs_id, toxic AS y, ntile(5) OVER (PARTITION BY toxic ORDER BY {S.order_sql(0, 'doc_id')})::INT AS fold FROM labels")
def q11_stratified_folds(spark, sf_dir):
    return split.folds(S.labels(spark, sf_dir).select("obs_id", "y"), "obs_id", "y", 5).select("obs_id", "y", "fold")


@query(f"SELECT obs_id, CASE WHEN k <= n - floor(n * 0.1) THEN 'train' ELSE 'test' END AS partition FROM (SELECT doc_id AS obs_id, row_number() OVER (ORDER BY {S.order_sql(S.SEED, 'doc_id')}) AS k, count(*) OVER () AS n FROM documents)")
def q12_global_split(spark, sf_dir):
    return split.global_split(S.documents(spark, sf_dir).select("obs_id"), "obs_id", 0.1, S.SEED).select("obs_id", "partition")


# ---- phrases

FOLD_SQL = f"regexp_replace(translate(lower(text), '{T.MARKED}', '{T.PLAIN}'), '[^\\x00-\\x7F]', '', 'g')"
TOKENS_SQL = f"(SELECT DISTINCT doc_id AS obs_id, lower(trim(unnest(string_split({FOLD_SQL}, ',')))) AS token FROM documents)"
PREVALENCE_SQL = f"(SELECT token, count(*) AS df, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS prevalence FROM {TOKENS_SQL} GROUP BY token HAVING count(*) / (SELECT count(*) FROM documents)::DOUBLE >= 0.002)"


def phrases(spark, sf_dir, least=0.002) -> DataFrame:
    docs = S.documents(spark, sf_dir).select("obs_id", "text")
    return residual.token_prevalence(residual.phrase_rows(docs, "text"), docs.count(), least)


@query(f"SELECT doc_id AS obs_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(list_filter(t, lambda x: x = '')) AS n_empty, t[1] AS first_token FROM (SELECT doc_id, list_transform(string_split({FOLD_SQL}, ','), lambda x: lower(trim(x))) AS t FROM documents)")
def q13_comma_tokens(spark, sf_dir):
    t = S.documents(spark, sf_dir).select("obs_id", T.comma_tokens(T.fold(F.col("text"))).alias("t"))
    size = lambda x: F.size(x).cast("long")
    return t.select("obs_id", size("t").alias("n_tokens"), size(F.array_distinct("t")).alias("n_distinct"), size(F.filter("t", lambda x: x == "")).alias("n_empty"), F.get("t", F.lit(0)).alias("first_token"))


@query(f"SELECT token, df, round(prevalence, 6) AS prevalence FROM {PREVALENCE_SQL}")
def q14_token_prevalence(spark, sf_dir):
    return phrases(spark, sf_dir).select("token", "df", r6(F.col("prevalence")).alias("prevalence"))


SYNONYMS = ["licensed", "the", "de", "que"]


@query(f"SELECT token, df FROM {PREVALENCE_SQL} v WHERE NOT EXISTS (SELECT 1 FROM {S.values([(w,) for w in SYNONYMS if len(w) > 2], 'w')} s WHERE contains(v.token, s.w))")
def q15_scrubbed_vocabulary(spark, sf_dir):
    return residual.scrub(phrases(spark, sf_dir), SYNONYMS).select("token", "df")


@query(f"SELECT token AS feature, df AS coef FROM {PREVALENCE_SQL} ORDER BY df DESC, token LIMIT 40")
def q16_top_tokens(spark, sf_dir):
    return residual.top_words(phrases(spark, sf_dir).select(F.col("token").alias("feature"), F.col("df").alias("coef")), 40).select("feature", "coef")


# ---- models

CELLS_SQL = f"(SELECT concept_id, sum(w) FILTER (answer = 1 AND y = 1) AS a, sum(w) FILTER (answer = 1 AND y = 0) AS b, sum(w) FILTER (answer = 0 AND y = 1) AS c, sum(w) FILTER (answer = 0 AND y = 0) AS d FROM (SELECT a.concept_id, a.answer, n.y, n.sample_weight AS w FROM {S.ANNOTATIONS_SQL} a JOIN {S.NOTES_SQL} n USING (obs_id)) GROUP BY concept_id)"


def labelled_answers(spark, sf_dir) -> DataFrame:
    notes = S.notes(spark, sf_dir)
    answers = annotate.annotate_notes(notes.select("obs_id", "text"), S.CONCEPTS, limit=S.SECTION, one_row=True)
    return answers.join(notes.select("obs_id", "y", "sample_weight"), "obs_id")


@query(f"SELECT concept_id, round(ln(a * d / (b * c)), 5) AS coef, round(ln(c / d), 5) AS intercept FROM {CELLS_SQL} WHERE a > 0 AND b > 0 AND c > 0 AND d > 0")
def q17_weighted_lr_closed_form(spark, sf_dir):
    patterns = linear.compress(labelled_answers(spark, sf_dir), ["answer"], "y", "sample_weight", ["concept_id"])
    whole = patterns.groupBy("concept_id").count().filter("count = 4").select("concept_id")
    fits = linear.grouped_fit(patterns.join(whole, "concept_id", "left_semi"), ["concept_id"], ["answer"], None)
    return fits.select("concept_id", F.round(F.col("coefs")[0], 5).alias("coef"), F.round("intercept", 5).alias("intercept"))


AUC_SQL = f"""(WITH m AS (SELECT a.concept_id, a.answer, n.y, n.sample_weight AS w, p.part FROM {S.ANNOTATIONS_SQL} a JOIN {S.NOTES_SQL} n USING (obs_id) JOIN {SPLIT_SQL} p USING (obs_id)),
k AS (SELECT concept_id, part, coalesce(sum(w) FILTER (answer = 1 AND y = 1), 0) AS p1, coalesce(sum(w) FILTER (answer = 1 AND y = 0), 0) AS n1, coalesce(sum(w) FILTER (answer = 0 AND y = 1), 0) AS p0, coalesce(sum(w) FILTER (answer = 0 AND y = 0), 0) AS n0 FROM m GROUP BY ALL),
s AS (SELECT t.concept_id, sign(r.p1 * r.n0 - r.n1 * r.p0) AS s, (t.p1 * t.n0 + 0.5 * (t.p1 * t.n1 + t.p0 * t.n0)) / ((t.p1 + t.p0) * (t.n1 + t.n0)) AS auc FROM k t JOIN k r USING (concept_id) WHERE t.part = 'test' AND r.part = 'train')
SELECT c.name AS candidate, CASE WHEN s.s > 0 THEN s.auc WHEN s.s < 0 THEN 1 - s.auc ELSE 0.5 END AS score, s.s AS sign FROM s JOIN {S.CONCEPT_SQL} c USING (concept_id))"""


def candidate_scores(spark, sf_dir, check=False) -> DataFrame:
    base = annotate.wide(labelled_answers(spark, sf_dir), S.CONCEPTS)
    rows = base.join(S.labels(spark, sf_dir), "obs_id").join(parts(spark, sf_dir).select("obs_id", "part"), "obs_id")
    rows = split.folds(rows, "obs_id", "y", 5).withColumn("seed", F.lit(S.SEED))
    names = [c["name"] for c in S.CONCEPTS]
    return select.score_candidates(rows, {S.SEED: []}, {S.SEED: names}, {c["name"]: c["is_risk_factor"] for c in S.CONCEPTS}, "l2", check_sign=check)


@query(f"SELECT candidate, round(score, 6) AS score FROM {AUC_SQL}")
def q18_candidate_auc(spark, sf_dir):
    return candidate_scores(spark, sf_dir).select("candidate", r6(F.col("score")).alias("score"))


RISK_SQL = S.values([(c["name"], c["is_risk_factor"]) for c in S.CONCEPTS], "candidate, risk").replace("True", "true").replace("False", "false")
PICK_SQL = f"(SELECT candidate, CASE WHEN (risk AND sign > 0) OR (NOT risk AND sign < 0) THEN score ELSE 0.0 END AS score FROM {AUC_SQL} JOIN {RISK_SQL} USING (candidate))"


@query(f"SELECT candidate, round(score, 6) AS score FROM {PICK_SQL} WHERE abs(score - (SELECT max(score) FROM {PICK_SQL})) <= 1e-8 + 1e-5 * (SELECT max(score) FROM {PICK_SQL}) ORDER BY {S.order_sql(0, 'candidate')} LIMIT 1")
def q19_greedy_first_pick(spark, sf_dir):
    return select.pick(candidate_scores(spark, sf_dir, True), ["seed"]).select("candidate", r6(F.col("score")).alias("score"))


# ---- ensemble


@query(f"SELECT obs_id, seed, iter, round(prob, 6) AS prob FROM {S.SCORES_SQL}")
def q20_linear_score(spark, sf_dir):
    return ensemble.scores(annotated(spark, sf_dir), *S.history(spark)).select("obs_id", "seed", "iter", r6(F.col("prob")).alias("prob"))


@query(f"SELECT obs_id, round(avg(prob), 6) AS prob_1, round(1 - avg(prob), 6) AS prob_0 FROM {S.SCORES_SQL} GROUP BY obs_id")
def q21_ensemble_mean(spark, sf_dir):
    return ensemble.mean(ensemble.scores(annotated(spark, sf_dir), *S.history(spark))).select("obs_id", r6(F.col("prob_1")).alias("prob_1"), r6(F.col("prob_0")).alias("prob_0"))


@query(f"SELECT seed, obs_id, round(avg(prob), 6) AS prob_1 FROM {S.SCORES_SQL} GROUP BY ALL")
def q22_per_seed_mean(spark, sf_dir):
    return ensemble.seed_mean(ensemble.scores(annotated(spark, sf_dir), *S.history(spark))).select("seed", "obs_id", r6(F.col("prob_1")).alias("prob_1"))


EXCLUDED = "1-URGENT"


@query(f"SELECT seed, iter, concept, CASE WHEN concept = '{EXCLUDED}' AND iter = max(iter) OVER (PARTITION BY seed) THEN 0.0 ELSE coef END AS coef FROM {S.LEDGER_SQL}")
def q23_excluded_concepts(spark, sf_dir):
    return ensemble.exclude(S.ledger(spark, sf_dir), [EXCLUDED]).select("seed", "iter", "concept", "coef")


# ---- metrics


def auc_sql(rows: str, by: str, weight: str) -> str:
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"(SELECT {group}sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM (SELECT {group}prob, p, n, coalesce(sum(n) OVER ({part}ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {group}prob, sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y = 0 THEN {weight} ELSE 0 END)::DOUBLE AS n FROM {rows} GROUP BY {group}prob)){' GROUP BY ' + by if by else ''})"


def spec_sql(rows: str, by: str) -> str:
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    inner = f"(SELECT {group}prob, sum(p) OVER ({part}ORDER BY prob DESC) / nullif(sum(p) OVER ({part.strip()}), 0)::DOUBLE AS tpr, sum(n) OVER ({part}ORDER BY prob DESC) / nullif(sum(n) OVER ({part.strip()}), 0)::DOUBLE AS fpr FROM (SELECT {group}prob, sum((y = 1)::INT) AS p, sum((y = 0)::INT) AS n FROM {rows} GROUP BY {group}prob))"
    return f"(SELECT {group}max_by(1 - fpr, prob) AS specificity, max(prob) AS threshold FROM {inner} WHERE tpr >= {S.SENSITIVITY}::DOUBLE{' GROUP BY ' + by if by else ''})"


@query(f"SELECT round(auc, 6) AS auc FROM {auc_sql(S.SCORED_SQL, '', '1')}")
def q24_auc(spark, sf_dir):
    return metrics.auc(scored(spark, sf_dir), []).select(r6(F.col("auc")).alias("auc"))


@query(f"SELECT round(auc, 6) AS auc FROM {auc_sql(S.SCORED_SQL, '', 'sample_weight')}")
def q25_weighted_auc(spark, sf_dir):
    return metrics.auc(scored(spark, sf_dir), [], "sample_weight").select(r6(F.col("auc")).alias("auc"))


@query(f"SELECT round(specificity, 6) AS specificity, threshold FROM {spec_sql(S.SCORED_SQL, '')}")
def q26_specificity_at_sensitivity(spark, sf_dir):
    return metrics.specificity_at(scored(spark, sf_dir), [], S.SENSITIVITY).select(r6(F.col("specificity")).alias("specificity"), "threshold")


def boot_sql(by: str, weight: str, value: str) -> str:
    """Replicates of cells of equal (slice, score, label, weight), drawn by the smallest key's hash; value: a query over d."""
    mul, step, low = resample.MULTIPLIER, resample.STEP, resample.LOW
    half = f"((xor(h >> 16, h) * {mul}) & {low})"
    mixing = lambda name, source: f"{name}1 AS (SELECT * REPLACE ({half} AS h) FROM {source}), {name}2 AS (SELECT * REPLACE ({half} AS h) FROM {name}1), {name} AS MATERIALIZED (SELECT * REPLACE (xor(h >> 16, h) AS h) FROM {name}2)"
    tables = ", ".join(f"({n}, {list(resample.limits(n))})" for n in range(1, resample.TABLED + 1))
    return f"""WITH k AS (SELECT {by} AS slice, prob, y, {weight}::DOUBLE AS w, count(*) AS n, md5('{S.SEED}:' || min(obs_id)) AS m FROM {S.SCORED_SQL} GROUP BY ALL),
r AS (SELECT slice, prob, y, w, n, rep, ('0x' || substr(m, 1, 8))::BIGINT AS a, xor(('0x' || substr(m, 9, 8))::BIGINT, (rep * {step}) & {low}) AS h FROM k, range(0, {S.REPLICATES}) r(rep)),
{mixing('x', 'r')}, o AS (SELECT * REPLACE (xor(h, a) AS h) FROM x), {mixing('z', 'o')},
t AS (SELECT * FROM (VALUES {tables}) t(n, limits)),
d AS MATERIALIZED (SELECT slice, rep, prob, sum(CASE WHEN y = 1 THEN w * times ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y = 0 THEN w * times ELSE 0 END)::DOUBLE AS n FROM (SELECT z.*, len(list_filter(limits, lambda c: c <= h)) AS times FROM z JOIN t USING (n)) GROUP BY ALL),
v AS ({value})
SELECT slice, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(value) AS n_replicates FROM v GROUP BY slice"""


AREA_VALUE = "SELECT slice, rep, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS value FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY slice, rep ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d) GROUP BY slice, rep"
SPEC_VALUE = f"SELECT slice, rep, max_by(1 - fpr, prob) AS value FROM (SELECT slice, rep, prob, sum(p) OVER (PARTITION BY slice, rep ORDER BY prob DESC) / nullif(sum(p) OVER (PARTITION BY slice, rep), 0) AS tpr, sum(n) OVER (PARTITION BY slice, rep ORDER BY prob DESC) / nullif(sum(n) OVER (PARTITION BY slice, rep), 0) AS fpr FROM d) WHERE tpr >= {S.SENSITIVITY}::DOUBLE AND fpr IS NOT NULL GROUP BY slice, rep"


FLAGS = {"A": "least(1.0, l_discount * 10)", "N": "least(1.0, l_tax * 12)", "R": "l_quantity / 50"}


@query(
    "WITH r AS (SELECT c AS k, l_linestatus AS slice, (l_returnflag = c)::INT AS y, l_linenumber::DOUBLE AS w, round(CASE c "
    + " ".join(f"WHEN '{c}' THEN {e}" for c, e in FLAGS.items())
    + f" END, 6) AS prob FROM lineitem, (VALUES ('A'), ('N'), ('R')) t(c)) SELECT slice, CASE WHEN count(auc) = 3 THEN round(avg(auc), 6) END AS auc FROM {auc_sql('r', 'slice, k', 'w')} GROUP BY slice"
)
def q44_multiclass_auc(spark, sf_dir):
    rows = S.load(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("slice"), F.col("l_returnflag").alias("y"), F.col("l_linenumber").cast("double").alias("w"), *(F.round(F.expr(e), 6).alias(f"p{c}") for c, e in FLAGS.items()))
    return metrics.multiclass_auc(rows, ["slice"], {c: f"p{c}" for c in FLAGS}, "w").select("slice", r6(F.col("auc")).alias("auc"))


def intervals(out):
    return out.select("slice", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "n_replicates")


@query(f"SELECT b.*, round(p.auc, 6) AS auc FROM ({boot_sql(repr('all'), '1', AREA_VALUE)}) b, {auc_sql(S.SCORED_SQL, '', '1')} p")
def q27_bootstrap_ci(spark, sf_dir):
    """The area with its interval, from exact scores."""
    rows = scored(spark, sf_dir).withColumn("slice", F.lit("all"))
    found = intervals(resample.bootstrap(rows, ["slice"], S.REPLICATES, S.SEED))
    return found.join(metrics.auc(rows, ["slice"]).withColumn("auc", r6(F.col("auc"))), "slice")


@query(boot_sql("domain", "sample_weight", AREA_VALUE))
def q61_weighted_area_ci(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("slice", F.col("domain"))
    return intervals(resample.bootstrap(rows, ["slice"], S.REPLICATES, S.SEED, "sample_weight"))


@query(boot_sql("domain", "1", SPEC_VALUE))
def q62_specificity_ci(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("slice", F.col("domain"))
    return intervals(resample.bootstrap(rows, ["slice"], S.REPLICATES, S.SEED, sensitivity=S.SENSITIVITY))


@query(f"SELECT round(avg(((prob > 0.5)::INT = y)::INT), 6) AS accuracy, round(sum(sample_weight * ((prob > 0.5)::INT = y)::INT) / sum(sample_weight), 6) AS weighted_accuracy, round(sum(CASE WHEN y = 1 THEN ln(prob) ELSE ln(1 - prob) END), 4) AS log_lik FROM {S.SCORED_SQL}")
def q28_accuracy_loglik(spark, sf_dir):
    return scored(spark, sf_dir).agg(r6(metrics.accuracy()).alias("accuracy"), r6(metrics.accuracy(weight="sample_weight")).alias("weighted_accuracy"), F.round(metrics.log_likelihood(), 4).alias("log_lik"))


EDGES = [0.0, 0.1, 0.2, 0.3, 0.5, 1.0]


@query(f"SELECT bin, round(avg(y), 6) AS mean_y, round(avg(prob), 6) AS mean_prob, count(*) AS n FROM (SELECT *, ({' + '.join(f'({e}::DOUBLE < prob)::INT' for e in EDGES[1:-1])})::INT AS bin FROM {S.SCORED_SQL}) GROUP BY bin")
def q29_calibration(spark, sf_dir):
    return metrics.calibration(scored(spark, sf_dir), EDGES).select("bin", r6(F.col("mean_y")).alias("mean_y"), r6(F.col("mean_prob")).alias("mean_prob"), "n")


def slices_sql(expr: str) -> str:
    rows = f"(SELECT *, unnest([{expr}]) AS slice FROM {S.SCORED_SQL})"
    return f"WITH r AS MATERIALIZED (SELECT * FROM {rows}) SELECT b.slice, b.n_samples, round(b.positive_rate, 6) AS positive_rate, round(a.auc, 6) AS auc, round(s.specificity, 6) AS specificity FROM (SELECT slice, count(*) AS n_samples, avg(y) AS positive_rate FROM r GROUP BY slice) b JOIN {auc_sql('r', 'slice', 'sample_weight')} a USING (slice) LEFT JOIN {spec_sql('r', 'slice')} s USING (slice)"


def sliced(df: DataFrame, expr: Column) -> DataFrame:
    rows = metrics.metric_rows(df.withColumn("slice", F.explode(expr)), ["slice"], S.SENSITIVITY, "sample_weight")
    return rows.select("slice", "n_samples", *(r6(F.col(c)).alias(c) for c in ("positive_rate", "auc", "specificity")))


@query(slices_sql("'all', domain"))
def q30_metrics_by_domain(spark, sf_dir):
    return sliced(scored(spark, sf_dir), F.array(F.lit("all"), F.col("domain")))


@query(slices_sql(f"CASE WHEN control < {S.CUTOFF} THEN 'age_below_{S.CUTOFF}' ELSE 'age_above_{S.CUTOFF}' END"))
def q31_metrics_by_age(spark, sf_dir):
    return sliced(scored(spark, sf_dir), F.array(F.when(F.col("control") < S.CUTOFF, f"age_below_{S.CUTOFF}").otherwise(f"age_above_{S.CUTOFF}")))


# ---- concepts


@query(f"SELECT a, b, round(r, 6) AS corr, round(CASE WHEN r IS NULL THEN CASE WHEN gap = 0 THEN 0.0 ELSE 1.0 END ELSE greatest(0.0, 1 - abs(r)) END, 6) AS distance FROM (SELECT x.concept_id AS a, y.concept_id AS b, covar_pop(x.answer, y.answer) / nullif(stddev_pop(x.answer) * stddev_pop(y.answer), 0) AS r, max(abs(x.answer - y.answer)) AS gap FROM {S.ANNOTATIONS_SQL} x JOIN {S.ANNOTATIONS_SQL} y ON x.obs_id = y.obs_id AND x.concept_id < y.concept_id GROUP BY ALL)")
def q32_concept_correlation(spark, sf_dir):
    return cluster.distances(annotated(spark, sf_dir)).select("a", "b", r6(F.col("corr")).alias("corr"), r6(F.col("distance")).alias("distance"))


@query(f"SELECT h.seed, h.concept, round(count(*) / max(least(5, m.n))::DOUBLE, 6) AS inclusion FROM {S.LEDGER_SQL} h JOIN (SELECT seed, max(iter) AS e, count(DISTINCT iter) AS n FROM {S.LEDGER_SQL} GROUP BY seed) m USING (seed) WHERE h.iter > m.e - least(5, m.n) GROUP BY ALL")
def q33_posterior_inclusion(spark, sf_dir):
    return ensemble.inclusion(S.ledger(spark, sf_dir)).select("seed", "concept", r6(F.col("inclusion")).alias("inclusion"))


@query(f"SELECT seed, iter, day FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seed, iter) AS k FROM {S.LEDGER_SQL}) WHERE k = 1")
def q34_first_owner(spark, sf_dir):
    return split.first_owner(S.ledger(spark, sf_dir), F.col("day"), ["seed", "iter"]).select("seed", "iter", "day")


QUERY_STEP = 100  # every row whose id is divisible by it is a query


@query(f"SELECT query_id, rank, vec_id, round(s, 5) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % {QUERY_STEP} = 0) WHERE rank <= 3 AND s >= 0.4")
def q35_similar_vectors(spark, sf_dir):
    items = S.load(spark, sf_dir, "embeddings")
    stated = items.filter(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return context.nearest(items, stated).withColumn("similarity", F.round("similarity", 5))


@query()
def x06_index_search(spark, sf_dir):
    """q35 through an inverted file; recall is measured against the exact search."""
    items = S.load(spark, sf_dir, "embeddings")
    stated = items.filter(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found, share, _ = vector_index.nearest(items, stated)
    return found.withColumn("similarity", F.round("similarity", 5)).withColumn("recall", F.lit(share))


LOOKUPS = ["stupid", "licensed under", "the"]


@query(
    f"""WITH s AS (SELECT doc_id AS obs_id, generate_subscripts(string_split(text, '.'), 1) AS position, trim(unnest(string_split(text, '.'))) AS sentence FROM documents),
h AS (SELECT p.phrase, s.obs_id, min_by(s.sentence, s.position) AS sentence FROM s, {S.values([(p,) for p in LOOKUPS], 'phrase')} p WHERE length(s.sentence) > 20 AND contains(lower(s.sentence), p.phrase) GROUP BY ALL)
SELECT phrase, obs_id, sentence FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY obs_id) AS k FROM h) WHERE k <= 2"""
)
def q36_context_lookup(spark, sf_dir):
    return context.lookup(S.documents(spark, sf_dir), LOOKUPS, most=2).select("phrase", "obs_id", "sentence")


# ---- viewer


@query(f"SELECT d.doc_id AS obs_id, d.lang AS domain FROM documents d JOIN {INDEX_SQL} i ON i.obs_id = d.doc_id WHERE (contains(lower(d.text), 'the') OR contains(lower(d.source), 'the')) AND i.partition = 'train' AND EXISTS (SELECT 1 FROM {S.ANNOTATIONS_SQL} a WHERE a.obs_id = d.doc_id AND a.concept_id = 0 AND a.answer > 0.5) ORDER BY obs_id LIMIT 20 OFFSET 20")
def q37_viewer_filter_page(spark, sf_dir):
    rows = S.documents(spark, sf_dir).join(index(spark, sf_dir), "obs_id")
    held = annotate.annotate_notes(S.documents(spark, sf_dir), S.CONCEPTS[:1], limit=S.SECTION, one_row=True)
    found = viewer.filtered(rows, "the", ["text", "source"], "train", held, 0).select("obs_id", "domain")
    return viewer.page(found, 2)


@query(f"SELECT obs_id, string_agg(name, ', ' ORDER BY concept_id) AS assigned FROM {S.ANNOTATIONS_SQL} JOIN (SELECT concept_id, name FROM {S.CONCEPT_SQL}) USING (concept_id) WHERE answer > 0.5 GROUP BY obs_id")
def q38_assigned_concepts(spark, sf_dir):
    names = F.array(*(F.lit(c["name"]) for c in S.CONCEPTS))
    return viewer.assigned(annotated(spark, sf_dir), F.get(names, F.col("concept_id"))).select("obs_id", F.array_join("assigned", ", ").alias("assigned"))


@query(f"SELECT obs_id, {', '.join(f'max(CASE WHEN concept_id = {c["concept_id"]} THEN answer ELSE 0 END)::DOUBLE AS {c["name"]}' for c in S.CONCEPTS)} FROM {S.ANNOTATIONS_SQL} GROUP BY obs_id")
def q39_wide_export(spark, sf_dir):
    return annotate.wide(annotated(spark, sf_dir), S.CONCEPTS)


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id")
def q40_group_turns(spark, sf_dir):
    return annotate.join_sections(S.load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


#: Questions with the phrasings that names are cleaned of.
QUESTIONS = [c["concept"] for c in S.CONCEPTS] + [
    "Does the note mention that the patient is experiencing pain?", "Does the note mention the patient having a fall?", "Does the note mention the patient having fever?", "Does the note mention that the patient is undergoing dialysis?",
    "Does the note mention the patient requiring oxygen?", "Does the note mention the patient needing help?", "Does the note mention the patient engaging in exercise?", "Does the patient have pain?", "Is the stay > 3 days?", "Is the dose ≥ 5?", "Is it a yes?",
]
CLEAN_SQL = """replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(concept,
'Does the note mention that the patient', 'Does the note mention the patient'), 'Does the note mention ', ''), 'that the patient ', ''), 'the patient ', ''),
'engaging in ', ''), 'experiencing ', ''), 'having a ', ''), 'having ', ''), 'undergoing ', ''), 'requiring ', ''), 'needing ', ''), '?', '')"""


ASKED_SQL = f"(SELECT doc_id AS obs_id, ({[*QUESTIONS]})[1 + doc_id % {len(QUESTIONS)}] || ' ' || coalesce(source, '') || '?' AS concept FROM documents)"


@query(f"SELECT obs_id, {CLEAN_SQL} AS clean, trim(regexp_replace(lower(concept), '[^a-z0-9]+', ' ', 'g')) AS normal, CASE WHEN concept LIKE '%>%' OR concept LIKE '%≥%' THEN CASE WHEN concept LIKE '%h%' OR concept LIKE '%d%' THEN 'duration_days' ELSE 'count' END ELSE 'binary' END AS kind FROM {ASKED_SQL}")
def q41_clean_names(spark, sf_dir):
    """Questions about each document's source."""
    asked = F.concat(F.get(F.array(*map(F.lit, QUESTIONS)), (F.col("obs_id") % len(QUESTIONS)).cast("int")), F.lit(" "), F.coalesce("source", F.lit("")), F.lit("?"))
    rows = S.documents(spark, sf_dir).select("obs_id", asked.alias("concept"))
    return rows.select("obs_id", T.clean_concept(F.col("concept")).alias("clean"), T.normalized_concept(F.col("concept")).alias("normal"), T.value_type(F.col("concept")).alias("kind"))


@query("SELECT event_id, q::INT AS question, CASE WHEN q = event_id % 5 THEN value WHEN q = 1 AND event_id % 7 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS answer FROM (SELECT event_id, value, unnest([1, 2, 3]) AS q FROM events)")
def q42_response_scatter(spark, sf_dir):
    events = S.load(spark, sf_dir, "events")
    item = lambda q, a: F.struct(q.cast("long").alias("question"), a.cast("double").alias("answer"))
    first = item(F.when(F.col("event_id") % 7 != 0, 1).otherwise(9), F.lit(1.0))
    said = F.to_json(F.struct(F.array(first, item(F.col("event_id") % 5, F.col("value"))).alias("extractions")))
    return responses.answers(events.select("event_id", said.alias("json")), ["event_id"], "json", 3)


@query(f"SELECT d.doc_id AS obs_id, c.concept_id::INT AS concept_id FROM documents d, {S.CONCEPT_SQL} c WHERE NOT EXISTS (SELECT 1 FROM {S.ANNOTATIONS_SQL} a WHERE a.obs_id = d.doc_id AND a.concept_id = c.concept_id AND a.answer > 0)")
def q43_uncached_pairs(spark, sf_dir):
    ids = F.array(*(F.lit(c["concept_id"]) for c in S.CONCEPTS))
    wanted = S.documents(spark, sf_dir).select("obs_id", F.explode(ids).alias("concept_id"))
    return annotate.uncached(wanted, annotated(spark, sf_dir).filter("answer > 0"), ["obs_id", "concept_id"])


# ---- fits that SQL cannot express


@query()
def x01_sparse_baseline(spark, sf_dir):
    """Baseline concepts of one seed: sparse path, padding, unpenalised refit."""
    rows = annotate.wide(labelled_answers(spark, sf_dir), S.CONCEPTS).join(S.labels(spark, sf_dir), "obs_id").join(parts(spark, sf_dir).select("obs_id", "part"), "obs_id")
    names = [c["name"] for c in S.CONCEPTS]
    model = select.baseline(select.patterns_of(rows, names, ["part"]), names, 3)
    return spark.createDataFrame([(c, float(b), float(model["intercept"]), model["auc"], model["test_auc"]) for c, b in zip(model["concepts"], model["coefs"], strict=True)], "concept string, coef double, intercept double, auc double, test_auc double")


@query()
def x02_residual_words(spark, sf_dir):
    """Phrases that the insult concept leaves unexplained."""
    notes = S.notes(spark, sf_dir)
    answers = annotate.wide(annotate.annotate_notes(notes.select("obs_id", "text"), S.CONCEPTS[:1], limit=S.SECTION, one_row=True), S.CONCEPTS[:1])
    return residual.fit_residual(notes.join(answers, "obs_id"), ["insult"], "text", weight="sample_weight")


SIDES_SQL = f"(SELECT t.obs_id, token, i.partition = 'train' AS first FROM {TOKENS_SQL} t JOIN labels l ON l.doc_id = t.obs_id JOIN {INDEX_SQL} i ON i.obs_id = t.obs_id)"
SIZES_SQL = f"(SELECT count(*) FILTER (i.partition = 'train') AS n0, count(*) AS n1 FROM documents d JOIN labels l USING (doc_id) JOIN {INDEX_SQL} i ON i.obs_id = d.doc_id)"


@query(
    f"""WITH c AS (SELECT token, count(*) FILTER (first) AS d0, count(*) AS d1 FROM {SIDES_SQL} GROUP BY token)
SELECT 0::INT AS side, token AS feature, round(d0 / n0::DOUBLE, 6) AS freq FROM c, {SIZES_SQL} WHERE d0 > 0 AND d0 / n0::DOUBLE >= 0.01 AND token <> ''
UNION ALL SELECT 1, token, round(d1 / n1::DOUBLE, 6) FROM c, {SIZES_SQL} WHERE d1 / n1::DOUBLE >= 0.01 AND token <> '' AND (starts_with(token, 'tabular feature: ') OR NOT ({' OR '.join(f"contains(token, '{w}')" for w in SYNONYMS if len(w) > 2)}))"""
)
def q64_residual_vocabulary(spark, sf_dir):
    """Phrases and shares of a residual fit with two sides: the train partition, and all labelled notes but for phrases with a kept word."""
    texts = S.documents(spark, sf_dir).select("obs_id", F.array_distinct(T.comma_tokens(T.fold(F.coalesce("text", F.lit(""))))).alias("t"))
    first = F.when(F.col("partition") == "train", 1).otherwise(0)
    about = S.labels(spark, sf_dir).join(index(spark, sf_dir), "obs_id").select("obs_id", F.array(first, F.lit(1)).alias("folds"))
    n = about.join(S.documents(spark, sf_dir).select("obs_id"), "obs_id").agg(F.sum(F.col("folds")[0]).alias("a"), F.count(F.lit(1)).alias("b")).first()
    phrase = texts.select("obs_id", F.explode("t").alias("token")).join(about, "obs_id")
    words = residual.vocabulary(phrase, [residual.Side(), residual.Side(synonyms=tuple(SYNONYMS))], [n["a"] or 0, n["b"] or 0], 0.01)
    each = words.filter("token <> ''").select("token", F.posexplode(F.arrays_zip("active", "share")).alias("side", "z")).filter("z.active")
    return each.select("side", F.col("token").alias("feature"), r6(F.col("z.share")).alias("freq"))


LINKAGE_SQL = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT concept_id, row_number() OVER (ORDER BY concept_id) - 1 AS leaf FROM (SELECT concept_id FROM {S.ANNOTATIONS_SQL} GROUP BY concept_id HAVING max(abs(answer)) > 0)),
d AS MATERIALIZED (SELECT x.concept_id AS a, y.concept_id AS b, covar_pop(x.answer, y.answer) / nullif(stddev_pop(x.answer) * stddev_pop(y.answer), 0) AS r, max(abs(x.answer - y.answer)) AS gap FROM {S.ANNOTATIONS_SQL} x JOIN {S.ANNOTATIONS_SQL} y ON x.obs_id = y.obs_id AND x.concept_id < y.concept_id GROUP BY ALL),
e AS MATERIALIZED (SELECT p.leaf AS a, q.leaf AS b, CASE WHEN r IS NULL THEN CASE WHEN gap = 0 THEN 0.0 ELSE 1.0 END ELSE greatest(0.0, 1 - abs(r)) END AS dist FROM d JOIN v p ON p.concept_id = d.a JOIN v q ON q.concept_id = d.b),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY dist, a, b) AS k FROM e),
g(k, side, node) AS (SELECT k, 0, a FROM o UNION SELECT k, 1, b FROM o UNION SELECT g.k, g.side, CASE WHEN f.a = g.node THEN f.b ELSE f.a END FROM g JOIN o f ON f.k < g.k AND (f.a = g.node OR f.b = g.node)),
m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k) - 1 AS step FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.k = o.k AND g.side = 0 AND g.node = o.b)),
c AS (SELECT m.step, m.dist, g.side, count(*) AS n, min(g.node) AS leaf, (SELECT max(w.step) FROM m w WHERE w.k < m.k AND w.a IN (SELECT node FROM g h WHERE h.k = m.k AND h.side = g.side)) AS made FROM m JOIN g USING (k) GROUP BY m.step, m.dist, m.k, g.side),
i AS (SELECT step, dist, n, CASE WHEN n = 1 THEN leaf ELSE made + (SELECT count(*) FROM v) END AS node FROM c)
SELECT step::INT AS step, min(node)::INT AS "left", max(node)::INT AS "right", round(max(dist), 6) AS distance, sum(n)::INT AS size FROM i GROUP BY step"""


@query(LINKAGE_SQL)
def x03_concept_linkage(spark, sf_dir):
    """Single linkage of the concepts."""
    _, merges = cluster.hierarchy(annotated(spark, sf_dir))
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "step int, left int, right int, distance double, size int")
    return rows.withColumn("distance", r6(F.col("distance")))
