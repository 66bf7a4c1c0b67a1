"""Queries of single pieces over whole tables: templates, scaling, sets, caches,
priors, evidence, reviewers' groups, curves and event rates, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses, validate
from ..functions import text as T
from ..operators import annotate, ensemble, features, metrics, viewer
from ..sources import tables
from ..streaming import scoring
from . import setting as S
from .catalog import INDEX_SQL, index, labelled_scores, query, r6, scored

WHO = "coalesce(lang, '?')"


@query(f"SELECT doc_id AS obs_id, 'Note ' || doc_id || ' in ' || {WHO} || ' from ' || source || ': ' || {WHO} AS prompt, '1 - ' || {WHO} || chr(10) || '2 - ' || source || chr(10) AS numbered, '* X0 = ' || {WHO} || ' ' || chr(10) || '* X1 = ' || source || ' ' || chr(10) AS starred, CASE WHEN source LIKE '%a%' THEN replace(source, 'a', {WHO} || chr(10) || 'a') ELSE source || chr(10) || {WHO} END AS injected FROM documents")
def q45_prompt_texts(spark, sf_dir):
    rows = S.documents(spark, sf_dir).withColumn("lang", F.coalesce("domain", F.lit("?")))
    both = F.array("lang", "source")
    prompt = T.fill(F.lit("Note {id} in {lang} from {source}: {lang}"), {"id": F.col("obs_id").cast("string"), "lang": F.col("lang"), "source": F.col("source")})
    return rows.select("obs_id", prompt.alias("prompt"), T.numbered(both).alias("numbered"), T.starred(both).alias("starred"), T.inject(F.col("source"), F.col("lang"), "a").alias("injected"))


@query("SELECT doc_id AS obs_id, 'feature,coef' || chr(10) || 'length,' || printf('%.3f', n_chars / greatest(n_chars, 500.0::DOUBLE)) || chr(10) || 'base,' || printf('%.3f', -500.0::DOUBLE / greatest(n_chars, 500.0::DOUBLE)) AS lines FROM documents")
def q46_coefficient_lines(spark, sf_dir):
    row = lambda name, x: F.struct(F.lit(name).alias("feature"), x.cast("double").alias("coef"))
    rows = F.array(row("length", F.col("control")), row("base", F.lit(-500.0)))
    return S.documents(spark, sf_dir).select("obs_id", T.coefficient_lines(rows).alias("lines"))


@query(f"SELECT d.doc_id AS obs_id, round((d.n_chars - s.m) / CASE WHEN s.s > 0 THEN s.s ELSE 1 END, 5) AS control FROM documents d, (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents JOIN {INDEX_SQL} i ON i.obs_id = doc_id WHERE i.partition = 'train') s")
def q47_scaled_controls(spark, sf_dir):
    """Controls of all notes, scaled by the train partition's stored values."""
    notes = S.documents(spark, sf_dir)
    train = notes.join(index(spark, sf_dir).filter("partition = 'train'"), "obs_id")
    scaler = features.Scaler.load(features.Scaler.fit(train, ["control"]).dump())
    return features.feature_table(notes, [], ["control"], scaler).select("obs_id", F.round("control", 5).alias("control"))


@query("SELECT doc_id AS obs_id, c::INT AS concept_id, coalesce(CASE c WHEN 10 THEN n_chars ELSE length(source) END, 0)::DOUBLE AS answer FROM (SELECT *, unnest([10, 11]) AS c FROM documents)")
def q48_tabular_concepts(spark, sf_dir):
    concepts = [{"concept_id": i, "concept": features.TABULAR + c} for i, c in ((10, "control"), (11, "source_length"))] + S.CONCEPTS
    notes = S.documents(spark, sf_dir).withColumn("source_length", F.length("source"))
    return features.tabular_answers(notes, concepts)


@query("SELECT doc_id AS obs_id FROM documents INTERSECT SELECT doc_id FROM labels")
def q49_common_keys(spark, sf_dir):
    return tables.common_keys(S.documents(spark, sf_dir), S.labels(spark, sf_dir))


@query("SELECT doc_id AS obs_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def q50_excluded_notes(spark, sf_dir):
    decisions = S.labels(spark, sf_dir).select("obs_id", (F.col("y") == 1).alias("exclude"))
    return tables.without_excluded(S.documents(spark, sf_dir), decisions).select("obs_id", "source")


@query("SELECT coalesce(l.doc_id, d.doc_id) AS obs_id, 0::INT AS concept_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality + 0.5 ELSE 0.25 END::DOUBLE AS answer FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def q51_cache_merge(spark, sf_dir):
    """Cached answers of all notes; fresh ones of the labelled notes replace theirs."""
    row = lambda x: (F.lit(0).alias("concept_id"), x.cast("double").alias("answer"))
    cache = S.documents(spark, sf_dir).select("obs_id", *row(F.lit(0.25)))
    fresh = S.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("obs_id"), *row(F.col("quality") + 0.5))
    return annotate.merge_cache(cache, fresh, ["obs_id", "concept_id"])


@query("SELECT d.doc_id AS candidate_id, coalesce(p.prior, 0.1)::DOUBLE AS prior FROM documents d LEFT JOIN (SELECT user_id, max_by(value / 100, event_id) AS prior FROM events WHERE event_id % 3 > 0 AND value IS NOT NULL GROUP BY user_id) p ON p.user_id = d.doc_id")
def q52_prior_fill(spark, sf_dir):
    """Of an id's priors the one of its last position; ids without one have 0.1."""
    prior = F.when(F.col("event_id") % 3 > 0, F.col("value") / 100)
    priors = S.load(spark, sf_dir, "events").select(F.col("user_id").alias("candidate_id"), prior.alias("prior"), F.col("event_id").alias("position"))
    return responses.with_priors(S.documents(spark, sf_dir).select(F.col("obs_id").alias("candidate_id")), priors)


@query("SELECT conv_id, turn, role AS phrase, 'second' AS evidence FROM conversations WHERE role <> '' UNION ALL SELECT conv_id, turn, 'turn ' || turn, 'first' FROM conversations WHERE role IS NULL OR 'turn ' || turn <> role UNION ALL SELECT conv_id, turn, 'both', CASE WHEN turn % 2 = 0 THEN 'second' ELSE 'first' END FROM conversations")
def q53_evidence_map(spark, sf_dir):
    """Phrases of two findings a turn; a phrase of both has the later evidence."""
    pair = lambda phrase, said: F.struct(phrase.alias("phrase"), F.lit(said).alias("evidence"))
    first = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(", both ,"))
    second = F.concat(F.coalesce("role", F.lit("")), F.when(F.col("turn") % 2 == 0, " , both,").otherwise(",,"))
    found = responses.evidence_map(F.array(pair(first, "first"), pair(second, "second")))
    return S.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(found).alias("phrase", "evidence"))


@query(f"SELECT obs_id, seed, iter, round(ln(prob / (1 - prob)), 5) AS logit FROM {S.SCORES_SQL} JOIN labels ON doc_id = obs_id")
def q54_logit(spark, sf_dir):
    out = labelled_scores(spark, sf_dir)
    return out.select("obs_id", "seed", "iter", F.round(T.logit(F.col("prob")), 5).alias("logit"))


@query("SELECT conv_id AS obs_id, count(*) AS n, string_agg(coalesce(role, '-') || ':' || turn, ' ' ORDER BY role NULLS FIRST, turn) AS marks FROM conversations GROUP BY conv_id")
def q55_grouped_marks(spark, sf_dir):
    marks = S.load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("obs_id"), F.col("role").alias("source"), F.lpad(F.col("turn").cast("string"), 10, "0").alias("text"), F.lit("turn").alias("concept"))
    said = F.transform("marks", lambda m: F.concat(F.coalesce(m["source"], F.lit("-")), F.lit(":"), m["text"].cast("long").cast("string")))
    return viewer.grouped(marks).select("obs_id", F.size("marks").cast("long").alias("n"), F.array_join(said, " ").alias("marks"))


@query(f"SELECT prob AS threshold, round(sum(n) OVER w / sum(n) OVER ()::DOUBLE, 6) AS fpr, round(sum(p) OVER w / sum(p) OVER ()::DOUBLE, 6) AS tpr FROM (SELECT prob, count(*) FILTER (y = 0) AS n, count(*) FILTER (y = 1) AS p FROM {S.SCORED_SQL} GROUP BY prob) WINDOW w AS (ORDER BY prob DESC)")
def q56_roc_points(spark, sf_dir):
    points = metrics.roc_points(scored(spark, sf_dir), [])
    return points.select("threshold", r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


@query("SELECT strftime(to_timestamp(floor(epoch(ts) / 300) * 300) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def q57_event_rates(spark, sf_dir):
    """Rates by windows of five minutes (the streaming operator, over the whole table)."""
    rates = scoring.event_rates(S.load(spark, sf_dir, "events"))
    return rates.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"SELECT seed, iter, concept, coef, 'last' AS part FROM (SELECT *, max(iter) OVER (PARTITION BY seed) AS e FROM {S.LEDGER_SQL}) WHERE iter > e - 2 UNION ALL SELECT seed, iter, concept, coef, 'baseline' FROM {S.LEDGER_SQL} WHERE iter = 0")
def q58_iteration_window(spark, sf_dir):
    coefs = S.ledger(spark, sf_dir).select("seed", "iter", "concept", "coef")
    last = ensemble.window(coefs, 2).withColumn("part", F.lit("last"))
    return last.unionByName(ensemble.window(coefs, baseline=True).withColumn("part", F.lit("baseline")))


@query("SELECT doc_id AS obs_id, source IS NOT NULL AND trim(source) <> '' AND lang IS NOT NULL AS valid, coalesce(source, '') IN ('binary', 'count') AS kind FROM documents")
def q59_valid_concepts(spark, sf_dir):
    words = F.when(F.col("domain").isNotNull(), F.array("domain"))
    kind = F.coalesce(responses.valid_value_type(F.col("source")), F.lit(False))
    return S.documents(spark, sf_dir).select("obs_id", responses.valid_concept(F.col("source"), words).alias("valid"), kind.alias("kind"))


@query(f"SELECT obs_id, round(avg(prob), 6) AS prob_1 FROM {S.SCORES_SQL} JOIN documents ON doc_id = obs_id WHERE text IS NOT NULL GROUP BY obs_id")
def q60_stream_scores(spark, sf_dir):
    """The streaming scorer over the whole table: the batch ensemble's means."""
    models = [{"intercept": b, "coefs": coefs} for _, _, b, coefs in S.MODELS]
    return scoring.score_stream(S.documents(spark, sf_dir), S.CONCEPTS, models, limit=S.SECTION).select("obs_id", r6(F.col("prob_1")).alias("prob_1"))


RAW_SQL = """CASE turn % 6 WHEN 0 THEN '{"question": ' || (turn + 1) || ', "answer": 0.5} // {"answer": 9}' WHEN 1 THEN 'first {"question": "' || (turn + 1) || '", "who": {"role": "' || role || '"}} then {"answer": 1}' WHEN 2 THEN '{"question": 2.0, "answer": ' || length(role) || '}' WHEN 3 THEN '{"question": "many", "answer": "0.25"}' WHEN 4 THEN 'nothing here' ELSE '{"question": 99, "answer": 0, "text": "a } brace // and no comment"}' END"""


@query(
    "SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN turn + 1 WHEN 1 THEN turn + 1 WHEN 2 THEN 2 WHEN 5 THEN 99 END::INT AS question, CASE turn % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 1 WHEN 2 THEN length(role) WHEN 3 THEN 0.25 WHEN 5 THEN 0 END::DOUBLE AS answer, "
    "CASE turn % 6 WHEN 2 THEN 'answer' WHEN 3 THEN 'question' WHEN 4 THEN 'no_object,question,answer' WHEN 5 THEN 'question' ELSE '' END AS reasons FROM conversations"
)
def q63_validated_answers(spark, sf_dir):
    """Answers of each turn in lenient JSON: accepted ones, and rejected ones with their reasons."""
    said = S.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(RAW_SQL).alias("raw"))
    turns = validate.merged(said, F.col("raw"), "fields").select("conv_id", "turn", "fields")
    fields = F.col("fields")
    accepted, rejected, _ = validate.quarantine(turns, validate.answer_rules(fields, 10))
    both = accepted.withColumn("reasons", F.array().cast("array<string>")).unionByName(rejected)
    return both.select("conv_id", "turn", validate.as_int(fields["question"]).alias("question"), validate.as_double(fields["answer"]).alias("answer"), F.array_join("reasons", ",").alias("reasons"))
