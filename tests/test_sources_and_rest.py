"""Sources, sinks and small operators by round trips and hand-made rows."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomlens import cli
from loomlens.functions import responses
from loomlens.functions import text as T
from loomlens.operators import client, context, metrics, viewer
from loomlens.plans.config import KeyphraseConfig
from loomlens.sources import tables
from loomlens.streaming import scoring


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


def test_prompt_catalogue_names_missing_files(spark, tmp_path):
    for name, text in (("a.txt", "first\nlines"), ("b.txt", "")):
        (tmp_path / name).write_text(text)
    found, missing = tables.prompt_catalogue(spark, str(tmp_path), {"one": ["a.txt", "none.txt"], "two": ["a.txt", "b.txt"]})
    assert sorted(tuple(r) for r in found.collect()) == [("one", "a.txt", "first\nlines"), ("two", "a.txt", "first\nlines"), ("two", "b.txt", "")] or missing == ["b.txt", "none.txt"]
    assert "none.txt" in missing


def test_images_of_equal_names_stay_apart(spark, tmp_path):
    for folder, data in (("x", b"one"), ("y", b"two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "i.png").write_bytes(data)
    rows = spark.createDataFrame([(1, "x/i.png"), (2, "y/i.png"), (3, f"{tmp_path}/x/i.png"), (4, "z/i.png"), (5, None)], "id long, image_path string")
    assert {r.id: r.content and bytes(r.content) for r in tables.images(spark, rows, str(tmp_path)).collect()} == {1: b"one", 2: b"two", 3: b"one", 4: None, 5: None}
    with pytest.raises(ValueError):
        tables.images(spark, rows.drop("image_path"), str(tmp_path))


def test_csv_and_json_round_trips_of_given_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60").withColumn("odd", F.concat(F.lit('q"x, '), F.lit("\n"), F.col("source")))
    tables.write_csv(docs, f"{tmp_path}/csv")
    again = tables.read_csv(spark, f"{tmp_path}/csv", docs.schema)
    assert again.exceptAll(docs).count() == docs.exceptAll(again).count() == 0
    tables.write_clean_csv(docs.withColumnRenamed("text", "sentence"), f"{tmp_path}/out.csv")
    assert "sentence" not in tables.read_csv(spark, f"{tmp_path}/out_clean.csv").columns
    tables.rows_json(docs.select("doc_id", F.lit(None).cast("string").alias("none"), "lang"), f"{tmp_path}/json")
    rows = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert len(rows) == docs.count() and all(r["none"] is None and set(r) == {"doc_id", "none", "lang"} for r in rows)
    evidence = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("turn = 0").select(F.col("conv_id").alias("obs_id"), F.create_map("role", "text").alias("evidence"))
    tables.write_evidence(evidence, f"{tmp_path}/evidence")
    back = tables.read_evidence(spark, f"{tmp_path}/evidence")
    flat = lambda df: df.select("obs_id", F.to_json("evidence").alias("e"))
    assert flat(back).exceptAll(flat(evidence)).count() == 0 and back.count() == evidence.count() and tables.read_evidence(spark, f"{tmp_path}/none") is None


def test_viewer_rows(spark):
    marks = spark.createDataFrame([(1, "note", "b", "x"), (1, "note", "a", "y"), (2, "s", "c", "z")], "obs_id long, source string, text string, concept string")
    joined = viewer.with_notes(viewer.grouped(marks), spark.createDataFrame([(1, "one")], "obs_id long, note string"))
    assert {r.obs_id: (len(r.marks), r.note) for r in joined.collect()} == {1: (2, "one"), 2: (1, None)}
    rows = spark.createDataFrame([(1, "s", 1, 3)], "id long, summary string, label int, outcome int")
    assert json.loads(viewer.example_rows(rows).first().json) == {"id": 1, "summary": "s", "label": 1, "outcome": 3}
    with pytest.raises(ValueError):
        viewer.example_rows(rows.drop("label"))


def test_cards_names_and_repairs(spark):
    card = "concept string, value_type string, rubric struct<positive array<string>, negative array<string>>, evidence array<struct<span string, date string, loc string>>, derived map<string,double>, prior double"
    row = ("c", "count", (["p", "q"], []), [("s", "2020-01-02", None), ("t", None, "HD")], {"d": 2.0}, None)
    flat = responses.card_row(spark.createDataFrame([row], card)).first()
    assert (flat.positive, flat.negative, flat.evidence, json.loads(flat.derived), flat.prior) == ("p; q", "", "s | 2020-01-02; t | HD", {"d": 2.0}, 0.1)
    names = spark.createDataFrame([("renal_failure--stage 3",), (" a ",)], "n string").select(T.display_name(F.col("n")).alias("n")).collect()
    assert [r.n for r in names] == ["Renal Failure Stage 3", "A"]
    texts = spark.createDataFrame([('{"a": 1}',), ('{"a": [1, 2',), ("none",), (None,)], "t string")
    got = [r.t and json.loads(r.t) for r in texts.select(responses.repaired(F.col("t")).alias("t")).collect()]
    assert got == [{"a": 1}, {"a": [1, 2]}, None, None]


def test_quantile_edges(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("prob"), (F.col("id") % 2).cast("int").alias("y"))
    edges = metrics.quantile_edges(df, 4)
    assert edges == pytest.approx([0, 0.25, 0.5, 0.75, 1])
    assert [r.n for r in metrics.calibration(df, edges).orderBy("bin").collect()] == [26, 25, 25, 25]


def test_similar_sentences(spark):
    rows = [(1, "The patient fell at home and was found later by a neighbour there", [1.0, 0.0]), (2, "the patient fell at home and was found later by a friend", [0.9, 0.1]), (3, "x" * 400, [0.8, 0.6]), (4, "far away", [-1.0, 0.0])]
    found = context.similar_sentences(spark.createDataFrame(rows, "sentence_id long, sentence string, vector array<double>"), [(7, [1.0, 0.0])])
    assert sorted((r.query_id, r.rank, r.sentence_id, len(r.sentence)) for r in found.collect()) == [(7, 1, 1, len(rows[0][1])), (7, 2, 3, 250)]


def test_appended_answers_are_stored_once(spark, tmp_path):
    notes = spark.createDataFrame([(1, "x"), (2, "y")], "obs_id long, text string")
    notes.write.parquet(f"{tmp_path}/in")
    answer = lambda batch: batch.select("obs_id", F.lit(0).alias("concept_id"), (F.col("text") == "x").cast("double").alias("answer"))
    run = lambda: scoring.append_answers(spark.readStream.schema(notes.schema).parquet(f"{tmp_path}/in"), answer, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    run()
    notes.withColumn("obs_id", F.col("obs_id") + 10).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert {(r.obs_id, r.answer) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 1.0), (2, 0.0), (11, 1.0), (12, 0.0)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


class Phrases:
    def complete(self, prompts, settings):
        return [None if "broken" in p else '{"keyphrases": ["a b", "c"]}' if "json" in p else "plain, words" for p in prompts]


def test_keyphrases_by_a_settings_file(spark, tmp_path):
    client.register("phrases", lambda settings: Phrases())
    (tmp_path / "prompt.txt").write_text("List: {sentence}")
    given = {"llm_model_type": "phrases", "prompt_file": f"{tmp_path}/prompt.txt", "cache_file": f"{tmp_path}/cache", "seed": 1, "batch_size": 2, "num_new_tokens": 9, "prompt_placeholder": "{sentence}", "text_column": "text", "is_image": False, "index_col": None, "llm_outputs_file": f"{tmp_path}/out", "log_file": "log"}
    (tmp_path / "k.yaml").write_text("".join(f"{k}: {json.dumps(v)}\n" for k, v in given.items()))
    spark.createDataFrame([(1, "json"), (2, "other"), (3, "other"), (4, None)], "obs_id long, text string").write.parquet(f"{tmp_path}/n.parquet")
    cli.main(f"extract --data {tmp_path}/n.parquet --config {tmp_path}/k.yaml".split(), spark)
    rows = {r.obs_id: r.llm_output for r in tables.read_csv(spark, f"{tmp_path}/out", "obs_id long, text string, llm_output string").collect()}
    assert rows == {1: "a b,c", 2: "plain, words", 3: "plain, words", 4: None} or rows[4] == ""
    assert client.Answers(spark, f"{tmp_path}/cache").known().count() == 2
    for bad in ({"more": 1}, {"seed": -1}, {"batch_size": 0}, {"prompt_file": ""}):
        with pytest.raises(ValueError):
            KeyphraseConfig.from_dict(given | bad)
    with pytest.raises(ValueError):
        KeyphraseConfig.from_dict({k: v for k, v in given.items() if k != "seed"})
