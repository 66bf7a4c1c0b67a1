"""Concepts and priors from a model's answers."""

import json
import sys

from pyspark import cloudpickle

from loomlens.plans import proposer
from loomlens.plans.chains import Chains
from loomlens.plans.config import EnsembleConfig

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


ANSWER = {"concepts": [{"concept": " Pain? ", "words": ["pain", "Ache "], "is_risk_factor": True, "prior": 0.4}, {"concept": "Pain?", "words": ["x"]}, {"concept": "Old?", "words": ["old"]}, {"concept": "", "words": ["x"]}, {"concept": "No words?", "words": []}, {"concept": "Fall?", "words": ["fell"], "prior": 7}, {"concept": "More?", "words": ["more"]}]}


def test_prompts_and_proposals():
    asked = []

    def ask(prompts):
        asked.extend(prompts)
        return ["no json"] if len(asked) == 1 else ["Here: " + json.dumps(ANSWER)[:-1]]  # cut off: repaired

    made = proposer.ModelProposer(ask, "first {top_features_df} {max_meta_concepts}", "next {top_features_df}|{num_concepts}|{num_concepts_fixed}|{num_attributes}|{meta_concepts}|{site}", goal=4, settings={"site": "ward"})
    got = made.propose([("a, b", -2.0), ("c", 1.0)], ["Old?", "Kept?"], 2)
    assert [g["concept"] for g in got] == ["Pain?", "Fall?"]
    assert got[0] == {"concept": "Pain?", "words": ["pain", "Ache"], "pattern": "pain|ache", "is_risk_factor": True, "prior": 0.4} and got[1]["prior"] == 0.1
    assert asked[0] == asked[1] == 'next feature_name,coef\n"a, b",-1.000\nc,0.500\n|4|3|2|* X0 = Old? \n* X1 = Kept? \n|ward'
    assert [r for _, r in made.rejected] == ["repeated", "known", "no name or words", "no name or words"]
    assert made.prompt([], [], 9) == "first feature_name,coef\n 9"
    silent = proposer.ModelProposer(lambda p: [None], "x", "y")
    assert silent.propose([("a", 1.0)], [], 3) == []


def test_priors():
    said = {"candidates": [{"candidate": "2", "prior": 0.5}, {"candidate": 2, "prior": 0.6}, {"candidate": 9, "prior": 0.1}, {"candidate": 1, "prior": 3}]}
    model = proposer.ModelPriors(lambda p: [json.dumps(said)] if "1 - a\n2 - b\n" in p[0] else [None], "{candidate_list}")
    assert model.priors(["a", "b"], []) == {"b": 0.6} and model.priors(["z"], []) == {}


def test_chains_use_model_priors(spark, tmp_path):
    chains = Chains(spark, EnsembleConfig.from_args(init_seeds=[1]), str(tmp_path), priors=proposer.ModelPriors(lambda p: ['{"candidates": [{"candidate": 1, "prior": 0.7}]}'], "{candidate_list}"))
    chains._register([{"concept": "a", "pattern": "a"}, {"concept": "b", "pattern": "b", "prior": 0.3}, {"concept": "c", "pattern": "c"}])
    assert chains._prior(["a", "b", "c"], []) == {"a": 0.7, "b": 0.3, "c": 0.1}


class Both:
    """Proposes a word that it is shown, and answers by its questions."""

    def complete(self, prompts, settings):
        out = []
        for p in prompts:
            if p.startswith("propose"):
                out.append(json.dumps({"concepts": [{"concept": f"Is there {w}?", "words": [w]} for w in ("red", "blue") if f"\n{w}," in p]}))
            else:
                questions = [q for q in p.split("\n") if " - Is there " in q]
                out.append(json.dumps({"extractions": [{"question": i + 1, "answer": float(q.split("there ")[1].rstrip("?") in p.split("NOTE")[1])} for i, q in enumerate(questions)]}))
        return out


def test_command_line_trains_with_a_client(spark, tmp_path):
    """Client, templates, phrases by a join column, and settings from a file."""
    import random

    from loomlens import cli
    from loomlens.operators import client

    client.register("both", lambda settings: Both())
    rng = random.Random(3)
    notes, phrases = [], []
    for i in range(60):
        words = [w for w in ("red", "blue", "green") if rng.random() < 0.5]
        notes.append((i, f"v{i}", "note " + " ".join(words), int(rng.random() < (0.9 if "red" in words else 0.1))))
        phrases.append((f"v{i}", ", ".join(words)))
    spark.createDataFrame(notes, "obs_id long, visit string, text string, y int").write.parquet(f"{tmp_path}/notes.parquet")
    spark.createDataFrame(phrases, "visit string, llm_output string").withColumn("obs_id", __import__("pyspark").sql.functions.lit(0)).write.parquet(f"{tmp_path}/phrases.parquet")
    spark.createDataFrame([(i, "train") for i in range(60)], "obs_id long, partition string").write.option("header", True).csv(f"{tmp_path}/index")
    (tmp_path / "prompts").mkdir()
    for name, text in (("extraction", "{prompt_questions}NOTE {sentence}"), ("baseline", "propose\n{top_features_df}"), ("iteration", "propose\n{top_features_df}")):
        (tmp_path / "prompts" / f"{name}.txt").write_text(text)
    (tmp_path / "settings.yaml").write_text("init_seeds: [1]\nllm_model: both\nmax_retries: 0\ngoal_num_meta_concepts: 1\nmax_meta_concepts: 4\nnum_epochs: 0\ncv: 2\nconcept_column: llm_output\njoin_column: visit\n")
    run = f"train --data {tmp_path}/notes.parquet --index {tmp_path}/index --folder {tmp_path}/run --config {tmp_path}/settings.yaml --concepts {tmp_path}/phrases.parquet --templates {tmp_path}/prompts"
    cli.main(run.split(), spark)
    from loomlens.plans.trainer import Trainer

    trainer = Trainer.from_checkpoint(spark, f"{tmp_path}/run")
    assert trainer.history.last_concepts(1) == ["Is there red?"] and trainer.config.client.llm_model == "both"
    assert {r.answer for r in trainer.cache.collect()} == {0.0, 1.0}
