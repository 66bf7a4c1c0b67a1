"""Model clients with failures, and validation with quarantine."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomlens.functions import validate
from loomlens.operators import annotate, client
from loomlens.operators.client import Answers, Asker, ClientSettings


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


class Flaky:
    """Fails for each prompt as often as it says, by files that all workers see."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, prompts, settings):
        out = []
        for p in prompts:
            name = f"{self.folder}/{p.split(':')[0]}"
            with open(name, "a") as f:
                f.write("x")
            seen, fails = os.path.getsize(name), int(p.split(":")[1])
            out.append(f"{settings.name} says {p}" if seen > fails else None if seen % 2 else ValueError("try again"))
        return out


def asker(folder, retries=3, **more):
    return Asker(ClientSettings("fake-1", max_retries=retries, pause=0.0, batch_size=4, **more), lambda settings: Flaky(folder))


def calls(folder):
    return {f: os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)}


def test_each_prompt_is_answered_once(spark, tmp_path):
    """Prompts fail 0 to 5 times; three retries answer most, the next run asks the rest alone."""
    seen = tmp_path / "seen"
    seen.mkdir()
    rows = [(i, f"p{i}:{i % 6}") for i in range(24)] + [(100, "p1:1"), (101, None)]
    prompts = spark.createDataFrame(rows, "id long, prompt string").repartition(5)
    answers = Answers(spark, str(tmp_path / "answers"))
    got = {r.id: r for r in answers.ask(prompts, asker(str(seen))).collect()}
    for i in range(24):
        fails = i % 6
        assert (got[i].response is not None) == (fails <= 3) and got[i].tries == min(fails + 1, 4)
        assert got[i].error is None if fails <= 3 else "no answer" in got[i].error or "try again" in got[i].error
    assert got[100].response == got[1].response and got[101].response is None and got[101].tries is None
    before = calls(seen)
    assert before["p1"] == 2 and before["p5"] == 4
    again = {r.id: r for r in answers.ask(prompts, asker(str(seen))).collect()}
    assert all(r.response is not None for i, r in again.items() if i != 101)
    after = calls(seen)
    assert all(after[f"p{i}"] == before[f"p{i}"] for i in range(24) if i % 6 <= 3) and after["p5"] == 6
    assert again[0].tries is None  # known
    third = answers.ask(prompts, asker(str(seen)))
    assert third.filter("tries is not null").count() == 0 and calls(seen) == after
    other = answers.ask(prompts.filter("id = 0"), asker(str(seen), temperature=0.5))  # another setting is another answer
    assert other.first().tries == 1
    assert answers.ask(prompts.limit(0), asker(str(seen))).collect() == []


def test_pauses_grow_and_are_bounded():
    slept, fails = [], iter([1, 1, 1, 1, 0])

    class Down:
        def complete(self, prompts, settings):
            if next(fails):
                raise TimeoutError("down")
            return ["ok"]

    ask = Asker(ClientSettings("x", max_retries=4, pause=1.0, longest_pause=3.0), lambda s: Down(), sleep=slept.append)
    assert ask.detailed(["p"]) == [("ok", None, 5)] and slept == [1.0, 2.0, 3.0, 3.0]
    short = Asker(ClientSettings("x", max_retries=0), lambda s: type("Few", (), {"complete": lambda *_: []})())
    assert short.detailed(["a", "b"])[0][1].startswith("ValueError: 0 answers")


def test_registry_and_roles():
    made = []
    client.register("fake", lambda s: made.append(s.name))
    client.register("fake-large", lambda s: None)
    assert client.factory_of("fake-large-2") is client.REGISTRY["fake-large"] and client.factory_of("fake-1") is client.REGISTRY["fake"]
    one = client.clients("fake-1", temperature=0.2)
    assert one["iter"] is one["extraction"] and one["iter"].settings.temperature == 0.2
    two = client.clients("fake-1", llm_iter="fake-large")
    assert two["iter"].settings.name == "fake-large" and two["extraction"].settings.name == "fake-1"
    for bad in (lambda: client.factory_of("none"), lambda: client.clients(llm_iter="fake"), lambda: ClientSettings("", max_retries=1), lambda: ClientSettings("x", max_retries=-1)):
        with pytest.raises(ValueError):
            bad()


class Judge:
    """Answers questions about a note; every other answer is cut off at first."""

    def complete(self, prompts, settings):
        return [json.dumps({"extractions": [{"question": 1, "answer": float("pain" in p)}]}) for p in prompts]


def test_answers_of_another_form_are_failures(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "pain"), (2, "free text")], "id long, prompt string")

    class Mixed(Judge):
        def complete(self, prompts, settings):
            return [a if "pain" in p else "just words" for p, a in zip(prompts, super().complete(prompts, settings))]

    ask = Asker(ClientSettings("m", max_retries=1, pause=0.0, response_model="extractions array<struct<question long, answer double>>"), lambda s: Mixed())
    got = {r.id: r for r in Answers(spark, str(tmp_path)).ask(prompts, ask).collect()}
    assert got[1].response and got[2].response is None and got[2].error.startswith("rejected")

    def check(text):
        if not text.startswith("{"):
            raise ValueError("no object")

    ask = Asker(ClientSettings("m", max_retries=2, pause=0.0), lambda s: Mixed(), check)
    assert ask.detailed(["pain", "words"])[1] == (None, "rejected: no object", 3)


def test_annotator_asks_through_a_client(spark):
    notes = spark.createDataFrame([(1, "pain here"), (2, "nothing")], "obs_id long, text string")
    model = annotate.ModelAnnotator(Asker(ClientSettings("m"), lambda s: Judge()), "{prompt_questions}\n{sentence}")
    got = {(r.obs_id, r.concept_id): r.answer for r in annotate.annotate_notes(notes, [{"concept_id": 3, "concept": "Is there any?"}], model).collect()}
    assert got == {(1, 3): 1.0, (2, 3): 0.0}


def test_lenient_objects(spark):
    texts = {
        '{"a": 1} // {"a": 2}': {"a": "1"},
        'x {"a": 1, "b": "u // v"} y {"a": {"c": [1, 2]}} {bad}': {"a": '{"c":[1,2]}', "b": "u // v"},
        '{"a": "}{", "b": {"c": {"d": {"e": 1}}}}': {"a": "}{", "b": '{"c":{"d":{"e":1}}}'},
        '{"a": 1, "b": [2, 3': {"a": "1", "b": "[2,3]"},
        "no object": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.m for r in validate.merged(rows, F.col("t"), "m").collect()}
    assert {k: v and {a: b.replace(" ", "") if b[:1] in "[{" else b for a, b in v.items()} for k, v in got.items()} == texts


def test_quarantine_counts_and_reasons(spark, tmp_path):
    rows = spark.createDataFrame([("3", "0.5"), (" 4.0 ", "1"), ("4.5", "0"), ("x", "2"), (None, None), ("11", "0.1")], "question string, answer string")
    fields = F.create_map(F.lit("question"), F.col("question"), F.lit("answer"), F.col("answer"))

    def save(df):
        df.write.parquet(f"{tmp_path}/judged")
        return spark.read.parquet(f"{tmp_path}/judged")

    good, bad, seen = validate.quarantine(rows.withColumn("fields", fields), validate.answer_rules(F.col("fields"), 10), save)
    assert {r.question for r in good.collect()} == {"3", " 4.0 "} and "reasons" not in good.columns
    assert {r.question: r.reasons for r in bad.collect()} == {"4.5": ["question"], "x": ["question", "answer"], None: ["question", "answer"], "11": ["question"]}
    assert seen.get == {"n": 6, "accepted": 2, "no_object": 0, "question": 4, "answer": 2}
    pairs = "array<struct<concept string, evidence string>>"
    some = spark.createDataFrame([([("a", "x")],), ([("a", " ")],), ([],), (None,), ([("", "x"), ("b", "y")],)], f"p {pairs}")
    got = [r.reasons for r in validate.judged(some, validate.evidence_rules(F.col("p"))).collect()]
    assert got == [[], ["evidence"], ["no_concepts"], ["no_concepts", "concept", "evidence"], ["concept"]]
