"""Training with controls, tabular candidates and cached answers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.operators import annotate, split
from loomlens.plans.config import EnsembleConfig
from loomlens.plans.state import State
from loomlens.plans.trainer import Trainer


def counting(asked):
    class Counting(annotate.PatternAnnotator):
        def annotate(self, sections, concepts, keep):
            asked.append((sections.select(keep[0]).distinct().count(), len(concepts)))
            return super().annotate(sections, concepts, keep)

    return Counting()


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(200):
        pain, dose, age = rng.random() < 0.4, rng.normal(50, 20), rng.normal(60, 10)
        y = int(rng.random() < 1 / (1 + np.exp(-(2 * pain + (dose - 50) / 8 + (age - 60) / 20 - 1))))
        rows.append((i, ", ".join((["pain"] if pain else []) + [f"word{rng.integers(0, 3)}"]), y, 1.0, float(dose), float(age) if i else None))
    notes = spark.createDataFrame(rows, "obs_id long, text string, y int, sample_weight double, dose double, age double")
    config = EnsembleConfig.from_args(init_seeds=[1], goal_num_meta_concepts=2, max_meta_concepts=3, num_epochs=1, cv=2, final_model_type="l2", force_keep_columns=["age"], keep_x_cols=["dose"], num_top_attributes=5)
    folder, asked = str(tmp_path_factory.mktemp("run")), []
    trainer = Trainer(spark, config, folder, counting(asked))
    trainer.fit(notes)
    return notes, config, folder, trainer, asked


def test_controls_stay_and_tabular_candidates_win(spark, trained):
    notes, _, folder, trainer, _ = trained
    ends = trainer.history.last_concepts(1)
    assert ends[0] == "Tabular feature: age" and len(ends) == 3
    assert "Tabular feature: dose" in ends[1:]  # a real-valued candidate, the strongest of all
    for n in range(trainer.history.length(1)):
        assert [c for s, i, p, c, _ in trainer.history.coefs if i == n and p == 0] == ["Tabular feature: age"]
    stored = {(r.obs_id, r.concept_id): r.answer for r in trainer.cache.collect()}
    age = trainer.concepts["Tabular feature: age"]["concept_id"]
    values = {r.obs_id: r.age for r in notes.collect()}
    mean, std = trainer.scaler.mean["age"], trainer.scaler.std["age"]
    assert stored[5, age] == pytest.approx((values[5] - mean) / std) and stored[0, age] == 0.0  # null: the mean


def test_predictions_equal_the_models_by_hand(spark, trained):
    """New notes are scaled by the stored values, not by their own."""
    notes, _, folder, trainer, _ = trained
    again = Trainer.from_checkpoint(spark, folder)
    few = notes.filter("obs_id < 7").withColumn("obs_id", F.col("obs_id") + 1000)
    got = {r.obs_id: r.prob_1 for r in again.predict(few, use_posterior_iters=1).collect()}
    last = max(r[1] for r in trainer.history.iterations)
    intercept = next(r[6] for r in trainer.history.iterations if r[1] == last)
    for r in few.collect():
        z = intercept
        for _, i, _, concept, coef in trainer.history.coefs:
            if i == last:
                column = concept.removeprefix("Tabular feature: ")
                if column != concept:
                    value = 0.0 if r[column] is None else (r[column] - trainer.scaler.mean[column]) / trainer.scaler.std[column]
                else:
                    value = float(trainer.concepts[concept]["pattern"] in r.text)
                z += coef * value
        assert got[r.obs_id] == pytest.approx(1 / (1 + np.exp(-z)))
    with pytest.raises(ValueError, match="age"):
        again.predict(few.drop("age"))


def test_known_notes_are_not_asked_again(spark, trained):
    notes, _, folder, _, asked = trained
    assert all(n == 200 for n, _ in asked)
    new = []
    again = Trainer.from_checkpoint(spark, folder, annotator=counting(new))
    before = {r.obs_id: r.prob_1 for r in Trainer.from_checkpoint(spark, folder).predict(notes.withColumn("obs_id", F.col("obs_id") + 5000)).collect()}
    got = {r.obs_id + 5000: r.prob_1 for r in again.predict(notes).collect()}
    assert got == pytest.approx(before)
    assert sum(n for n, _ in new) == 0
    new.clear()
    changed = notes.filter("obs_id < 10").withColumn("text", F.when(F.col("obs_id") == 3, "pain and more").otherwise(F.col("text")))
    assert again.predict(changed).count() == 10 and sum(n for n, _ in new) == 1  # another text under a known id


def test_answers_are_appended(trained):
    folder, trainer = trained[2], trained[3]
    parts = [f for f in os.listdir(folder) if f.startswith("answers-")]
    assert len(parts) == len(trainer.state.answers) >= 1
    pairs = trainer.cache.groupBy("obs_id", "concept_id").count().agg(F.max("count")).first()[0]
    assert pairs == 1 and not any("answers" in os.listdir(f"{folder}/{v}") for v in os.listdir(folder) if v.startswith("v"))


def test_other_settings_warn_and_missing_columns_raise(spark, trained, tmp_path):
    notes, config, folder, _, _ = trained
    other = EnsembleConfig.from_args(init_seeds=[1], max_meta_concepts=3, num_epochs=0, force_keep_columns=["age"])
    with pytest.warns(UserWarning, match="epochs"):
        Trainer.from_checkpoint(spark, folder, other)
    assert State([1], 1).compatible(EnsembleConfig.from_args(init_seeds=[1], num_epochs=1)) == []
    with pytest.raises(ValueError, match="dose"):
        Trainer(spark, config, str(tmp_path)).fit(notes.drop("dose"))


def test_repeated_keys_lie_on_one_side(spark):
    df = spark.createDataFrame([(i % 40, i % 2, f"row {i}") for i in range(100)] + [(None, 1, "no key"), (90, None, "no label")], "obs_id long, y int, text string")
    for made, column in ((split.stratified(df, "obs_id", "y", 0.5, 3), "part"), (split.folds(df, "obs_id", "y", 3), "fold"), (split.global_split(df, "obs_id", 0.3, 1), "partition")):
        rows = made.collect()
        assert len(rows) == 102
        sides = {}
        for r in rows:
            if r.obs_id is not None:
                sides.setdefault(r.obs_id, set()).add(r[column])
        assert all(len(v) == 1 for v in sides.values())
        assert next(r[column] for r in rows if r.obs_id is None) is None
    assert next(r.part for r in split.stratified(df, "obs_id", "y", 0.5, 3).collect() if r.obs_id == 90) is None
    assert split.stratified(df.limit(0), "obs_id", "y", 0.5, 3).collect() == []
