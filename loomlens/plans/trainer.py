"""fit and predict: the driver loops over epochs and slots, all seeds in one job each."""

from __future__ import annotations

import uuid
import warnings
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, ensemble, features, residual, select, split
from ..schema import ANNOTATION
from ..shared import Shelf
from ..shipping import ship
from .config import EnsembleConfig, Phase
from .history import History
from .state import Checkpoints, State


class Proposer(Protocol):
    """Concepts ({concept, pattern, words, is_risk_factor}) that may explain words."""

    def propose(self, words: list[tuple[str, float]], kept: list[str], n: int) -> list[dict]: ...


class WordProposer:
    """Offline default: each residual phrase is a concept of its own."""

    def propose(self, words: list[tuple[str, float]], kept: list[str], n: int) -> list[dict]:
        import re

        out = []
        for word, coef in words:
            name = f"Does the note mention {word}?"
            if name not in kept and len(out) < n:
                out.append({"concept": name, "pattern": re.escape(word), "words": [word], "is_risk_factor": coef > 0})
        return out


class Trainer:
    """Trains, resumes and applies the ensembles of all seeds.

    Controls (`force_keep_columns`) are columns that stay in every model; tabular
    candidates (`keep_x_cols`) are columns that the search may take. Both are concepts
    named "Tabular feature: <column>", read from the notes, scaled by values that the first fit stores.

    Answers are parts of (obs_id, concept_id, answer) in the folder: each call appends what the parts before it
    lack, and checkpoints name the parts."""

    def __init__(self, spark: SparkSession, config: EnsembleConfig, folder: str, annotator: annotate.Annotator | None = None, proposer: Proposer | None = None, ask=None, template: str | None = None):
        ship(spark)
        self.spark, self.config, self.folder = spark, config, folder
        if annotator is None and ask is not None:
            annotator = annotate.ModelAnnotator(ask, template, config.training.batch_concept_size)
        self.annotator, self.proposer = annotator or annotate.PatternAnnotator(), proposer or WordProposer()
        self.history, self.concepts = History(), {}
        self.checkpoints = Checkpoints(spark, folder)
        c = config.concept
        self.state = State(list(config.init_seeds), config.training.epochs, goal=c.goal_num_meta_concepts, max_meta_concepts=c.max_meta_concepts, num_greedy_holdout=config.training.num_greedy_holdout)
        self.scaler: features.Scaler | None = None
        self._split: DataFrame | None = None
        self._whole: set[int] = set()  # concepts whose answers for the notes of this fit are known to be complete

    @property
    def cache(self) -> DataFrame | None:
        if not self.state.answers:
            return None
        return self.spark.read.schema(ANNOTATION).parquet(*self.state.answers)

    # ---- concepts and their answers

    @property
    def controls(self) -> list[str]:
        return [features.TABULAR + c for c in self.config.force_keep_columns or []]

    @property
    def tabular(self) -> list[str]:
        return [features.TABULAR + c for c in self.config.data.keep_x_cols or []]

    def _register(self, proposals: list[dict]) -> list[str]:
        """Gives new concepts an id; the first proposal of a name stays."""
        for p in proposals:
            if p["concept"] not in self.concepts:
                n = len(self.concepts)
                self.concepts[p["concept"]] = {"pattern": None, **p, "concept_id": n, "name": f"c{n}"}
        return [p["concept"] for p in proposals]

    def _keyed(self, notes: DataFrame) -> DataFrame:
        """(obs_id, text_key): what an answer was given to."""
        return notes.select("obs_id", F.xxhash64(F.col(self.config.data.text_summary_column)).alias("text_key"))

    def _append(self, answers: DataFrame) -> None:
        path = f"{self.folder}/answers-{uuid.uuid4().hex[:12]}"
        answers.select("obs_id", F.col("concept_id").cast("int").alias("concept_id"), F.col("answer").cast("double").alias("answer")).write.parquet(path)
        self.state.answers = [*self.state.answers, path]

    def _answered(self, notes: DataFrame, asked: list[dict]) -> DataFrame:
        """Answers of concepts of all kinds for all notes, without the cache."""
        d = self.config.data
        said = [c for c in asked if not c["concept"].startswith(features.TABULAR)]
        out = annotate.annotate_notes(notes, said, self.annotator, d.text_summary_column, d.max_section_length).select("obs_id", "concept_id", "answer") if said else None
        read = [c for c in asked if c["concept"].startswith(features.TABULAR)]
        if read:
            own = features.tabular_answers(notes, read, scaler=self.scaler)
            out = own if out is None else out.unionByName(own)
        return out

    def _annotate(self, notes: DataFrame, names: list[str]) -> None:
        """Appends the answers of (note, concept) pairs that the parts lack."""
        asked = [self.concepts[n] for n in dict.fromkeys(names)]
        cache = self.cache
        open_ = [c for c in asked if c["concept_id"] not in self._whole]
        if not open_:
            return
        have = set() if cache is None else {r[0] for r in cache.filter(F.col("concept_id").isin([c["concept_id"] for c in open_])).select("concept_id").distinct().collect()}
        new = [c for c in open_ if c["concept_id"] not in have]
        known = [c for c in open_ if c["concept_id"] in have]
        if known:
            pairs = notes.select("obs_id", F.explode(F.array(*(F.lit(c["concept_id"]) for c in known))).alias("concept_id"))
            short = {r[0] for r in annotate.uncached(pairs, cache, ["obs_id", "concept_id"]).select("concept_id").distinct().collect()}
            for c in known:  # each by itself: no pair is asked twice
                if c["concept_id"] in short:
                    own = cache.filter(F.col("concept_id") == c["concept_id"]).select("obs_id")
                    self._append(self._answered(notes.join(own, "obs_id", "left_anti"), [c]))
        if new:
            self._append(self._answered(notes, new))
        if new or known:
            path = f"{self.folder}/seen-{uuid.uuid4().hex[:12]}"
            if not self._whole:
                self._keyed(notes).write.parquet(path)
                self.state.seen = [*self.state.seen, path]

    def _matrix(self, notes: DataFrame, names: list[str]) -> DataFrame:
        own = [self.concepts[n] for n in dict.fromkeys(names)]
        ids = [c["concept_id"] for c in own]
        pivoted = annotate.wide(self.cache.filter(F.col("concept_id").isin(ids)), own)
        return notes.select("obs_id", "y", "sample_weight").join(pivoted, "obs_id", "left").na.fill(0.0, [c["name"] for c in own])

    def _short(self, names: list[str]) -> list[str]:
        return [self.concepts[n]["name"] for n in names]

    # ---- rows of the seeds

    def _prepare(self, notes: DataFrame) -> None:
        """Checks the notes, fits the scaler once, and writes each seed's parts and folds."""
        d, t = self.config.data, self.config.training
        columns = [c.removeprefix(features.TABULAR) for c in (*self.controls, *self.tabular)]
        missing = sorted({"obs_id", "y", "sample_weight", d.text_summary_column, d.concept_column, *columns} - set(notes.columns))
        if missing:
            raise ValueError(f"missing columns: {missing}")
        if self.scaler is None and columns:
            self.scaler = features.Scaler.fit(notes, sorted(set(columns)))
        self.state.scaler = self.scaler.dump() if self.scaler else None
        self._whole = set()
        self._register([{"concept": n} for n in (*self.controls, *self.tabular)])
        smallest = min(r["n"] for r in notes.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect())
        out = notes.select("obs_id", "y", "sample_weight")
        for i, s in enumerate(self.state.seeds):
            cut = split.stratified(notes.select("obs_id", "y"), "obs_id", "y", t.train_frac, s)
            cut = split.folds(cut, "obs_id", "y", split.fold_count(smallest, t.cv), f"{s}/fold")
            out = out.join(cut.select("obs_id", F.col("part").alias(f"part{i}"), F.col("fold").alias(f"fold{i}")).dropDuplicates(["obs_id"]), "obs_id")
        self._split = Shelf(self.spark, "split").keep(out, "split")

    def _parts(self, seed: int) -> DataFrame:
        i = self.state.seeds.index(seed)
        return self._split.select("obs_id", F.col(f"part{i}").alias("part"), F.col(f"fold{i}").alias("fold"))

    def _residuals(self, notes: DataFrame, kept: dict[int, list[str]], factor: float, k: int, use_accuracy: bool) -> dict[int, list[tuple[str, float]]]:
        """The top phrases of every seed, from one fit."""
        m, d, seeds = self.config.model, self.config.data, self.state.seeds
        trained = F.array(*(F.when(F.col(f"part{i}") == "train", F.col(f"fold{i}")).otherwise(0) for i in range(len(seeds))))
        rows = self._split.select("obs_id", trained.alias("folds")).join(notes.select("obs_id", "y", "sample_weight", F.col(d.concept_column).alias("_phrases")), "obs_id")
        names = [n for s in seeds for n in kept[s]]
        if names:
            self._annotate(notes, names)
            rows = rows.join(self._matrix(notes, names).drop("y", "sample_weight"), "obs_id")
        sides = []
        for s in seeds:
            own = [n for n in kept[s] if n not in self.controls]
            words = [w for n in own if n not in self.tabular for w in self.concepts[n].get("words") or []]
            sides.append(residual.Side(tuple(self._short(own)), tuple(self._short([n for n in kept[s] if n in self.controls])), tuple(words)))
        coefs, _ = residual.fit_residuals(rows, sides, "_phrases", m.residual_model_type, use_accuracy=use_accuracy, factor=factor, least=d.min_prevalence, kind=m.count_vectorizer)
        return {s: [(r["feature"], r["coef"]) for r in residual.top_words(coefs.filter(F.col("side") == i).drop("side"), k).collect()] for i, s in enumerate(seeds)}

    # ---- training

    def fit(self, notes: DataFrame, resume: bool = True) -> History:
        """notes: obs_id (once each), y (0/1), sample_weight, text columns, and the columns of controls and tabular candidates."""
        kinds = {r[0] for r in notes.select("y").distinct().collect()}
        if kinds != {0, 1}:
            raise ValueError("labels must be 0 and 1")
        found = self.checkpoints.load() if resume else None
        if found:
            self._restore(*found)
        self._prepare(notes)
        if self.state.phase in (Phase.NOT_STARTED, Phase.BASELINE_RUNNING):
            self._baseline(notes)
        self._greedy(notes)
        return self.history

    def continue_training(self, notes: DataFrame, epochs: int) -> History:
        if epochs > 0:
            self.state.num_epochs += epochs
            self.state.phase = Phase.BASELINE_COMPLETE
        return self.fit(notes, resume=False)

    def _ready(self, notes: DataFrame, names: list[str]) -> None:
        self._annotate(notes, names)
        self._whole |= {self.concepts[n]["concept_id"] for n in names}

    def _baseline(self, notes: DataFrame) -> None:
        self.state.phase = Phase.BASELINE_RUNNING
        c = self.config.concept
        fixed = list(dict.fromkeys([*self.controls, *self.tabular]))
        words = self._residuals(notes, {s: fixed for s in self.state.seeds}, residual.FACTOR_INIT, self.config.data.num_top_attributes, self.config.model.use_acc)
        pools = {s: self._register(self.proposer.propose(words[s], [], c.max_meta_concepts)) for s in self.state.seeds}
        self._ready(notes, [*self.controls, *(n for pool in pools.values() for n in pool)])
        for seed, pool in pools.items():
            rows = self._matrix(notes, [*self.controls, *pool]).join(self._parts(seed), "obs_id")
            model = select.baseline_of(rows, self._short(pool), c.goal_num_meta_concepts, self._short(self.controls))
            self.history.append(seed, "baseline", model | {"concepts": [self._full(n) for n in model["concepts"]]})
        self.state.phase = Phase.BASELINE_COMPLETE
        self._save()

    def _full(self, short: str) -> str:
        return next(n for n, c in self.concepts.items() if c["name"] == short)

    def _greedy(self, notes: DataFrame) -> None:
        goal, h = self.state.goal, self.state.num_greedy_holdout
        while self.state.completed_epochs < self.state.num_epochs:
            self.state.phase, self.state.working_epoch = Phase.GREEDY_RUNNING, self.state.completed_epochs
            for slot in range(self.state.next_slot, goal, h):
                self._slot(notes, h)
                self.state.next_slot = slot + h
                self._save()
            self.state.completed_epochs += 1
            self.state.next_slot = 0
        self.state.phase = Phase.COMPLETE
        self._save()

    def _current(self, seed: int) -> list[str]:
        """The last iteration's concepts, without controls."""
        return [n for n in self.history.last_concepts(seed) if n not in self.controls][: self.state.goal]

    def _slot(self, notes: DataFrame, h: int) -> None:
        t, m, c = self.config.training, self.config.model, self.config.concept
        current = {s: self._current(s) for s in self.state.seeds}
        kept = {s: v[:-h] for s, v in current.items()}
        words = self._residuals(notes, {s: [*self.controls, *kept[s]] for s in self.state.seeds}, residual.FACTOR_GREEDY, c.num_top_residual_words, t.is_greedy_metric_acc)
        pools = {}
        for s in self.state.seeds:
            proposed = self._register(self.proposer.propose(words[s], current[s], c.max_meta_concepts))
            tabular = [n for n in self.tabular if n not in kept[s] and n not in self.controls]
            pools[s] = list(dict.fromkeys([*current[s][-h:], *proposed, *tabular]))
        self._ready(notes, [*self.controls, *(n for v in [*pools.values(), *current.values()] for n in v)])
        names = list(dict.fromkeys([*self.controls, *(n for v in [*kept.values(), *pools.values()] for n in v)]))
        base = Shelf(self.spark, "slot").keep(self._matrix(notes, names), "matrix")  # answers are read once a slot
        rows = None
        for s in self.state.seeds:
            own = base.join(self._parts(s), "obs_id").withColumn("seed", F.lit(s))
            rows = own if rows is None else rows.unionByName(own)
        risk = {self.concepts[n]["name"]: self.concepts[n].get("is_risk_factor") for n in names}
        chosen: dict[int, list[str]] = {s: [] for s in self.state.seeds}
        for _ in range(h):
            fixed = {s: self._short([*self.controls, *kept[s], *chosen[s]]) for s in self.state.seeds}
            open_ = {s: self._short([n for n in pools[s] if n not in chosen[s]]) for s in self.state.seeds}
            scored = select.score_candidates(rows, fixed, open_, risk, m.final_model_type, t.is_greedy_metric_acc, t.do_coef_check, t.cv)
            for r in select.pick(scored, ["seed"], tie=len(self.history.iterations)).collect():  # a row per seed
                chosen[r["seed"]].append(self._full(r["candidate"]))
        for s in self.state.seeds:
            new = [*self.controls, *select.rotate(current[s], chosen[s], h)]
            fit = select.final_fit(base.join(self._parts(s), "obs_id"), self._short(new), m.final_learner_type, m.use_acc)
            self.history.append(s, "greedy", fit | {"concepts": new})

    # ---- checkpoints

    def _tables(self) -> dict[str, DataFrame]:
        rows = [(n, c["concept_id"], c["pattern"], list(c.get("words") or []), c.get("is_risk_factor"), c.get("prior")) for n, c in self.concepts.items()]
        concepts = self.spark.createDataFrame(rows, "concept string, concept_id int, pattern string, words array<string>, is_risk_factor boolean, prior double")
        return self.history.tables(self.spark) | {"concepts": concepts}

    def _save(self) -> None:
        self.checkpoints.save(self.state, self.config, self._tables())

    def _restore(self, state: State, config: EnsembleConfig, tables: dict[str, DataFrame]) -> None:
        for message in state.compatible(self.config):
            warnings.warn(message, stacklevel=3)
        state.num_epochs = max(state.num_epochs, self.config.training.epochs)
        self.state, self.history = state, History.load(tables)
        self.concepts = {r["concept"]: r.asDict() | {"name": f"c{r['concept_id']}"} for r in tables["concepts"].orderBy("concept_id").collect()}
        self.scaler = features.Scaler.load(state.scaler) if state.scaler else None

    @classmethod
    def from_checkpoint(cls, spark: SparkSession, folder: str, config: EnsembleConfig | None = None, **parts) -> "Trainer":
        """A given config wins over the saved one."""
        found = Checkpoints(spark, folder).load()
        if found is None:
            raise FileNotFoundError(f"no checkpoint in {folder}")
        trainer = cls(spark, config or found[1], folder, **parts)
        trainer._restore(*found)
        return trainer

    # ---- prediction

    def _models(self, last: int | None, baseline: bool, excluded: list[str] | None) -> tuple[DataFrame, DataFrame]:
        t = self.history.tables(self.spark)
        coefs = ensemble.exclude(t["history_coef"], excluded) if excluded else t["history_coef"]
        ids = self.spark.createDataFrame([(n, c["concept_id"]) for n, c in self.concepts.items()], "concept string, concept_id int")
        return ensemble.window(t["history_iter"], last, baseline), ensemble.window(coefs, last, baseline).join(F.broadcast(ids), "concept")

    def annotations(self, notes: DataFrame, use_posterior_iters: int | None = None, is_baseline: bool = False) -> DataFrame:
        """(obs_id, concept_id, answer) of the models' concepts. Notes whose text was
        answered before are looked up; only the other pairs are asked about."""
        _, coefs = self._models(use_posterior_iters, is_baseline, None)
        wanted = [self.concepts[n] for n in sorted({r[0] for r in coefs.select("concept").distinct().collect()})]
        read = [c for c in wanted if c["concept"].startswith(features.TABULAR)]
        missing = sorted({c["concept"].removeprefix(features.TABULAR) for c in read} - set(notes.columns))
        if missing:
            raise ValueError(f"missing columns: {missing}")
        said = [c for c in wanted if c not in read]
        if not self.state.answers or not self.state.seen or not said:
            return self._answered(notes, wanted)
        ids = [c["concept_id"] for c in said]
        seen = self.spark.read.schema("obs_id long, text_key long").parquet(*self.state.seen).distinct()
        known = notes.join(self._keyed(notes).join(seen, ["obs_id", "text_key"], "left_semi").select("obs_id").distinct(), "obs_id", "left_semi")
        found = known.select("obs_id").distinct().join(self.cache.filter(F.col("concept_id").isin(ids)), "obs_id").select("obs_id", "concept_id", "answer")
        counted = found.groupBy("obs_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(said)).select("obs_id")
        out = found.join(counted, "obs_id", "left_semi").unionByName(self._answered(notes.join(counted, "obs_id", "left_anti"), said))
        return out.unionByName(self._answered(notes, read)) if read else out

    def _scores(self, notes, last, baseline, excluded):
        iters, coefs = self._models(last, baseline, excluded)
        return ensemble.scores(self.annotations(notes, last, baseline), iters, coefs)

    def predict(self, notes: DataFrame, use_posterior_iters: int | None = None, is_baseline: bool = False, excluded: list[str] | None = None) -> DataFrame:
        return ensemble.mean(self._scores(notes, use_posterior_iters, is_baseline, excluded)).select("obs_id", "prob_0", "prob_1")

    def predict_all(self, notes: DataFrame, use_posterior_iters: int | None = None) -> DataFrame:
        return ensemble.seed_mean(self._scores(notes, use_posterior_iters, False, None)).select("seed", "obs_id", "prob_0", "prob_1")
