"""Bayesian concept search: chains of Metropolis-Hastings steps, one for each seed.

A step holds the last concept of a chain out, proposes candidates for its place, weighs
candidates and the held-out concept by Laplace marginals (all chains in one grouped job),
draws one by its weight, and accepts it by the ratio of forward and backward sums. The
first `num_greedy_epochs` epochs choose by fit instead. Every slot ends in a checkpoint;
draws depend on (seed, number of steps made), so a resumed run goes on as if it had not stopped.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bayes, residual, select
from ..shared import Shelf
from .trainer import Trainer

DEFAULT_PRIOR = 0.1
MOVES = "seed int, step int, held_out string, drawn string, chance double, accepted boolean"


class Priors(Protocol):
    """Prior of each name given the concepts that stay; names are candidates and the held-out concept."""

    def priors(self, names: list[str], kept: list[str]) -> dict[str, float]: ...


class FlatPriors:
    def priors(self, names: list[str], kept: list[str]) -> dict[str, float]:
        return {}


class Chains(Trainer):
    """`resplit` draws the train rows anew in each step; without it marginals of a
    (kept, candidate) that were met before are remembered."""

    def __init__(self, *args, priors: Priors | None = None, resplit: bool = True, **parts):
        super().__init__(*args, **parts)
        self.priors, self.resplit = priors or FlatPriors(), resplit
        self.moves: list[tuple] = []
        self._known: dict[tuple, float] = {}

    def _prior(self, names: list[str], kept: list[str]) -> dict[str, float]:
        given = self.priors.priors(names, kept)
        return {n: given.get(n) or self.concepts[n].get("prior") or DEFAULT_PRIOR for n in names}

    def _marginals(self, notes: DataFrame, asked: dict[int, tuple[list[str], list[str]]], step: int) -> dict[tuple[int, str], float]:
        """(seed, name) -> log weight; asked: seed -> (kept, names)."""
        key = lambda s, kept, n: (s, frozenset(kept), n)
        open_ = {s: [n for n in names if self.resplit or key(s, kept, n) not in self._known] for s, (kept, names) in asked.items()}
        kept = {s: [*self.controls, *k] for s, (k, _) in asked.items()}
        if any(open_.values()):
            rows, every = None, list(dict.fromkeys(n for s, names in open_.items() if names for n in (*kept[s], *names)))
            base = Shelf(self.spark, "chain-step").keep(self._matrix(notes, every), "matrix")
            for s, names in open_.items():
                if names:
                    parts = self._parts(s)
                    if self.resplit:
                        from ..operators import split

                        parts = split.stratified(notes.select("obs_id", "y"), "obs_id", "y", self.config.training.train_frac, f"{s}/{step}").select("obs_id", "part")
                    own = base.join(parts.select("obs_id", "part"), "obs_id").withColumn("seed", F.lit(s))
                    rows = own if rows is None else rows.unionByName(own)
            short = {s: self._short(v) for s, v in open_.items() if v}
            found = bayes.log_weights(rows, {s: self._short(kept[s]) for s in short}, short)
            for s, names in open_.items():
                for n in names:
                    self._known[key(s, asked[s][0], n)] = found[s, self.concepts[n]["name"]]
        return {(s, n): self._known[key(s, k, n)] for s, (k, names) in asked.items() for n in names}

    def _slot(self, notes: DataFrame, h: int) -> None:
        greedy = self.state.working_epoch < self.config.training.num_greedy_epochs
        t, m, c = self.config.training, self.config.model, self.config.concept
        h = h if greedy else 1
        current = {s: self._current(s) for s in self.state.seeds}
        kept = {s: v[:-h] for s, v in current.items()}
        words = self._residuals(notes, {s: [*self.controls, *kept[s]] for s in self.state.seeds}, residual.FACTOR_GREEDY, c.num_top_residual_words, t.is_greedy_metric_acc)
        pools = {}
        for s in self.state.seeds:
            proposed = self._register(self.proposer.propose(words[s], current[s], c.max_meta_concepts))
            tabular = [n for n in self.tabular if n not in current[s] and n not in self.controls]
            pools[s] = [n for n in dict.fromkeys([*proposed, *tabular]) if n not in current[s]]
        self._ready(notes, [*self.controls, *(n for v in [*pools.values(), *current.values()] for n in v)])
        chosen = self._chosen_greedily(notes, current, kept, pools, h) if greedy else self._sampled(notes, current, kept, pools)
        for s in self.state.seeds:
            new = [*self.controls, *select.rotate(current[s], chosen[s], h)]
            fit = select.final_fit(self._matrix(notes, new).join(self._parts(s), "obs_id"), self._short(new), m.final_learner_type, m.use_acc)
            self.history.append(s, "greedy" if greedy else "sampled", fit | {"concepts": new})

    def _sampled(self, notes: DataFrame, current, kept, pools) -> dict[int, list[str]]:
        step = len(self.history.iterations) // len(self.state.seeds)
        logs = self._marginals(notes, {s: (kept[s], [current[s][-1], *pools[s]]) for s in self.state.seeds if pools[s]}, step)
        chosen = {}
        for s in self.state.seeds:
            old = current[s][-1]
            if not pools[s]:
                chosen[s] = [old]
                continue
            prior = self._prior([old, *pools[s]], kept[s])
            rng = np.random.default_rng([abs(int(s)), step])
            name, chance, drawn = bayes.mh_move(pools[s], prior, old, lambda n: logs[s, n] + float(np.log(prior[n])), rng)  # noqa: B023
            self.moves.append((s, step, old, drawn, chance, name != old))
            chosen[s] = [name]
        return chosen

    def _chosen_greedily(self, notes: DataFrame, current, kept, pools, h: int) -> dict[int, list[str]]:
        """Up to two slots: one after another by the area on all rows; beyond, the largest
        coefficients of one fit with all candidates."""
        t, m = self.config.training, self.config.model
        pools = {s: [*current[s][-h:], *pools[s]] for s in self.state.seeds}
        names = list(dict.fromkeys([*self.controls, *(n for v in [*kept.values(), *pools.values()] for n in v)]))
        base = Shelf(self.spark, "chain-slot").keep(self._matrix(notes, names), "matrix")
        chosen: dict[int, list[str]] = {s: [] for s in self.state.seeds}
        if h > 2:
            for s in self.state.seeds:
                columns = self._short([*self.controls, *kept[s], *pools[s]])
                coefs = select.final_fit(base.join(self._parts(s), "obs_id"), columns, m.residual_model_type, t.is_greedy_metric_acc)["coefs"][-len(pools[s]) :]
                chosen[s] = bayes.greedy_slot({}, dict(zip(pools[s], coefs, strict=True)), h)
            return chosen
        rows = None
        for s in self.state.seeds:
            own = base.join(self._parts(s), "obs_id").withColumn("seed", F.lit(s))
            own = own.withColumn("part", F.explode(F.array(F.lit("train"), F.lit("test"))))  # fitted and scored on all rows
            rows = own if rows is None else rows.unionByName(own)
        for _ in range(h):
            fixed = {s: self._short([*self.controls, *kept[s], *chosen[s]]) for s in self.state.seeds}
            open_ = {s: self._short([n for n in pools[s] if n not in chosen[s]]) for s in self.state.seeds}
            scored = select.score_candidates(rows, fixed, open_, {}, m.residual_model_type, t.is_greedy_metric_acc)
            for r in select.pick(scored, ["seed"], tie=len(self.history.iterations)).collect():  # a row per seed
                chosen[r["seed"]].append(self._full(r["candidate"]))
        return chosen

    # ---- checkpoints: the moves, too

    def _tables(self) -> dict[str, DataFrame]:
        return super()._tables() | {"moves": self.spark.createDataFrame(self.moves, MOVES)}

    def _restore(self, state, config, tables) -> None:
        super()._restore(state, config, tables)
        self.moves = [tuple(r) for r in tables["moves"].orderBy("step", "seed").collect()] if "moves" in tables else []
