"""Concepts proposed by a model: prompts from templates, answers parsed, checked and trimmed."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.responses import repair

DEFAULT_PRIOR = 0.1
Ask = Callable[[list[str]], list[str | None]]


def filled(template: str, values: dict[str, object]) -> str:
    """Literal replacement of {name}, one after another."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value))
    return template


def feature_lines(words: list[tuple[str, float]]) -> str:
    """CSV text of words and coefficients, scaled by the largest size; fields with
    commas or quotes are quoted."""
    top = max((abs(c) for _, c in words), default=0.0) or 1.0
    quoted = lambda w: '"' + w.replace('"', '""') + '"' if re.search(r'[,"\n]', w) else w
    return "".join(["feature_name,coef\n", *(f"{quoted(w)},{c / top:.3f}\n" for w, c in words)])


def starred(names: list[str]) -> str:
    return "".join(f"* X{i} = {n} \n" for i, n in enumerate(names))


def parsed(text: str | None) -> list[dict]:
    """The concepts of an answer: {"concepts": [{concept, words, is_risk_factor, prior}]}, or the bare list."""
    whole = repair(text)
    if whole is None:
        return []
    got = json.loads(whole)
    rows = got.get("concepts", []) if isinstance(got, dict) else got
    return [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []


def usable(row: dict, default_prior: float = DEFAULT_PRIOR) -> dict | None:
    """A concept with a name and at least one word; its pattern is any of its words."""
    name = str(row.get("concept") or "").strip()
    words = [w.strip() for w in row.get("words") or [] if isinstance(w, str) and w.strip()] if isinstance(row.get("words"), list) else []
    if not name or not words:
        return None
    prior = row.get("prior")
    good = isinstance(prior, (int, float)) and not isinstance(prior, bool) and 0 < prior <= 1
    risk = row.get("is_risk_factor")
    return {"concept": name, "words": words, "pattern": "|".join(re.escape(w.lower()) for w in words), "is_risk_factor": risk if isinstance(risk, bool) else None, "prior": float(prior) if good else default_prior}


@dataclass
class ModelProposer:
    """Asks for first concepts with `first` and for replacements with `next_`; an answer that
    gives none is asked for again, `tries` times in all. Known names are not proposed again.
    `rejected` keeps what was left out and why."""

    ask: Ask
    first: str
    next_: str
    goal: int = 10
    replaced: int = 1
    settings: dict[str, str] = field(default_factory=dict)
    default_prior: float = DEFAULT_PRIOR
    tries: int = 2
    rejected: list[tuple[str, str]] = field(default_factory=list)

    def prompt(self, words: list[tuple[str, float]], kept: list[str], n: int) -> str:
        values = {"top_features_df": feature_lines(words), "max_meta_concepts": n, "num_concepts": self.goal, "num_concepts_fixed": self.goal - self.replaced, "num_attributes": len(words), "meta_concepts": starred(kept)}
        return filled(self.next_ if kept else self.first, values | self.settings)

    def propose(self, words: list[tuple[str, float]], kept: list[str], n: int) -> list[dict]:
        text = self.prompt(words, kept, n)
        for _ in range(self.tries):
            out: dict[str, dict] = {}
            for row in parsed(self.ask([text])[0]):
                made = usable(row, self.default_prior)
                reason = "no name or words" if made is None else "known" if made["concept"] in kept else "repeated" if made["concept"] in out else None
                if reason:
                    self.rejected.append((str(row.get("concept")), reason))
                else:
                    out[made["concept"]] = made
            if out:
                return list(out.values())[:n]
        return []


@dataclass
class ModelPriors:
    """Priors of candidates by a model: {candidate_list} is numbered, the answer is
    {"candidates": [{"candidate": number, "prior": p}]}; of several for one the last counts."""

    ask: Ask
    template: str

    def priors(self, names: list[str], kept: list[str]) -> dict[str, float]:
        listed = "".join(f"{i + 1} - {n}\n" for i, n in enumerate(names))
        whole = repair(self.ask([filled(self.template, {"candidate_list": listed, "meta_concepts": starred(kept)})])[0])
        got = json.loads(whole) if whole else {}
        out = {}
        for row in got.get("candidates", []) if isinstance(got, dict) else []:
            if isinstance(row, dict) and str(row.get("candidate", "")).strip().isdigit() and isinstance(row.get("prior"), (int, float)):
                i = int(row["candidate"]) - 1
                if 0 <= i < len(names) and 0 < row["prior"] <= 1:
                    out[names[i]] = float(row["prior"])
        return out
