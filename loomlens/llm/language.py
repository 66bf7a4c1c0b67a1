"""Hierarchical language identification: the family first, by one linear support
vector machine per family against the rest, then one-versus-one machines between
the languages of the chosen family, which vote.

Features: hashed runs of one to three bytes of the whole lower-cased text (ASCII
characters that are not letters count as spaces), square roots of their counts
brought to unit length. Machines are fitted
on at most about 2 x SAMPLE documents of each of the MOST_LANGUAGES most frequent
languages (MOST_ROWS in all), drawn by a hash of doc_id from the rows that are not held out; prediction reads the text alone.

Defined cases: null texts and texts without a letter are `und` with score 0; rows
without a language teach nothing; without any teaching row all is `und`; with one
language all is that language; ties go to the language first by name; a null
doc_id is never held out; repeated rows are each predicted; an empty table gives an
empty result; other columns are not read.

Plan: one small aggregate (rows by language), one pass for the sample (8 KB a
document to the driver, bounded by SAMPLE and MOST_ROWS), one narrow pass to predict; no exchange
of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, dual_descent, logistic_scale, resident, slices

SAMPLE = 1000  # documents of each language to learn from, on average
MOST_LANGUAGES = 100  # the most frequent ones are learned; a dirty column may hold any number of values
MOST_ROWS = 20_000  # documents to learn from in all, on average: with over 20 languages each has fewer
FEATURES = 2048
SIZES = (1, 2, 3)
UNKNOWN = "und"

#: Languages and their families.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
}
_FAMILY = {x: k for k, v in FAMILIES.items() for x in v.split()}
_CLEAN = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


def features(texts: list[str | None]) -> np.ndarray:
    """A row of unit length for each text, and a last column of ones."""
    raw = [(" " + (t or "").lower() + " ").encode() for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = _CLEAN[np.frombuffer(b"".join(raw) + b"  ", np.uint8)].astype(np.uint32)
    n = int(sizes.sum())
    row = np.repeat(np.arange(len(raw)), sizes) * FEATURES
    out = np.zeros((len(raw), FEATURES))
    for size in SIZES:
        h = np.full(n, size * 7919, np.uint32)
        for i in range(size):
            h = (h ^ data[i : i + n]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA77)) >> np.uint32(21)
        out += np.bincount(row + h, minlength=out.size).reshape(out.shape)
    out = np.sqrt(out).astype(np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return np.hstack([out / np.maximum(norm, 1e-9)[:, None], np.ones((len(raw), 1), np.float32)])


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Model:
    """Weights as columns, with the scale of each to a probability."""

    def __init__(self, x: np.ndarray, langs: list[str], c: float = 10.0):
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        y, fam = np.array(langs), np.array([family(v) for v in langs])
        self.tasks: list[tuple] = []
        weights, scales = [], []
        for f in self.families if len(self.families) > 1 else []:
            self.tasks.append((f,))
            self._fit(x, np.arange(len(y)), fam == f, c, weights, scales)
        for f in self.families:
            for a, b in combinations([v for v in self.langs if family(v) == f], 2):
                self.tasks.append((a, b))
                rows = np.flatnonzero((y == a) | (y == b))
                self._fit(x, rows, y[rows] == a, c, weights, scales)
        self.weights = np.array(weights, np.float32).T if weights else np.zeros((FEATURES + 1, 0), np.float32)
        self.scales = np.array(scales).reshape(-1, 2)

    @staticmethod
    def _fit(x, rows, first, c, weights, scales):
        """One machine: `first` against the others of `rows`, classes weighing the same."""
        y = np.where(first, 1.0, -1.0)
        share = np.where(first, len(y) / 2 / max(1, first.sum()), len(y) / 2 / max(1, (~first).sum()))
        w = dual_descent(x, y, c, 30, share, rows=rows)
        weights.append(w)
        scales.append(logistic_scale((x @ w.astype(np.float32))[rows].astype(float), y))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        p = 1 / (1 + np.exp(-np.clip((x @ self.weights) * self.scales[:, 0] + self.scales[:, 1], -35, 35)))
        at = {t: i for i, t in enumerate(self.tasks)}
        by_family = np.stack([p[:, at[(f,)]] for f in self.families], 1) if len(self.families) > 1 else np.ones((len(x), 1))
        by_family = by_family / np.maximum(by_family.sum(1, keepdims=True), 1e-12)
        chosen = by_family.argmax(1)
        langs, score = np.array([""] * len(x), object), np.zeros(len(x))
        for k, f in enumerate(self.families):
            own, rows = [v for v in self.langs if family(v) == f], chosen == k
            votes, chance = np.zeros((len(x), len(own))), np.zeros((len(x), len(own)))
            for i, j in combinations(range(len(own)), 2):
                q = p[:, at[(own[i], own[j])]]
                votes[:, i] += q >= 0.5
                votes[:, j] += q < 0.5
                chance[:, i] += q
                chance[:, j] += 1 - q
            best = (votes + chance / max(1, len(own))).argmax(1) if len(own) > 1 else np.zeros(len(x), int)
            inner = chance[np.arange(len(x)), best] / (len(own) - 1) if len(own) > 1 else np.ones(len(x))
            langs[rows] = np.array(own, object)[best[rows]]
            score[rows] = (by_family[:, k] * inner)[rows]
        return langs.tolist(), np.clip(score, 0, 1)


def held_out() -> Column:
    return F.coalesce(crc_bucket(3) == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES)
    rows = {r["lang"]: r["n"] for r in counts.collect()}  # a row for each language
    if not rows:
        return Model(np.zeros((0, FEATURES + 1)), [])
    sample = max(1, min(sample, MOST_ROWS // len(rows)))
    ticket = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000))
    limits = F.create_map(*(F.lit(x) for lang, n in sorted(rows.items()) for x in (lang, int(min(1.0, sample / n) * 1_000_000 + 1))))
    wanted = ticket < F.coalesce(F.try_element_at(limits, F.col("lang")), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                texts = part.column(1).to_pylist()
                x = features(texts)
                ok = [i for i, t in enumerate(texts) if has_letter(t)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ok, pa.int64())), pa.array([x[i, :-1].tobytes() for i in ok], pa.binary())], names=["lang", "x"])

    got = known.filter(wanted).select("lang", "text").mapInArrow(run, "lang string, x binary").limit(2 * sample * len(rows)).toArrow()
    x = np.ones((got.num_rows, FEATURES + 1), np.float32)
    i = 0
    for chunk in got.column("x").chunks:
        for b in chunk:
            x[i, :-1] = np.frombuffer(b.as_buffer(), np.float32)
            i += 1
    return Model(x, got.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score, after the columns `extra`."""
    extra = [c for c in (extra or []) if c not in ("doc_id", "text", "held_out", "lang_pred", "score")]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    keep_text = bool(extra)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "text" or keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(("none",), lambda: None)  # frees what another operator left in this worker
        for batch in batches:
            for part in slices(batch, 64):
                texts = part.column(1).to_pylist()
                langs, scores = model.predict(features(texts))
                known = [has_letter(t) for t in texts]
                own = [part.column(i) for i in range(part.num_columns) if i != 1 or keep_text]
                langs = pa.array([v if k else UNKNOWN for v, k in zip(langs, known, strict=True)], pa.string())
                names = [n for i, n in enumerate(part.schema.names) if i != 1 or keep_text]
                yield pa.RecordBatch.from_arrays([*own, langs, pa.array(np.where(known, scores, 0.0))], names=[*names, "lang_pred", "score"])

    return base.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"])).withColumn("held_out", held_out())
