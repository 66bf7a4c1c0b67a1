"""Quality rules with host-level verdicts.

Each document gets counts over its whole text and a base verdict. Failures are
then summed by host, a beta prior is fitted to the hosts' rates (moments, weighted
by size), every host's rate is shrunk towards it, and hosts whose shrunk rate is
over a limit fail with all their documents. The limit follows the prior: TAIL of its
standard deviations over its mean, and at least FACTOR times the mean (so that hosts
that differ by little keep their good documents), but never over HIGHEST.

Words are runs without the ASCII white space characters. n_repeat_words counts the
words that lie in a 3-word window found at least twice in the text, each once.

Defined cases: null text has no words and fails the base rules; a null host is a
host of its own; repeated rows count each time; an empty table gives an empty
result; a null id is kept; other columns are not read.

Plan: one narrow pass over the texts, written as a small table of counts; sums by
host are combined map-side (a host with a third of all rows is a few partial rows),
and host verdicts come back by a join without texts, which AQE may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT = 50  # per cent of the words
TAIL = 3.0
FACTOR = 2.0
HIGHEST = 0.9
HEAVIEST = 1e6  # documents that the prior weighs at most: where hosts differ no more than by chance

SCHEMA = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text or "") - sum((text or "").count(c) for c in _SPACES)  # words hold all else
    symbols = sum(map(data.count, _SYMBOLS))
    dup = 0
    if b"\n" in data:
        seen = set()
        for line in data.split(b"\n"):
            if line and not line.isspace():
                if line in seen:
                    dup += 1
                else:
                    seen.add(line)
    repeated = 0
    if n > 3:
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        k = len(numbers)
        keys = [(a * k + b) * k + c for a, b, c in zip(ids, ids[1:], ids[2:], strict=False)]
        if len(set(keys)) < len(keys):
            once: set[int] = set()
            twice: set[int] = set()
            for key in keys:
                (twice if key in once else once).add(key)
            end = 0
            for i, key in enumerate(keys):
                if key in twice:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, dup, repeated


_SYMBOLS = [s.encode() for s in SYMBOLS]
_SPACES = " \t\n\v\f\r"


def counts(docs: DataFrame, host_col: str = "source") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [measure(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([f[i] for f in found], pa.int64()) for i in range(5))], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def host_verdicts(judged: DataFrame) -> DataFrame:
    """(host, n, failed, host_rate, host_ok) from rows with host and base_failed.
    With one host or no spread between hosts beyond chance the prior is the mean rate
    with the weight of HEAVIEST documents."""
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    h, m, f, q = hosts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("failed"), F.sum(F.col("n") * rate * rate)).first()  # one row
    mean = (f / m) if m else 0.0
    # moments of a beta-binomial: the hosts' spread less what sampling alone gives
    between = (q / m - mean * mean - mean * (1 - mean) * h / m) if m else 0.0
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), HEAVIEST) if between > 1e-12 and 0 < mean < 1 else HEAVIEST
    limit = min(HIGHEST, max(FACTOR * mean, mean + TAIL * (mean * (1 - mean) / (weight + 1)) ** 0.5))
    shrunk = (F.col("failed") + mean * weight) / (F.col("n") + weight)
    return hosts.select("host", "n", "failed", shrunk.alias("host_rate"), (shrunk <= limit).alias("host_ok"))


def judge(spark: SparkSession, docs: DataFrame, host_col: str = "source") -> DataFrame:
    scratch = Scratch(spark, "rules")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    judged = scratch.save(counts(docs, host_col).withColumn("base_failed", failed), "counts")
    hosts = scratch.save(host_verdicts(judged).select(F.col("host").alias("_host"), "host_rate", "host_ok"), "hosts")
    both = judged.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True)))
