"""Fill-in-middle transformation by a table-driven byte automaton.

A text is a row of units, `[A-Za-z]+|[^A-Za-z]` over code points. Two cuts between
units part it into prefix, middle and suffix, which are written behind sentinels
(psm: prefix, suffix, middle; spm: suffix, prefix, middle), so that a model learns
to fill the middle. Texts that hold a sentinel stay plain, hence every output can be
taken back (`restore`).

One table (`Automaton`) holds for each state and byte the next state and what the
transition counts: a unit that begins, a code point that begins (continuation bytes
begin neither), a sentinel that ends. The first pass runs it once over the bytes, in
lanes: a state depends on the last few bytes only (`memory`, found from the table),
so lanes that start that many bytes early are in the right state and step together
in NumPy. Counts of a document are sums over its transitions. The second pass looks up
the bytes at which the chosen units begin, by counts of blocks and then in one block.

Defined cases: a null or empty text is plain with n = 0; a null id is hashed as an empty
number; repeated rows are transformed each; an empty table gives an empty result;
a very long text is scanned in windows of fixed size; other columns are not read.

Plan: one narrow pass, no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Prefix, suffix and middle sentinels.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90  # of 100: this and higher draws leave a text plain
SPM_BELOW = 20  # of 100: lower draws put the suffix first

UNIT, POINT, FOUND = 16, 32, 64  # what a transition counts; the bits below are the next state
_STATE = UNIT - 1
_RESET = 255  # no byte of UTF-8: ends a document in the scan
WINDOW = 1 << 22
LANE = 512
BLOCK = 1 << 16

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _letter(b: int) -> bool:
    return 65 <= b <= 90 or 97 <= b <= 122


@dataclass(frozen=True)
class Automaton:
    """States: the root after a letter, the root after anything else (the start), and
    each proper beginning of a sentinel that the scan may be in."""

    sentinels: tuple[str, ...] = SENTINELS
    table: np.ndarray = field(init=False, repr=False, compare=False)
    memory: int = field(init=False, compare=False)

    def __post_init__(self):
        words = [s.encode() for s in self.sentinels]
        if not all(words):
            raise ValueError("a sentinel is empty")
        begun = sorted({w[:i] for w in words for i in range(1, len(w))})
        states = [(b"", False), (b"", True), *((p, _letter(p[-1])) for p in begun)]  # what was read of a sentinel, after a letter?
        if len(states) > _STATE + 1:
            raise ValueError("too many sentinels")
        number = {p: i + 2 for i, p in enumerate(begun)}
        table = np.zeros((len(states), 256), np.uint8)
        for i, (path, after_letter) in enumerate(states):
            for b in range(256):
                read = path + bytes([b])
                ends = any(read.endswith(w) for w in words)
                tails = (read[k:] for k in range(len(read)))
                to = next((number[t] for t in tails if t in number), int(_letter(b)))
                inside = 128 <= b < 192  # a continuation byte begins nothing
                unit = not inside and not (_letter(b) and after_letter)
                table[i, b] = to | UNIT * unit | POINT * (not inside) | FOUND * ends
        table[:, _RESET] = 0
        object.__setattr__(self, "table", table)
        object.__setattr__(self, "memory", self._memory(table))

    @staticmethod
    def _memory(table: np.ndarray) -> int:
        """How many bytes fix the state, whatever it was before."""
        groups = {tuple(range(len(table)))}
        for k in range(len(table) + 1):
            if all(len(g) == 1 for g in groups):
                return k
            groups = {tuple(sorted({int(table[s, b]) & _STATE for s in g})) for g in groups for b in range(256)}
        raise ValueError("the automaton does not forget where it began")

    def scan(self, data: np.ndarray) -> np.ndarray:
        """The cell of every byte's transition, for bytes that begin a document."""
        out = np.empty(len(data), np.uint8)
        flat, k = self.table.reshape(-1), self.memory
        for begin in range(0, len(data), WINDOW):
            end = min(len(data), begin + WINDOW)
            size = end - begin
            steps = min(LANE, max(64, size // 64))
            lanes = -(-size // steps)
            padded = np.full(k + lanes * steps, _RESET, np.uint8)
            early = min(k, begin)
            padded[k - early : k + size] = data[begin - early : end]
            state = np.zeros(lanes, np.intp)
            starts = np.arange(lanes) * steps
            for j in range(k):
                state = flat[(state & _STATE) << 8 | padded[starts + j]].astype(np.intp)
            rows = np.ascontiguousarray(padded[k:].reshape(lanes, steps).T)
            cells = np.empty((steps, lanes), np.uint8)
            for j in range(steps):
                cells[j] = flat[(state & _STATE) << 8 | rows[j]]
                state = cells[j].astype(np.intp)
            out[begin:end] = cells.T.reshape(-1)[:size]
        return out


def locate(cells: np.ndarray, unit: int) -> int:
    """The byte at which the given unit (from 0) begins; the end if there is none."""
    for at in range(0, len(cells), BLOCK):
        begins = cells[at : at + BLOCK] & UNIT
        here = int(np.count_nonzero(begins))
        if unit < here:
            return at + int(np.flatnonzero(begins)[unit])
        unit -= here
    return len(cells)


def _count(cells: np.ndarray, bit: int) -> int:
    return sum(int(np.count_nonzero(cells[at : at + BLOCK] & bit)) for at in range(0, len(cells), BLOCK))


def rewrite(texts: list[bytes], draws: np.ndarray, automaton: Automaton, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text; draws: four unsigned
    numbers a row."""
    joined = np.frombuffer(bytes([_RESET]).join([*texts, b""]), np.uint8)
    cells = automaton.scan(joined)
    marks = [s.encode() for s in automaton.sentinels]
    out, at = [], 0
    for text, (h1, h2, h3, h4) in zip(texts, draws.tolist(), strict=True):
        own = cells[at : at + len(text)]
        at += len(text) + 1
        n = _count(own, UNIT)
        if not text or h3 % 100 >= plain_from or _count(own, FOUND):
            out.append((n, "plain", None, None, text))
            continue
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        first = locate(own, low)
        second = first + locate(own[first:], high - low)
        prefix, middle, suffix = text[:first], text[first:second], text[second:]
        spm = h4 % 100 < spm_below
        parts = (marks[1], suffix, marks[0], prefix, marks[2], middle) if spm else (marks[0], prefix, marks[1], suffix, marks[2], middle)
        out.append((n, "spm" if spm else "psm", _count(own[:first], POINT), _count(own[first:second], POINT), b"".join(parts)))
    return out


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, sentinels: tuple[str, ...] = SENTINELS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """SCHEMA's columns. The draws are the leading numbers of sha256("<seed>:<id>")."""
    automaton = Automaton(tuple(sentinels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                draws = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u4").reshape(-1, 8)[:, :4]
                made = rewrite(part.column(2).to_pylist(), draws, automaton, plain_from, spm_below)
                n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
                longs = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
                yield pa.RecordBatch.from_arrays([part.column(0), longs[0], pa.array(form, pa.string()), longs[1], longs[2], pa.array(output, pa.binary()).view(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    hashed = F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256))
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(key).cast("long").alias("doc_id"), hashed.alias("draws"), data.alias("data")).mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text of an output, by its form alone: sentinels stand in it only where the
    transformation wrote them."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels))
    piece = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)
