"""Vector codes, chat formatting and fill-in-middle against brute force, with their defined cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.llm import chat, infill, queries, vector_codes

# ---- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label) that count. -> codes, errors, codebooks, by all distances."""
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    size = len(ints[0]) // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))[:entries]
    books = [[ints[i][p * size : (p + 1) * size] for i in order] for p in range(parts)]
    near = lambda p, part: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [[[] for _ in book] for book in books]
        for v in ints:
            for p in range(parts):
                part = v[p * size : (p + 1) * size]
                got[p][near(p, part)[1]].append(part)
        books = [[[sum(c) // len(own) for c in zip(*own)] if own else e for e, own in zip(book, g)] for book, g in zip(books, got)]
    codes, errors = [], []
    for v in ints:
        best = [near(p, v[p * size : (p + 1) * size]) for p in range(parts)]
        codes.append("".join(f"{k:02x}" for _, k in best))
        errors.append(sum(d for d, _ in best))
    return codes, errors, books


def vectors(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in ("v", "x", "code", "error", "part", "entry", "n", "_label", "label_error") if clash else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_codes_equal_brute_force(spark):
    rng = random.Random(5)
    grid = [-0.5, -0.25, 0.0, 0.25]  # few values: many ties, repeated rows and repeated entries
    rows = [(i * 3 % 401, [rng.choice(grid) if i % 2 else rng.gauss(0, 0.2) for _ in range(24)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += rows[:5] + [(None, [0.125] * 24, None)]
    odd = [(1, None, 1), (2, [0.1] * 23 + [None], 1), (3, [math.nan] + [0.0] * 23, 1), (4, [math.inf] * 24, 2), (5, [0.5] * 23, 1), (6, [0.5] * 16, 1)]
    codes, errors, books = brute_codes(rows)
    found, got = vector_codes.compress(spark, vectors(spark, rows + odd))
    assert [b.tolist() for b in got.entries] == books
    assert got.digest() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = {x: sum(e for e, r in zip(errors, rows) if r[2] == x) for x in (None, 1, 2)}
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    want = sorted(((r[0], c, e, by_label[r[2]]) for r, c, e in zip(rows, codes, errors)), key=key)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found.collect()), key=key) == want


def test_tree_visits_equal_bounds(spark):
    """Equal distances on both sides of a split: the lower index wins whichever side it is on."""
    rng = np.random.default_rng(3)
    for leaf in (1, 2, 5):
        for _ in range(30):
            entries = rng.integers(-2, 3, (int(rng.integers(1, 17)), 3))
            rows = rng.integers(-4, 5, (200, 3))
            index, far = vector_codes.Tree.build(entries, leaf).nearest(rows)
            every = ((rows[:, None] - entries[None]) ** 2).sum(2)
            assert (index == every.argmin(1)).all() and (far == every.min(1)).all()


def test_tree_prunes(spark):
    """Far entries are not looked at: the bound does work."""
    entries = np.array([[i * 1000] for i in range(16)])
    tree, seen = vector_codes.Tree.build(entries, 1), []
    visit = vector_codes.Tree._visit

    class Counted(vector_codes.Tree):
        def _visit(self, node, who, *rest):
            if len(who) and self.leaf[node] is not None:
                seen.append(len(who))
            visit(self, node, who, *rest)

    Counted(*(getattr(tree, f) for f in ("entries", "low", "high", "leaf", "children"))).nearest(entries + 1)
    assert sum(seen) == 16


def test_codes_of_few_and_no_vectors(spark):
    found, books = vector_codes.compress(spark, vectors(spark, []))
    assert found.collect() == [] and books.digest() == hashlib.sha256(b"").hexdigest()
    few = [(7, [0.5] * 8, None), (3, [-0.5] * 8, None)]
    found, books = vector_codes.compress(spark, vectors(spark, few))
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in found.collect()} == {(3, "00" * 8, 0, 0), (7, "01" * 8, 0, 0)}
    assert [b.tolist() for b in books.entries] == [[[-2048], [2048]]] * 8
    wide = [(1, [40_000.0] * 8, 1), (2, [-40_000.0] * 8, 1)] + [(3 + i, [float(i)] * 8, 1) for i in range(15)]  # 17 vectors, one without an entry of its own
    found, _ = vector_codes.compress(spark, vectors(spark, wide))
    codes, errors, _ = brute_codes(wide)
    assert sorted((r.vec_id, r.code, r.error) for r in found.collect()) == [(i + 1, c, e) for i, (c, e) in enumerate(zip(codes, errors))]
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark, vectors(spark, [(1, [1e9] * 8, 1)]))[0].collect()


def test_means_round_down(spark):
    books = vector_codes.Codebooks([np.array([[0, 0], [5, 5]])])
    assert books.moved({(0, 0): ([-7, 7], 2)}).entries[0].tolist() == [[-4, 3], [5, 5]]


# ---- chats

MARKS = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "<", ">", "s", "/", "[", "]", "INST", "é", "😀", "\n", "$1", "a "]


def chats(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("formatted", "pieces", "turns", "said", "loss", "done", "marks") if clash else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


def brute_chat(turns):
    esc = lambda s: re.sub(r"(<)(?=/?s>)|(\[)(?=/?INST\])", lambda m: m[0] + "\\", s.replace("\\", "\\\\"))
    out, before = "", None
    for role, text in turns:
        out += ("" if role == before else f"[INST]{esc(role)}[/INST]") + f"<s>{esc(text)}</s>"
        before = role
    return out


def test_chats_round_trip(spark):
    rng = random.Random(9)
    text = lambda: "".join(rng.choice(MARKS) for _ in range(rng.randrange(12)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", text()]), text()) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "user" if t % 7 else "assistant", text()) for t in range(3 * chat.BLOCK + 5)]  # several blocks, runs across their ends
    rows += [(101, t, "assistant", f"{t} ") for t in range(2 * chat.BLOCK)]
    rng.shuffle(rows)
    made = chat.format_chats(chats(spark, rows))
    got = {r.conv_id: r for r in made.select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2], r[3]) for r in sorted(r for r in rows if r[0] == c)]
        assert got[c].formatted == brute_chat(own) == "".join(p.text for p in got[c].pieces)
        assert [(t.role, t.text) for t in got[c].turns] == own
        assert got[c].loss == "".join(x for role, x in own if role == "assistant")
    assert got[101].formatted.count("[INST]") == 1  # one run, one header


def test_chats_defined_cases(spark):
    rows = [(1, 0, "user", None), (1, None, None, "first"), (None, 0, "assistant", "x"), (2, 1, "b", "z"), (2, 1, "a", "y"), (2, 1, "a", "y"), (3, 0, "assistant", "w" * 500_000)]
    made = chat.format_chats(chats(spark, rows))
    got = {r.conv_id: (r.formatted, [tuple(t) for t in r.turns]) for r in made.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns")).collect()}
    assert got[1][1] == [("", "first"), ("user", "")] and got[1][0] == "[INST][/INST]<s>first</s>[INST]user[/INST]<s></s>"
    assert got[2][1] == [("a", "y"), ("a", "y"), ("b", "z")]
    assert got[None][1] == [("assistant", "x")] and got[3][1] == [("assistant", "w" * 500_000)]
    assert chat.format_chats(chats(spark, [])).collect() == []
    for bad in (("<s>", "<s><", "ab", "bc"), ("<s>", "<s>", "[a]", "[b]"), ("<s>", "[a]", "<\\>", "{b}"), ("<", "[a]", "<s>", "{b}")):
        with pytest.raises(ValueError):
            chat.Template(*bad)


def test_other_template(spark):
    other = chat.Template("{h}", "{b}", "|t", "|e")
    made = chat.format_chats(chats(spark, [(1, 0, "u{h}", "|t\\|e{b}"), (1, 1, "u{h}", "")]), other, ("u{h}",))
    row = made.select("formatted", chat.turns_of(F.col("formatted"), other).alias("turns"), chat.loss_text(F.col("pieces"), other).alias("loss")).first()
    assert [tuple(t) for t in row.turns] == [("u{h}", "|t\\|e{b}"), ("u{h}", "")] and row.loss == "|t\\|e{b}"
    assert row.formatted.count("{h}") == 1


def test_chat_plan_has_no_python(spark, sf_dir):
    plan = queries.op12_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- fill in middle

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute_infill(doc_id, text):
    text, units = text or "", UNITS.findall(text or "")
    hexes = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)], len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, m, z = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    spm = h[3] % 100 < 20
    return (doc_id, n, "spm" if spm else "psm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}" if spm else f"<P>{a}<S>{z}<M>{m}")


def test_infill_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    letters = "abYZ@[`{<>PSM é€😀\n\t\\$0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 9, 60, 700]))) for _ in range(600)]
    texts += [None, "", "<P>", "<<S>", "a<M", ">", "<P<S<M>x", "word " * 40_000, "é" * 70_000, "x" * 200_000]
    rows = [(i - 3, t) for i, t in enumerate(texts)] + [(None, "no id here"), (5, texts[8]), (5, texts[8])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n", "form", "output", "draws", "data", "prefix_chars"):
        df = df.withColumn(c, F.lit("clash"))
    made = infill.transform(df)
    got = [tuple(r) for r in made.select("*", infill.restore(F.col("output"), F.col("form")).alias("again")).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted(((*brute_infill(*r), r[1] or "") for r in rows), key=key)
    assert infill.transform(df.limit(0)).collect() == []


def test_scan_in_small_windows_and_blocks(monkeypatch):
    rng = random.Random(8)
    data = "".join(rng.choice("ab<PSM>é😀 ") for _ in range(5000)).encode()
    automaton = infill.Automaton()
    slow, state = [], 0
    for b in data:
        cell = int(automaton.table[state, b])
        slow.append(cell)
        state = cell & 15
    for window in (7, 64, 1000, 1 << 20):
        monkeypatch.setattr(infill, "WINDOW", window)
        cells = automaton.scan(np.frombuffer(data, np.uint8))
        assert cells.tolist() == slow
    monkeypatch.setattr(infill, "BLOCK", 13)
    starts = [i for i, c in enumerate(slow) if c & infill.UNIT]
    assert [infill.locate(cells, k) for k in range(0, len(starts) + 1, 37)] == [*starts, len(data)][:: 37]


def test_other_sentinels(spark):
    """Sentinels that begin with a letter, or with one another's end."""
    automaton = infill.Automaton(("abc", "bcd", "<x>"))
    for text in ("zabcd", "abbcd", "ab c", "<x", "<<x>", "aabc"):
        cells = automaton.scan(np.frombuffer(text.encode(), np.uint8))
        assert bool((cells & infill.FOUND).any()) == any(s in text for s in automaton.sentinels)
        assert int(np.count_nonzero(cells & infill.UNIT)) == len(UNITS.findall(text))
    with pytest.raises(ValueError):
        infill.Automaton(("", "a", "b"))
