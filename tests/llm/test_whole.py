"""Whole results where operators once gave a part."""

import itertools

import pytest

from loomlens.llm import contamination, html_text


@pytest.mark.parametrize("declaration", ["<![foo[x]]>", "<![ endif]>", "<![1]>", "<![]>", "<![if !IE]>", "<![endif]>"])
def test_text_behind_marked_sections(declaration):
    html = f"<article><p>Before it there are words.</p>{declaration}<p>Behind it there are more words.</p></article>"
    assert html_text.extract(html) == "Before it there are words. Behind it there are more words."


@pytest.mark.parametrize("tail", ["<![foo[x", "<![", "<![1", "<![ "])
def test_unclosed_marked_sections(tail):
    assert html_text.extract(f"<article><p>Before it there are words.</p>{tail}").startswith("Before it there are words.")


@pytest.mark.parametrize("limit", [contamination.BROADCAST_TOKENS, 0])
def test_part_of_a_long_item_at_every_placement(spark, limit):
    """13 copied tokens with 2 substitutions: found wherever a seed hits."""
    item = [f"w{i}" for i in range(60)]
    rows, want = [], {}
    for n, odd in enumerate(itertools.combinations(range(13), 2)):
        part = [f"x{i}" if i in odd else w for i, w in enumerate(item[20:33])]
        rows.append((n, " ".join([*(f"a{i}" for i in range(40)), *part, *(f"b{i}" for i in range(40))])))
        want[n] = any(all(at + i not in odd for i, bit in enumerate(m) if bit == "1") for m in contamination.MASKS for at in range(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in contamination.mark(spark, docs, bench, broadcast_tokens=limit).collect()}
    assert all(got[n] for n, seen in want.items() if seen)
    assert got[[*itertools.combinations(range(13), 2)].index((1, 3))]
