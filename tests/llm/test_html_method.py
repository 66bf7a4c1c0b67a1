"""The method of the page extraction by plain loops, its defined cases, and hostile pages."""

import math
import random
import time

import numpy as np
import pytest

from loomlens.llm import html_text
from loomlens.llm.html_text import Line


def brute(lines, sigma, factor, prior, gap, links, low):
    """Ratio, smoothing, threshold and clusters without arrays."""
    n, top = len(lines), max(1, max(x.level for x in lines))
    article, prose = [x.level == top for x in lines], [x.linked < links for x in lines]
    ratio = [len(x.text) / max(1, x.tags) for x in lines]
    radius = max(1, int(3 * sigma))

    def smooth(values):
        out = []
        for i in range(n):
            near = [j for j in range(n) if abs(i - j) <= radius]
            weight = [math.exp(-0.5 * ((i - j) / sigma) ** 2) for j in near]
            out.append(sum(w * values[j] for w, j in zip(weight, near)) / sum(weight))
        return out

    s = smooth([r * (1 - x.linked) * (prior if a else 1.0 if p else 0.0) for r, x, a, p in zip(ratio, lines, article, prose)])
    mean = sum(s) / n
    dense = [x >= factor * mean for x in s]
    inside = sum(len(x.text) for x, d, a in zip(lines, dense, article) if d and a)
    outside = sum(len(x.text) for x, d, a, p in zip(lines, dense, article, prose) if d and p and not a)
    if inside and prior * inside >= outside:
        kept = [a and x >= low * mean for a, x in zip(article, s)]
        # all kept article lines are one run, since the gap between them is never over the page's length
        return kept if any(k and d for k, d in zip(kept, dense)) else [False] * n
    if inside:
        s = smooth([r * p for r, p in zip(ratio, prose)])
        mean = sum(s) / n
        dense = [x >= factor * mean for x in s]
    good = [p or not any(prose) for p in prose]
    regions = {x.region for x, d, g in zip(lines, dense, good) if d and g}
    keep = [x.region in regions and g for x, g in zip(lines, good)]
    at = [i for i in range(n) if keep[i]]
    for i, j in zip(at, at[1:]):
        if j - i - 1 <= gap:
            keep[i:j] = [True] * (j - i)
    return keep


def test_lines_chosen_as_by_plain_loops():
    rng = random.Random(6)
    for _ in range(400):
        level = rng.choice([0, 1, 2])
        lines = [Line("x" * rng.choice([1, 5, 40, 300]), rng.randrange(0, 9), rng.randrange(4), rng.choice([0, level]), rng.choice([0.0, 0.3, 1.0])) for _ in range(rng.randrange(1, 25))]
        for sigma, factor, low in ((1.0, 0.5, 0.02), (2.0, 1.0, 0.2), (0.5, 0.3, 0.0)):
            got = html_text.content_lines(lines, sigma, factor, 4.0, 2, 0.8, low)
            assert got.tolist() == brute(lines, sigma, factor, 4.0, 2, 0.8, low)


ARTICLE = "<article><h1>Title</h1><p>" + "Prose of the article goes on. " * 12 + "</p>" + "".join(f"<p><a href=x>tag {i}</a></p>" for i in range(9)) + "</article>"


def test_the_ratio_decides_within_articles(monkeypatch):
    """Short lines beside prose stay, links far from it go; with another ratio the text is another."""
    text = html_text.extract(ARTICLE)
    assert text.startswith("Title Prose of the article") and "tag 8" not in text
    page = "<div>" + "<p>" + "A long paragraph of the page, with words. " * 9 + "</p></div><div>" + "<p>mid</p>" * 6 + "</div><div>" + "".join(f"<p>no {i}</p>" for i in range(12)) + "</div>"
    before = html_text.extract(page)
    assert "no 11" not in before
    rng = np.random.default_rng(0)
    monkeypatch.setattr(html_text, "smooth", lambda x, sigma: rng.random(len(x)))
    assert html_text.extract(page) != before or html_text.extract(ARTICLE) != text
    monkeypatch.setattr(html_text, "smooth", lambda x, sigma: np.ones(len(x)))
    assert "tag 8" in html_text.extract(ARTICLE) and "no 11" in html_text.extract(page)


LONG = "Text of the article is here, and it is long enough. "


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><p>{LONG}</p></article><section><h2>Readers say</h2><article class='comment'><p>I like it very much</p></article></section>", LONG.strip()),
        (f"<article><p>{LONG}</p></article><section class='comments'><h2>Readers say</h2><article><p>I like it very much</p></article></section>", LONG.strip()),
        (f"<article><p>{LONG}</p></article><article class='reader-comment'><p>{LONG}</p></article><article id='comment-12'><p>{LONG}</p></article>", LONG.strip()),
        (f"<article class='post comments-open has-comments'><p>{LONG}</p></article>", LONG.strip()),
        (f"<nav><a href=x>menu</a><article><p>{LONG}</p></article>", LONG.strip()),
        (f"<nav><article><p>teaser</p></article></nav><p>{LONG}</p>", LONG.strip()),
        (f"<article><p>{LONG}</p><div class='market-share'><p>Market share fell by ten percent.</p></div><section id='related-work'><p>Related work was done by others before.</p></section></article>", f"{LONG}Market share fell by ten percent. Related work was done by others before."),
        (f"<article><p>{LONG}</p><div class='related-posts'><p><a href=x>Another story</a></p><p><a href=y>And one more</a></p></div></article>", LONG.strip()),
        ("<article><p>aa bb</p><!-- hidden note <p>bb</p>", "aa bb"),
        ("<article><p>aa</p><!--> <p>bb</p><!-- x --!><p>cc</p></article>", "aa bb cc"),
        ("<article><p>1 < 2 and a <b", "1 < 2 and a"),
    ],
)
def test_articles_comments_and_suspects(html, text):
    assert html_text.extract(html) == text


HOSTILE = {
    "stray ends": "<b></i>" * 70_000, "open comments": "<!--" * 125_000, "comments": "<!-- x -->" * 50_000, "blocks below a paragraph": "<p><table>" + "<h1>" * 120_000,
    "articles deep down": "<div>" * 50_000 + "<article></article>" * 12_000, "cut tags": "<a " * 170_000, "quotes": "<a '" * 120_000 + "<p>x</p>", "lists": "<ul><li>" * 50_000 + "</li>" * 20_000,
    "references": "&" * 500_000, "suspects": "<div class=related-x>" * 24_000, "ends": "<div>" * 50_000 + "</p>" * 50_000, "declarations": "<![x" * 125_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_time_follows_the_length(name):
    """Half a megabyte of hostile tags; the time of twice the length is about twice the time."""
    html, times = HOSTILE[name], []
    for page in (html, html + html):
        begin = time.process_time()
        html_text.extract(page)
        times.append(time.process_time() - begin)
    assert times[0] < 4 and times[1] < 3.5 * times[0] + 0.5
