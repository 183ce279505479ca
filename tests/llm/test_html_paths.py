"""Main-text extraction: what the path scores decide, against the article elements of whole pages, and hard pages."""

import html
import re
import time

import numpy as np
import pyarrow.parquet as pq
from tests.compare import SMALL

from glyphmill.llm import html_extract


def _article(page):
    """By hand for these tables: the text between the article's tags, cut at every tag that is no inline one."""
    inside = re.split(r"</article>|<footer>", page.split("<article>", 1)[1])[0]
    inside = re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", inside.replace("<br>", " "))
    return "\n\n".join(x for x in (" ".join(html.unescape(y).split()) for y in re.split(r"<[^>]+>", inside)) if x)


def test_articles_and_ablation(monkeypatch):
    pages = [x for x in pq.read_table(f"{SMALL}/pages.parquet").column("html").to_pylist() if x and "<article>" in x]
    want = [_article(x) for x in pages]
    assert [html_extract.extract_text(x) for x in pages] == want
    rng = np.random.default_rng(1)
    for other in (lambda paths, texts, linked: np.ones(len(paths)), lambda paths, texts, linked: rng.random(len(paths))):
        monkeypatch.setattr(html_extract, "path_scores", other)
        wrong = sum(html_extract.extract_text(x) != y for x, y in zip(pages, want, strict=True))
        assert wrong > 0.5 * len(pages)  # the scores decide, not the markup's names


PROSE = "Long words stand here, and there; many of them. Some more, with marks."


def test_pages_without_article():
    page = (
        "<body><div id=page><div class=menu><a href=x>Home</a> <a href=y>Shop</a></div><ul><li><a href=z>List, of links.</a></li></ul>"
        f"<div class=story><h2>Head</h2><p>{PROSE}</p><ul><li>One</li><li>Two</li></ul><p>{PROSE}</p></div>"
        "<div class=col2><span>Little</span></div><div class='box sponsored'>Buy, now. Really, do. And again; yes. Or, else.</div></div></body>"
    )
    assert html_extract.extract_text(page) == f"Head\n\n{PROSE}\n\nOne\n\nTwo\n\n{PROSE}"


def test_article_text_under_ambiguous_names():
    page = f"<nav><a>x</a></nav><article><h1>T</h1><p class=notice>{PROSE}</p><p class='share-price'>Up, 3.</p><p>{PROSE}</p><div class='cookie-notice'>We use cookies, ok.</div></article>"
    assert html_extract.extract_text(page) == f"T\n\n{PROSE}\n\nUp, 3.\n\n{PROSE}"


def test_long_and_deep_pages():
    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        assert len(html_extract.extract_text("<div>word, here " * n).split("\n\n")) == n
        html_extract.extract_text("<b>x</i>" * n)
        html_extract.extract_text("<svg>x, y.<p>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1


def test_clashing_columns_and_ties(spark):
    page = f"<p>{PROSE}</p><p>{PROSE}</p>"
    df = spark.createDataFrame([(1, "u", page, "other", 7), (1, "u", page, "other", 7)], "page_id long, url string, html string, text string, n_chars int")
    out = html_extract.report(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and {(r.text, r.n_chars) for r in out.collect()} == {(f"{PROSE}\n\n{PROSE}", 2 * len(PROSE) + 2)}
