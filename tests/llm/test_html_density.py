"""Main text: pages with their exact text, what density decides, and every page of a table against a plain reading of its article."""

import html as characters
import re

import duckdb
import pytest
from compare import DATA

from tidemark.llm import html, registry

FIRST, SECOND = "First paragraph of the story with words.", "Second paragraph of it, long enough to count."
STORY = f"<p>{FIRST}</p><p>{SECOND}</p>"


@pytest.mark.parametrize(("page", "text"), [
    ('<p>Prices rose <span class="ad">Buy now</span> by two percent.</p>', "Prices rose by two percent."),
    ("<p>In this <label>label</label> case</p>", "In this label case"),
    ("<p>one <button>Share</button> two <script>three()</script> four <select><option>x</option></select>five</p>", "one two four five"),
    (f'<div class="page has-sidebar sidebar-left">{STORY}</div>', f"{FIRST}\n{SECOND}"),
    (f'<div class="content tags-enabled">{STORY}</div>', f"{FIRST}\n{SECOND}"),
    (f'<div class="social-science-article">{STORY}</div>', f"{FIRST}\n{SECOND}"),
    (f'<div id="comment-policy-story">{STORY}</div>', f"{FIRST}\n{SECOND}"),
    (f'<article class="story with comments">{STORY}</article>', f"{FIRST}\n{SECOND}"),
    (f'<div class="comments"><div class="sidebar"><article>{STORY}</article></div></div>', f"{FIRST}\n{SECOND}"),
    (f'<article>{STORY}<div class="comments"><p>A reader writes a comment of many words that is quite long.</p></div></article>', f"{FIRST}\n{SECOND}"),
    (f'<div class="wrap sidebar">{STORY}<div class="ad"><p>Cheap things to buy today.</p></div></div>', f"{FIRST}\n{SECOND}"),
    (f'<span class="body widget">{STORY}</span>', f"{FIRST}\n{SECOND}"),
    (f'<div class="cookie-notice">{STORY}</div>', ""),
    ('<div class="menu"><a href=a>Home</a> <a href=b>News</a></div>', ""),
    ("<nav><p>Words in a menu only.</p></nav>", ""),
])
def test_exact_texts(page, text):
    assert html.main_text(page) == text
    assert html.main_text(f"<html><body><footer>foot</footer>{page}</body></html>") == text


def test_density_decides_lines_of_links():
    links = "".join(f'<p><a href="/{i}">Another story {i}</a></p>' for i in range(8))
    page = f"<article><h2><a href=/>The title</a></h2>{(STORY * 4)}{links}</article>"
    want = "\n".join(["The title", *[FIRST, SECOND] * 4])
    assert html.main_text(page) == want
    off = html.main_text(page, cut=lambda level: float("-inf"))  # every line counts as content
    assert off != want and off.startswith(want) and off.endswith("Another story 7")


def test_density_picks_the_region():
    menu = "<div>" + "".join(f"<p><a href=/{i}>Item {i}</a> now</p>" for i in range(30)) + "</div>"
    page = f"<body>{menu}<div>{STORY * 5}</div></body>"
    assert html.main_text(page) == "\n".join([FIRST, SECOND] * 5)
    assert html.main_text(page, cut=lambda level: float("-inf")) != html.main_text(page)


def plain(page):
    """The article of a page by plain patterns: what never belongs to one goes, block tags end lines, other tags go."""
    inner = re.search("(?s)<article[^>]*>(.*)</article>", page)[1]
    inner = re.sub("(?s)<(script|style|aside|form|nav|footer|button)\\b[^>]*>.*?</\\1>", "", re.sub("(?s)<!--.*?-->", "", inner))
    inner = re.sub('(?s)<(div|section|ul) class="(?:ad|share|related|comments?|newsletter|promo|tags|social)[^"]*">.*?</\\1>', "\n", inner)
    lines = re.split("(?i)</?(?:p|h[1-6]|li|ul|ol|div|section|blockquote|pre|tr|table|tbody|thead|dl|dt|dd|figure|figcaption)\\b[^>]*>", inner)
    texts = [" ".join(characters.unescape(re.sub("<[^>]*>", "", re.sub("(?i)<br[^>]*>|</?t[dh][^>]*>", " ", x))).split()) for x in lines]
    return "\n".join(x for x in texts if x)


def test_every_page_of_a_table_equals_its_article(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall())
    got = {r["page_id"]: r for r in registry.QUERIES["op2_html_density"](spark, DATA).collect()}
    assert set(got) == set(pages)
    differing = {i for i, page in pages.items() if got[i]["text"] != plain(page)}
    assert not differing, [(got[i]["text"][:300], plain(pages[i])[:300]) for i in list(differing)[:1]]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
