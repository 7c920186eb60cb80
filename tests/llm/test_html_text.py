import html
import random
import re
import time

import pytest

from langweave.llm import html_text
from langweave.llm.html_text import extract_text, main_text, spans_of_text

LONG = "This paragraph is long enough that a window of lines over it surges past the threshold of the method. "


def test_given_pages_equal_a_plain_reading(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = {r.page_id: r.html for r in frame.collect()}
    got = extract_text(frame).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h\d)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<br>b</p><p> </p>", "a b"),
        (f"<nav>{LONG}</nav><article><p>short</p></article>", "short"),
        (f"<div class='sidebar'>{LONG * 3}</div><div><p>{LONG}</p><p>end</p></div>", f"{LONG.strip()}\n\nend"),
        (f"<article><p>{LONG}</p><div id='comments'><p>{LONG * 4}</p></div></article>", LONG.strip()),
        (f"<main><header><h1>Title</h1><p>by x</p></header><p>{LONG}</p><form>f</form></main>", f"Title\n\n{LONG.strip()}"),
        (f"<body><header>site</header><div><ul><li><a href=x>one<li><a href=y>two</ul><p>{LONG}</div>", LONG.strip()),
        ("<article><p>x &amp; y &lt;z&gt; &#233;&nbsp;&am", "x & y <z> é &am"),
        ("<article><script>if (a<b) {'</p>'}</script><style>p{}</style><p>t<span class=ad>buy</span>u</article>", "tu"),
        (f"<article><p hidden>{LONG}</p><p style='display:none'>{LONG}</p><p>seen</p></article>", "seen"),
        (f"<article class='post-related'>{LONG * 5}</article><article><p>{LONG}</p></article>", LONG.strip()),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


GAP = "<div class='ad'>x</div><div class='share'>y</div><div class='newsletter'>z</div>"


@pytest.mark.parametrize(
    "page, blocks",
    [
        (f"<body><div><h1>Title</h1><p>{LONG * 2}</p><p>{LONG * 3}</p>{GAP}<p>{LONG * 9}</p></div>", ("Title", 2, 3, 9)),
        (f"<body><div><div><p>{LONG}</p></div>{GAP}<div><p>{LONG * 2}</p></div></div>", (1, 2)),
        (f"<body><div>Title</div><div>{LONG}</div>", ("Title", 1)),
        (f"<article><p>{LONG}</p></article>{GAP}<p>between</p><article><h2>More</h2><p>{LONG * 3}</p></article>", (1, "More", 3)),
    ],
)
def test_text_between_dropped_blocks_stays_whole(page, blocks):
    assert main_text(page) == "\n\n".join(b if isinstance(b, str) else (LONG * b).strip() for b in blocks)


@pytest.mark.parametrize(
    "start, end",
    [
        ("<div id='content' class='has-sidebar'>", "</div>"),
        ("<main class='content no-sidebar'>", "</main>"),
        ("<article class='post category-social comments-open'>", "</article>"),
        ("<article class='post share'>", "</article>"),
        ("<div class='page-with-nav'>", "</div>"),
        ("<div class='content sidebar'>", "</div>"),
        ("<form id='aspnet'><div class='page'>", "</div></form>"),
        ("<form><div class='page widget'><div>", "</div></div></form>"),
    ],
)
def test_words_on_a_wrapper_drop_no_article(start, end):
    beside = f"<div class='comments'><p>{LONG * 2}</p><p>{LONG * 2}</p></div>"
    page = f"<body>{start}<h1>Title</h1><p>{LONG * 2}</p><p>{LONG}</p>{beside}{end}</body>"
    assert main_text(page) == f"Title\n\n{(LONG * 2).strip()}\n\n{LONG.strip()}"


def test_line_blocks():
    assert spans_of_text([0, 100, 50, 0, 0, 0, 5, 0, 0, 200]) == [(0, 3), (7, 10)]
    assert spans_of_text([5, 6, 7]) == [(0, 3)]
    assert spans_of_text([0, 0]) == [] and spans_of_text([]) == []


def test_awkward_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (2, None, "<p>" * 20_000), (3, "v", "<div>" * 3000 + "deep"), (3, "v", "x " * 200_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as N_CHARS")
    got = extract_text(frame).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(None, None, 0), (1, "u", 0), (2, None, 0), (3, "v", 4), (3, "v", 399_999)]
    assert extract_text(frame.limit(0)).collect() == []


SITES = "Home World Politics Business Technology Science Health Sport Culture Travel Opinion Video Photos Podcasts Weather Shop"
RIGHTS = "\u00a9 2024 Example Media"


@pytest.mark.parametrize(
    "page, blocks",
    [
        # Ten wrappers whose class is furniture, around all there is.
        ("<div class=widget>" * 10 + f"<p>{LONG}</p><p>{LONG * 2}</p>" + "</div>" * 10, (1, 2)),
        # An omitted end tag of head.
        (f"<head><title>x</title><meta name=a><body><article><p>{LONG}</p></article>", (1,)),
        (f"<head><title>x</title><p>{LONG}</p>", (1,)),
        # Headings and sections of the article whose names hold a common word.
        (
            f"<article><h2 id='related-work'>Earlier</h2><section id='search-methods'><p>{LONG}</p></section>"
            f"<div class='social-history'><p>{LONG * 2}</p></div><p id='menu-reform'>{LONG}</p></article>",
            ("Earlier", 1, 2, 1),
        ),
        # Without article or main: sections of the site before the text, rights after it.
        (f"<body><div>{SITES}</div><div><h1>Title</h1><p>{LONG}</p><p>{LONG * 3}</p></div><div>{RIGHTS}</div>", ("Title", 1, 3)),
        (f"<body><div>{SITES}</div><h1>Title</h1><p>{LONG}</p><p>{LONG * 3}</p><p>End</p><div>{RIGHTS}</div>", ("Title", 1, 3, "End")),
        (f"<body><div><section><p>{LONG}</p></section><section><h2>Two</h2><p>{LONG * 9}</p></section></div>", (1, "Two", 9)),
        # Within an article, what a dive parts from its text goes: links and short lines after empty ones.
        (f"<article><h1>T</h1><p>by</p><p>at</p><p>{LONG}</p><p>end</p>{GAP}<p>tag</p></article>", ("T", "by", "at", 1, "end")),
    ],
)
def test_lines_and_links_decide(page, blocks):
    assert main_text(page) == "\n\n".join(b if isinstance(b, str) else (LONG * b).strip() for b in blocks)


def test_nesting_costs_linear_time():
    started = time.process_time()
    deep = "<div class=x>" * 40_000 + f"<p>{LONG}</p>" + "</div>" * 40_000
    assert main_text(deep) == LONG.strip()
    assert main_text("<p>" * 40_000 + "</b>" * 40_000 + "<i>" * 20_000 + "x" + "</i>" * 20_000) == "x"
    assert time.process_time() - started < 10


WORDS = "the river ran past an old mill and nobody in town knew who had built it or when its wheel had stopped".split()


def made_page(seed):
    """A page without article or main, in one of several layouts, and the blocks of its article and of its furniture."""
    r = random.Random(seed)
    sentence = lambda n: " ".join(r.choices(WORDS, k=n)).capitalize() + "."
    blocks = [" ".join(r.choices(WORDS, k=5)).title()]
    for _ in range(r.randint(2, 7)):
        if r.random() < 0.3:
            blocks.append(" ".join(r.choices(WORDS, k=3)).title())
        blocks.append(" ".join(sentence(r.randint(5, 20)) for _ in range(r.randint(1, 4))))
    menu = [" ".join(r.choices(WORDS, k=r.randint(1, 2))).title() + str(i) for i in range(r.randint(3, 9))]
    links = "".join(f"<li><a href=/{i}>{m}</a></li>" for i, m in enumerate(menu))
    rights = f"\u00a9 {2000 + seed} {' '.join(r.choices(WORDS, k=3))}"
    sections = " | ".join(r.sample(WORDS, 9)).upper()
    heads = [f"<h1>{blocks[0]}</h1>"] + [f"<p>{b}</p>" if "." in b else f"<h2>{b}</h2>" for b in blocks[1:]]
    body = "".join(heads)
    if r.random() < 0.5:
        body = body.replace("</p>", "</p><div class='ad-slot'>buy now</div>", 1)
    body = r.choice([body, f"<div>{body}</div>", f"<div id=content><div class=inner>{body}</div></div>"])
    before = r.choice([f"<ul>{links}</ul>", f"<div>{sections}</div>", f"<div><ul>{links}</ul></div><div>{sections}</div>"])
    return f"<html><head><title>t<body>{before}{body}<div>{rights}</div></html>".replace("<title>t", "<title>t</title>"), blocks, [*menu, sections, rights]


def test_made_pages_without_article():
    """Share of article blocks found and of furniture blocks left out; and the windows decide part of that."""
    found = wanted = left = furniture = 0
    for seed in range(300):
        page, blocks, beside = made_page(seed)
        got = main_text(page).split("\n\n")
        found += sum(b in got for b in blocks)
        wanted += len(blocks)
        left += sum(b not in got for b in beside)
        furniture += len(beside)
    assert found / wanted >= 0.99 and left / furniture >= 0.99, (found / wanted, left / furniture)


def test_the_windows_change_the_result(monkeypatch):
    pages = [made_page(seed)[0] for seed in range(40)]
    pages.append(f"<article><p>{LONG}</p>{GAP}<p>tag</p><p>tag</p></article>")
    before = [main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "SURGE_CHARS", 10**9)
    assert [main_text(p) for p in pages] != before
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "windows", lambda lengths: [10**9] * len(lengths))
    assert [main_text(p) for p in pages] != before
