import math
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardspan.llm import html_text

STORY = "It was a long story about a great many things, and it went on for quite a while."
CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a  b\n c<p>d&nbsp;e", "a b c\n\nd e"),
    (f"<html><head><title>T</title><style>x</style></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{STORY}</p><p>Short.</p><script>var t='</p>';</script></article><footer>&copy; us</footer></body></html>", f"Head\n\n{STORY}\n\nShort."),
    (f"<body><header><h1>Site</h1></header><div class='menu'>M</div><div id=content><h1>Head</h1><p>{STORY}</p><ul><li>One<li>Two</ul><div class='comments'><p>{STORY} I agree!</p></div></div><div class=sidebar>S</div><div class='cookie-notice'>We use cookies</div></body>", f"Head\n\n{STORY}\n\nOne\n\nTwo"),
    (f"<article><header><h1>Head</h1><p>By Bob</p></header><p>{STORY}</p><form>Mail <input></form><aside>See also</aside><p>x &lt; y</p></article><section id=comments><article><p>{STORY}</p></article></section>", f"Head\n\n{STORY}\n\nx < y"),
    (f"<main><p>{STORY}</p><pre>a\n b</pre></main><p>Outside</p>", f"{STORY}\n\na b"),
    (f"<div class=ad>Buy<article><p>{STORY}</p></article>", STORY),
    (f"<article><p><b>{STORY}<br><p>Next</b></article><footer>f", f"{STORY}\n\nNext"),
    (f"<table><tr><td>{STORY}</td><td>Cell</td></tr></table>", f"{STORY} Cell"),
    (f"<div role=navigation>N</div><div hidden>H</div><div style='display: none'>D</div><div><p>{STORY}</p></div>", STORY),
    ("<nav>Only a menu</nav>", ""),
    ("<article><p>One</p></article><article><p>Two</p></article>", "One\n\nTwo"),
    ("<!-- <p>no</p> --><![CDATA[x]]><p>&#233;&eacute;&#x1F600;&bogus;</p>", "éé😀&bogus;"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_pages(html, text):
    assert html_text.main_text(html) == text


@given(st.text(alphabet="<>/pdivartcle=\"'&;! -ab\n", max_size=200))
@settings(max_examples=300, deadline=None)
def test_never_fails(html):
    out = html_text.main_text(html)
    assert out == out.strip() and "\n\n\n" not in out


def test_template_of_many_paragraphs():
    blocks = [f"Paragraph {i} " + "text " * (i % 5) for i in range(200)]
    html = "<nav>m</nav><div class=ad>x</div><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    assert html_text.main_text(html) == "\n\n".join(b.strip() for b in blocks)


def test_operator(spark):
    rows = [(1, "u", CASES[3][0]), (1, "u", CASES[3][0]), (None, None, None), (2, "", "<p>" + "é" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", html_text.F.lit(1)).withColumn("_one", html_text.F.lit(2))
    out = html_text.extract(df)
    assert sorted(out.columns) == ["_one", "page_id", "text", "url"]
    assert sorted(len(r["text"]) for r in out.collect()) == sorted([len(CASES[3][1])] * 2 + [0, 300_000])
    assert html_text.extract(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    out = html_text.query(spark, sf_dir)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert out.filter("n_chars <> char_length(text)").count() == 0 and out.filter("n_chars = 0").count() == 0


@pytest.mark.parametrize("section", ["<![ endif]-->", "<![foo bar]>", "<![if !IE]>", "<![endif]>", "<![x[y]]>", "<![CDATA[a > b]]>"])
def test_unknown_sections_end_at_their_bracket(section):
    assert html_text.main_text(f"<article><p>{STORY}</p>{section}<p>More of it.</p></article>") == f"{STORY}\n\nMore of it."


LONG = "Some more of the story, which is told at length and without any haste at all. " * 3


def brute_content(page):
    """The rules once more, with ancestors looked up line by line."""

    def above(e):
        while e is not None:
            yield e
            e = e.parent

    lines = [x for x in page.lines if x.heading or not any(a.tag == "header" for a in above(x.at))]
    if not lines:
        return []
    ratios = [math.log(1 + max(0, len(x.text) - x.linked) / (1 + x.tags)) for x in lines]
    smooth = []
    for i in range(len(lines)):
        near = [(math.exp(-((i - j) ** 2) / 2), ratios[j]) for j in range(max(0, i - 3), min(len(lines), i + 4))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    cutoff, low = sum(smooth) / len(smooth), True
    for _ in range(20):
        low, high = [v for v in smooth if v < cutoff], [v for v in smooth if v >= cutoff]
        if not low or sum(high) / len(high) - sum(low) / len(low) < math.log(2):
            cutoff = 0
            break
        cutoff = (sum(low) / len(low) + sum(high) / len(high)) / 2
    rows = [(x, v >= cutoff) for x, v in zip(lines, smooth)]

    def goes(e):
        if not e.doubt:
            return False
        own = [x for x in lines if e in above(x.at)]
        high = [x for x in lines if x.ratio >= cutoff]
        return 2 * sum(x.own for x in high if x in own) < max(1, sum(x.own for x in high) if e.tag == "form" else sum(x.own + x.linked for x in own))

    rows = [(x, s) for x, s in rows if not any(goes(e) for e in above(x.at))]
    inside = sum(x.own for x, s in rows if s and x.at.root)
    if any(x.at.root for x, _ in rows) and 4 * inside >= sum(x.own for x, s in rows if s and not x.at.root):
        kind = "article" if any(x.at.root and x.at.root.tag == "article" for x, _ in rows) else "main"
        seeds_all = [(x, v >= cutoff) for x, v in zip(lines, smooth)]
        roots = [e for e in page.elements if e.root is e and e.tag == kind]

        def full(e):
            own = [(x, s) for x, s in seeds_all if e in above(x.at)]
            return sum(x.own for x, s in own if s) or sum(x.linked for x, _ in own) <= sum(x.own for x, _ in own)

        kept = [e for e in roots if full(e)] or roots
        here = [any(e in above(x.at) for e in kept) for x, _ in rows]
        first = here.index(True) if True in here else 0
        if first and rows[first - 1][0].at.tag == "h1":
            here[first - 1] = True
        return [x.text for (x, _), h in zip(rows, here) if h]
    total = sum(x.own for x, s in rows if s)
    region = page.elements[0]
    for e in page.elements:
        if e.tag in html_text.CONTAINERS and sum(x.own for x, s in rows if s and e in above(x.at)) >= html_text.SHARE * total:
            region = e
    here = [i for i, (x, _) in enumerate(rows) if region in above(x.at)]
    if not here:
        return []

    def core(i):
        return rows[i][1] and rows[i][0].ratio >= cutoff

    dense = [rows[i][0].ratio for i in here if core(i)]

    def joins(i):
        return 0 <= i < len(rows) and core(i) and dense and rows[i][0].ratio >= sum(dense) / len(dense) - math.log(2)

    lo, hi = here[0], here[-1]
    while joins(lo - 1):
        lo -= 1
    while lo and rows[lo - 1][0].heading:
        lo -= 1
    while joins(hi + 1):
        hi += 1
    marks = [i for i in range(lo, hi + 1) if core(i)] or [lo, hi]
    return [x.text for i, (x, _) in enumerate(rows) if lo <= i <= hi and (marks[0] <= i <= marks[-1] or x.linked * 2 <= len(x.text) + 1)]


PIECES = ["<div>", "</div>", "<div class=menu>", "<div class=legal-notes>", "<section id=discussion>", "</section>", "<p>", "</p>", "<a href=x>link text</a> ", "<a href=y>another link</a>", "short text ", LONG, STORY, "<ul><li>", "</ul>", "<article>", "</article>", "<h1>Title</h1>", "<h2>Part</h2>", "<form>", "</form>", "<main>", "</main>", "<footer>", "</footer>", "<br>", "<b>", "</b>"]


@given(st.lists(st.sampled_from(PIECES), max_size=40))
@settings(max_examples=400, deadline=None)
def test_brute_force(pieces):
    pages = []
    for _ in range(2):
        page = html_text.Lines()
        page.feed("".join(pieces))
        page.close()
        page._end_line()
        pages.append(page)
    assert html_text.content(pages[0]) == brute_content(pages[1])


MENU = "<div><ul>" + "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(8)) + "</ul></div>"
UNMARKED = f"<body>{MENU}<div><h1>Head</h1><p>{LONG}</p><p>Short.</p><p><a href=z>A link of its own</a></p><p>{LONG}</p></div><div><a href=/a>About</a> <a href=/b>Imprint</a></div>{MENU}</body>"


def test_clusters_select_the_region(monkeypatch):
    """Without marks and articles, the clusters tell the text from menus."""
    want = f"Head\n\n{LONG.strip()}\n\nShort.\n\nA link of its own\n\n{LONG.strip()}"
    flat = UNMARKED.replace("<div><h1>", "<h1>").replace("</p></div>", "</p>")
    assert html_text.main_text(UNMARKED) == html_text.main_text(flat) == want
    monkeypatch.setattr(html_text, "seeds_of", lambda lines: ([True] * len(lines), 0.0))
    assert html_text.main_text(flat) != want


OTHER = "A part that speaks of other things, in sentences as long as those around it and of the same kind. " * 2


@pytest.mark.parametrize(("part", "stays"), [
    (f"<section id=discussion><h2>Discussion</h2><p>{OTHER}</p></section>", True), (f"<div class=legal-analysis><p>{OTHER}</p></div>", True), ("<h2 id=related-work>Related work</h2>", True),
    (f"<div class=comments><p>{OTHER}</p></div>", False), (f"<div class='cookie-notice'>{OTHER}</div>", False), ("<div class=search-hints><a href=x>Search</a></div>", False), (f"<div id=user_comments><p>{OTHER}</p></div>", False), ("<form><label>Mail</label> <input> <input> Send</form>", False),
])
@pytest.mark.parametrize("around", ["article", "div"])
def test_doubtful_names(part, stays, around):
    html = f"<{around}><p>{LONG}</p><p>{LONG}</p>{part}<p>{LONG}</p></{around}>"
    text = "\n\n".join(re.findall(r"(?<=>)[^<>]*[a-z][^<>]*", part))
    want = [LONG.strip(), LONG.strip(), *([text.strip()] if stays else []), LONG.strip()]
    assert html_text.main_text(html) == "\n\n".join(want)


def test_sections_of_unlike_size_all_stay():
    html = f"<body><div><section><p>{LONG * 7}</p></section><section><p>{LONG * 3}</p></section><section><p>{LONG}</p></section></div></body>"
    assert html_text.main_text(html).count(LONG.strip()[:40]) == 33
    small = "<article><p>One</p></article>"
    assert html_text.main_text(f"<article><p>{LONG}</p></article>{small}") == f"{LONG.strip()}\n\nOne"


@pytest.mark.parametrize("html", ["<b>" * 30_000 + "</i>" * 25_000, "<div>" + "<b>" * 25_000 + "<hr>" * 25_000, "<b><td>" + "<i>" * 25_000 + "</b>" * 25_000, "<div>x" * 30_000, "<p>x" * 50_000, "<!--" * 50_000, '<a b="' * 33_000, "</" * 100_000, "<a b='" * 30_000 + ">", "<?" * 100_000])
def test_linear_time(html):
    began = time.time()
    html_text.main_text(html)
    assert time.time() - began < 3


@pytest.mark.parametrize(("html", "text"), [("a<!-->b<!--->c<!-- x --!>d<!-- never <p>e", "abcd"), ('<p>one</p><a href="x>two</a><p>three</p>', "one\n\ntwo\n\nthree"), ("<p>1 < 2 <b", "1 < 2 <b")])
def test_broken_markup(html, text):
    assert html_text.main_text(html) == text
