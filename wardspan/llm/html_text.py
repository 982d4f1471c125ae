"""Main text of web pages.

The standard library's streaming parser yields events. They are gathered into lines, one per block element; white space inside
becomes one blank. A line knows its characters, its tags, the characters inside links, and the element it lies in. Its
text-to-tag ratio (its logarithm) is smoothed over the neighbouring lines by a Gaussian, and the smoothed ratios fall into two
clusters, parted half way between their means. Lines of the high cluster are seeds, and they select the region:

* articles (else main elements) if these hold a fifth of the seeds' text or more; an article without seeds whose text is mostly
  links is a teaser and stays out;
* else the smallest container that holds ``SHARE`` of the seeds' text, and seeds that follow on at either end of it and are as
  dense as the seeds inside. Before the first and after the last line whose own ratio is high, lines that are mostly links are
  menus and go.

All other lines of the region stay, however short, but those in menus, headers, footers, sidebars, notices, adverts, forms and
comments. Tags, roles and names of nothing else tell these at once. Names that say so in part only (``legal-analysis``,
``discussion``) are doubtful, and the clusters decide: such a part stays if half of its text is in lines whose own ratio reaches
the high cluster, a form if half of all such text is in it. Headings are never told by their names.

Null html is empty and gives an empty text; so does a page without text outside such parts. Invalid UTF-8 is read with
replacement characters. Unclosed and crossed tags are closed by the next tag that needs it; the time is linear in the page, whose
events are all that is held of it. Equal ratios fall into one cluster. Repeated rows count each. Other columns pass through
:func:`extract`. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, free_name, map_arrow, small_batches, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a line.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody tfoot thead tr ul".split())
#: Elements that separate words but not lines.
GAPS = frozenset("br td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without main text.
NEVER = frozenset("head script style noscript template nav aside footer iframe object embed svg math canvas audio video map button select textarea input label datalist dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form tablist status".split())
#: Words of a class or id that mark such parts.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adslot adbox adunit sponsor sponsored sponsors promo promos promotion banner banners dfp taboola outbrain "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination paginator toc skip masthead topbar toolbar "
    "header footer colophon copyright legal disclaimer sidebar sidebars aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup login register "
    "comment comments commentlist disqus respond reply replies discussion reactions livefyre "
    "share sharing social sharebar related recommended recommendations teaser teasers trending popular tags taglist byline search form".split()
)
#: Words that say nothing beside a mark; a name of marks and such words is no doubt meant.
PLAIN = frozenset("a area articles bar block blocks bottom box button buttons col column container footer global group holder icons inner item items left link links list lists main module outer page panel post posts primary reader readers right row secondary section site slot stories story top unit user users view wrap wrapper zone".split())
#: Marks that are common names of an article's own parts.
DOUBTFUL = frozenset("discussion reactions reply replies respond".split())
#: Marks that an article inside does not overrule.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion reactions livefyre related recommended teaser teasers".split())
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SPACE = re.compile(r"\s+")
EMPTY_COMMENT, COMMENT_END = re.compile("-?>"), re.compile("--!?>")
#: Elements that may be the content region where there is no article, and the seeds' text that it holds.
CONTAINERS = frozenset("div section body center table td form main".split())
SHARE = 0.9
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: Clusters whose mean ratios are within this factor of each other are one.
APART = math.log(2)
#: A start tag of the first closes open elements of the second, up to an element of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Other blocks close a paragraph, up to one of these.
AROUND_P = ({"p"}, {"article", "main", "section", "div", "td", "th", "table", "li", "blockquote", "body", "aside", "nav", "footer", "header", "form", "button"})
#: Inline elements don't close these.
BARRIERS = ("table", "td", "th", "body", "article", "main")

KERNEL = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-3, 4)]


class Element:
    __slots__ = ("tag", "parent", "skip", "comments", "root", "header", "link", "doubt", "own", "core", "seeds", "linked", "inside", "out")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.skip = parent.skip if parent else False
        self.comments = parent.comments if parent else False
        self.root = parent.root if parent else None  # nearest article or main
        self.header = parent.header if parent else False  # of an article
        self.link = tag == "a" or (parent.link if parent else False)
        self.doubt = False
        self.own = self.core = self.seeds = self.linked = 0  # of all lines inside: unlinked characters, those of lines of a high ratio, of seeds, and linked ones
        self.inside = self.out = False  # in the region; in a doubtful part that goes


class Line:
    __slots__ = ("text", "tags", "linked", "at", "heading")

    def __init__(self, text: str, tags: int, linked: int, at: Element, heading: bool):
        self.text, self.tags, self.linked, self.at, self.heading = text, tags, linked, at, heading

    @property
    def own(self) -> int:
        return max(0, len(self.text) - self.linked)

    @property
    def ratio(self) -> float:
        """Of text to tags, as a logarithm: one very long line doesn't make all others low."""
        return math.log1p(self.own / (1 + self.tags))


class Lines(HTMLParser):
    """Gathers lines outside the parts that never hold main text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.top = Element("", None)
        self.elements = [self.top]  # parents before children
        self.depth = 0
        self.open: dict[str, list[int]] = defaultdict(list)  # depths of the open elements by tag
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.last_end, self.broken = -1, False

    def _end_line(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append(Line(text, self.tags, self.linked, self.top, self.top.tag in HEADINGS))
            self.parts = []
        self.tags = self.linked = 0

    def _depth(self, tags) -> int:
        """Of the deepest open element with such a tag; 0 for none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _pop(self, depth: int) -> None:
        """Close all down to the element at this depth, itself too."""
        while self.depth >= depth:
            self.open[self.top.tag].pop()
            self.top = self.top.parent
            self.depth -= 1

    def _close(self, tags: set[str], until: set[str]) -> None:
        depth = self._depth(tags)
        if depth > self._depth(until):
            self._end_line()
            self._pop(depth)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
            if tag not in CLOSES:
                self._close(*AROUND_P)
        elif tag in GAPS:
            self.parts.append(" ")
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        self.tags += 1
        if tag in VOID:
            return
        new = Element(tag, self.top)
        if tag in ("body", "html"):
            new.skip = new.comments = False
        sure, doubtful = self._marks(attrs) if attrs and tag not in ("html", "body") and tag not in HEADINGS else (set(), False)
        if tag in ("article", "main") and not new.comments and COMMENTS.isdisjoint(sure):
            new.skip, new.root = False, new
        elif not new.skip:
            if tag in NEVER or (tag == "header" and new.root is None):
                new.skip = True
            elif tag == "header":
                new.header = True
            if sure:
                new.skip = True
            new.doubt = doubtful or tag == "form"
        if new.skip and not COMMENTS.isdisjoint(sure):
            new.comments = True
        self.top = new
        self.elements.append(new)
        self.depth += 1
        self.open[tag].append(self.depth)

    @staticmethod
    def _marks(attrs: list[tuple[str, str | None]]) -> tuple[set[str], bool]:
        """Words of classes and ids that are marks for sure ("" for hidden elements and roles), and if others may be."""
        out: set[str] = set()
        doubtful = False
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                for token in value.split():
                    words = WORDS.findall(CAMEL.sub(" ", token).lower())
                    marks = [w for w in words if w in MARKS]
                    if marks and "content" not in words and "body" not in words and "article" not in words:
                        if all((w in MARKS and w not in DOUBTFUL) or w in PLAIN for w in words):
                            out.update(marks)
                        else:
                            doubtful = True
            elif name == "role":
                if value.strip().lower() in ROLES:
                    out.add("")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
                out.add("")
        return out, doubtful

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        elif tag in GAPS:
            self.parts.append(" ")
        self.tags += 1
        depth = self._depth((tag,))
        if depth and (tag in BLOCKS or tag in BARRIERS or depth > self._depth(BARRIERS)):  # an inline element doesn't close what it lies in
            self._pop(depth)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    # Whole pages are fed at once, so what doesn't end here never does; the library would search the rest anew from each place.

    def goahead(self, end: bool) -> None:
        self.last_end = self.rawdata.rfind(">")
        super().goahead(end)

    def parse_comment(self, i: int, report: int = 1) -> int:
        if found := EMPTY_COMMENT.match(self.rawdata, i + 4) or COMMENT_END.search(self.rawdata, i + 4):
            return found.end()
        return len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        return -1 if i > self.last_end else super().parse_endtag(i)

    def parse_pi(self, i: int) -> int:
        return -1 if i > self.last_end else super().parse_pi(i)

    def check_for_whole_start_tag(self, i: int) -> int:
        """A tag whose quotes never close ends at the next bracket."""
        end = -1 if i > self.last_end else super().check_for_whole_start_tag(i)
        if end < 0 <= (found := self.rawdata.find(">", i) if i <= self.last_end else -1):
            self.broken, end = True, found + 1
        return end

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Closed CDATA goes up to its brackets; anything else is a comment up to the next '>', as browsers read it."""
        if self.rawdata.startswith("CDATA[", i + 3) and (end := self.rawdata.find("]]>", i)) >= 0:
            return end + 3
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data: str) -> None:
        if self.broken:
            self.broken = False
            if data.startswith("<"):  # the broken tag itself
                return
        top = self.top
        if not top.skip:
            self.parts.append(data)
            if top.link:
                self.linked += len(data.strip())


def smoothed(ratios: list[float]) -> list[float]:
    out = []
    for i in range(len(ratios)):
        total = weights = 0.0
        for k, w in enumerate(KERNEL, i - 3):
            if 0 <= k < len(ratios):
                total += w * ratios[k]
                weights += w
        out.append(total / weights)
    return out


def threshold(values: list[float]) -> float:
    """Half way between the means of the low and the high values, found by turns (two clusters on a line); 0 where the
    means are less than ``APART`` apart: then there is one cluster."""
    cutoff = sum(values) / len(values)
    for _ in range(20):
        low, high = [v for v in values if v < cutoff], [v for v in values if v >= cutoff]
        if not low or sum(high) / len(high) - sum(low) / len(low) < APART:
            return 0.0
        now = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if now == cutoff:
            break
        cutoff = now
    return cutoff


def seeds_of(lines: list[Line]) -> tuple[list[bool], float]:
    """Which lines are in the high cluster, and where it begins."""
    smooth = smoothed([x.ratio for x in lines])
    cutoff = threshold(smooth)
    return [v >= cutoff for v in smooth], cutoff


def content(page: Lines) -> list[str]:
    """The texts of the lines in the content region, in page order."""
    lines = [x for x in page.lines if x.heading or not x.at.header]  # a header inside an article keeps its headings only
    if not lines:
        return []
    seeds, cutoff = seeds_of(lines)
    for x, seed in zip(lines, seeds, strict=True):
        at = x.at
        at.own += x.own
        at.core += x.own if x.ratio >= cutoff else 0
        at.linked += x.linked
        at.seeds += x.own if seed else 0
    for e in reversed(page.elements[1:]):
        for what in ("own", "core", "linked", "seeds"):
            setattr(e.parent, what, getattr(e.parent, what) + getattr(e, what))
    for e in page.elements[1:]:
        e.out = e.parent.out or (e.doubt and 2 * e.core < max(1, page.elements[0].core if e.tag == "form" else e.own + e.linked))
    kept = [i for i, x in enumerate(lines) if not x.at.out]
    if not kept:
        return []
    lines, seeds = [lines[i] for i in kept], [seeds[i] for i in kept]
    in_roots = sum(x.own for x, seed in zip(lines, seeds, strict=True) if seed and x.at.root)
    if any(x.at.root for x in lines) and 4 * in_roots >= sum(x.own for x, seed in zip(lines, seeds, strict=True) if seed and not x.at.root):
        return _in_articles(page, lines)
    return _in_container(page, lines, seeds, cutoff)


def _in_articles(page: Lines, lines: list[Line]) -> list[str]:
    kind = "article" if any(x.at.root and x.at.root.tag == "article" for x in lines) else "main"
    sought = [e for e in page.elements[1:] if e.root is e and e.tag == kind]
    full = [e for e in sought if e.seeds or e.linked * 2 <= e.own + e.linked]
    for e in full or sought:
        e.inside = True
    for e in page.elements[1:]:
        e.inside = e.inside or e.parent.inside
    inside = [x.at.inside for x in lines]
    first = inside.index(True) if any(inside) else 0
    if first and lines[first - 1].at.tag == "h1":  # the title before its article
        inside[first - 1] = True
    return [x.text for x, here in zip(lines, inside, strict=True) if here]


def _in_container(page: Lines, lines: list[Line], seeds: list[bool], cutoff: float) -> list[str]:
    held = [0] * len(page.elements)
    place = {id(e): i for i, e in enumerate(page.elements)}
    for x, seed in zip(lines, seeds, strict=True):
        held[place[id(x.at)]] += x.own if seed else 0
    for i in range(len(held) - 1, 0, -1):
        held[place[id(page.elements[i].parent)]] += held[i]
    region = page.elements[0]
    for e, own in zip(page.elements, held, strict=True):  # those that hold so much lie in one another
        if own >= SHARE * held[0] and e.tag in CONTAINERS:
            region = e
    region.inside = True
    for e in page.elements[1:]:
        e.inside = e.inside or e.parent.inside
    here = [i for i, x in enumerate(lines) if x.at.inside]
    if not here:
        return []
    core = [seed and x.ratio >= cutoff for x, seed in zip(lines, seeds, strict=True)]  # not by its neighbours alone
    dense = [lines[i].ratio for i in here if core[i]]
    alike = sum(dense) / len(dense) - APART if dense else math.inf
    lo, hi = here[0], here[-1]
    while lo and core[lo - 1] and lines[lo - 1].ratio >= alike:
        lo -= 1
    while lo and lines[lo - 1].heading:
        lo -= 1
    while hi + 1 < len(lines) and core[hi + 1] and lines[hi + 1].ratio >= alike:
        hi += 1
    marks = [i for i in range(lo, hi + 1) if core[i]] or [lo, hi]
    return [lines[i].text for i in range(lo, hi + 1) if marks[0] <= i <= marks[-1] or lines[i].linked * 2 <= len(lines[i].text) + 1]


def main_text(html: str) -> str:
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):  # the parser gives up on some broken declarations; what was read counts
        pass
    parser._end_line()
    return "\n\n".join(content(parser))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.decode("utf-8", "replace")) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary())], ["_row", "main"])


def extract(pages: DataFrame) -> DataFrame:
    """pages without html, and text beside (a text column that pages has is replaced)."""
    small_batches(pages.sparkSession)
    names = pages.columns
    rows = pages.select(F.struct(*[pages[c] for c in names if c != "html"], F.lit(1).alias(free_name(names, "_one"))).alias("_row"), binary("html"))
    out = map_arrow(rows, _extract, f"_row {rows.schema['_row'].dataType.simpleString()}, main binary")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names if c.lower() not in ("html", "text")], F.col("main").cast("string").alias("text"))


def query(spark, sf_dir):
    """op2: the main text of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
