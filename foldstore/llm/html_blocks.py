"""Main text of web pages from flat text blocks.

A page is cut into flat blocks of text at block-level tags. A block has a word count, a link density, those of the
blocks before and after it, and what its place in the page says: inside an article element or one named like it, inside
a part that is marked as boilerplate, inside one whose names contradict each other, a heading or not. A decision tree
over these, grown from the labelled table below, says which blocks are main text. On pages that mark nothing it goes by
the neighbours: three words between paragraphs are text, between links they aren't.

Parts of a line that are hidden or named as adverts are left out of their block.

Defined cases: null and empty html give an empty text; tags that are never closed end with their page; a broken tag is
text; repeated rows are extracted each; very long pages are read in one pass, in time in proportion to their length; an
empty table gives no rows; kept columns named text or n_chars give way to the results.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from foldstore.llm.runtime import small_batches, tidy

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Names of HTML elements and words that pages use to name their parts.
SKIPPED = frozenset("script style title noscript template textarea select iframe object svg math canvas audio video button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input picture map area embed".split()
)
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot copyright comment comments commentlist disqus reply replies respond "
    "related recommended recommendations share sharing social widget widgets toolbar pagination pager search form disclaimer feedback discussion responses reactions talkback usercomments".split()
)
#: Of these, the ones that also count on parts of a line.
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion share sharing".split())
ARTICLE_WORDS = frozenset("article content post entry story main articlebody postbody maincontent".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNNESTED = HEADINGS | frozenset("p li dt dd tr td th hr pre".split())


class Block:
    __slots__ = ("article", "boilerplate", "heading", "linked", "text", "unsure", "words")

    def __init__(self, text: str, words: int, linked: int, article: bool, boilerplate: bool, unsure: bool, heading: bool):
        self.text, self.words, self.linked, self.article, self.boilerplate, self.unsure, self.heading = text, words, linked, article, boilerplate, unsure, heading


def _values(attributes: str) -> Iterator[tuple[str, str]]:
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        yield key.lower(), (a or b or c).lower()


def _hides(key: str, value: str) -> bool:
    return key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and bool(HIDING.search(value)))


def _words(value: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", value))


BOILERPLATE_MARK, ARTICLE_MARK, UNSURE_MARK = 1, 2, 4


def _marks(name: str, attributes: str, within_article: bool) -> int:
    """What an element says about what is in it, as marks. Names speak for boilerplate unless the element is an article
    by its kind; where names speak for both, it is unsure."""
    is_article = name in ARTICLE
    marks = ARTICLE_MARK if is_article else BOILERPLATE_MARK if name in BOILERPLATE and not (name == "header" and within_article) else 0
    if attributes and name not in ("body", "html"):
        named: set[str] = set()
        for key, value in _values(attributes):
            if key in ("class", "id"):
                named |= _words(value)
            elif key == "role":
                marks |= BOILERPLATE_MARK * (value in BOILERPLATE_ROLES) | ARTICLE_MARK * (value in ("main", "article"))
            elif _hides(key, value):
                marks |= BOILERPLATE_MARK
        if not is_article and named:
            good, bad = bool(named & ARTICLE_WORDS) and name in ("div", "section", "td"), bool(named & BOILERPLATE_WORDS)
            marks |= UNSURE_MARK if good and bad else BOILERPLATE_MARK * bad | ARTICLE_MARK * good
    return marks


def _left_out(attributes: str) -> bool:
    """Whether a part of a line is hidden or an advert."""
    return any(_hides(key, value) or (key in ("class", "id") and bool(_words(value) & ADVERT_WORDS)) for key, value in _values(attributes))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    linked_parts: list[str] = []
    stack: list[tuple[str, int]] = []
    inside = {BOILERPLATE_MARK: 0, ARTICLE_MARK: 0, UNSURE_MARK: 0}  # open elements with each mark
    links = 0
    left_out, depth = "", 0  # the part of a line that is being left out
    heading = False
    at, n = 0, len(page)

    def mark(marks: int, step: int) -> None:
        for kind in inside:
            if marks & kind:
                inside[kind] += step

    def close() -> None:
        nonlocal parts, linked_parts, left_out
        left_out = ""
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                linked = len("".join(linked_parts).split()) if linked_parts else 0
                words = text.count(" ") + 1
                out.append(Block(text, words, min(linked, words), inside[ARTICLE_MARK] > 0, inside[BOILERPLATE_MARK] > 0, inside[UNSURE_MARK] > 0, heading))
        parts, linked_parts = [], []

    def add(raw: str) -> None:
        if left_out:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked_parts.append(text)

    lower = None
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in SKIPPED:
            if not closing and not attributes.endswith("/"):
                lower = lower if lower is not None else page.lower()
                end = lower.find(f"</{name}", at) if len(lower) == n else page.find(f"</{name}", at)
                stop = page.find(">", end) if end >= 0 else -1
                # An element that is never closed hides only itself, unless what is in it isn't markup.
                if stop >= 0:
                    at = stop + 1
                elif name in ("script", "style"):
                    at = n
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name in INLINE:
            if left_out:
                depth += (name == left_out) * (-1 if closing else 1)
                left_out = left_out if depth else ""
            elif not closing and attributes and name not in VOID and not attributes.endswith("/") and _left_out(attributes):
                left_out, depth = name, 1
            continue
        close()
        if name in VOID:
            continue
        if name in HEADINGS:
            heading = not closing
        if not closing:
            if attributes.endswith("/"):
                continue
            if stack and stack[-1][0] == "p":  # a paragraph ends where the next block opens
                mark(stack.pop()[1], -1)
            marks = _marks(name, attributes, inside[ARTICLE_MARK] > 0)
            if name in UNNESTED and not marks:
                continue
            stack.append((name, marks))
            mark(marks, 1)
        else:
            links = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, marks in stack[k:]:
                        mark(marks, -1)
                    del stack[k:]
                    break
    close()
    return out


NAMES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "in_article", "page_has_article", "boilerplate", "unsure", "heading")
NEIGHBOURS = tuple(k for k, name in enumerate(NAMES) if name.endswith(("_before", "_after")))


def rows(found: list[Block]) -> list[tuple]:
    has = any(b.article for b in found)
    # Beyond the ends of a page there are neither words nor links.
    own = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    return [(*own[k + 1], *own[k], *own[k + 2], int(b.article), int(has), int(b.boilerplate), int(b.unsure), int(b.heading)) for k, b in enumerate(found)]


# The labelled table: pages after common layouts. A number stands for so many words, a number before L for so many
# linked ones; blocks that begin with + are main text, those with - aren't.
LABELLED = (
    # Nothing is marked: text is known by its length and its company.
    "<ul><li>-1L<li>-2L<li>-1L<li>-3L</ul><h1>+7</h1><p>+60<p>+3<p>+45<h2>+2</h2><p>+80<p>+1<p>+30 2L<p>+18<p>-2L<p>-3L<p>-6<p>-1L",
    "<div>-6L</div><p>-4<div>-2L</div><p>+25<p>+12<p>+90<p>+6<p>+14<div>-5L</div><div>-5</div><div>-4L</div>",
    "<p>+3<p>+5<p>+2<p>+4<p>+6<p>+1<p>+4",
    "<p>+12", "<p>+2", "<h1>+4</h1><p>+1<p>+2",
    "<table><tr><td>-2L<td>-1L<td>-2L</table><p>-2<p>-1L<h1>+5</h1><p>+9<p>+40<p>+11<p>+35<p>-4L<p>-7 6L<p>-3L<p>-9<p>-2L",
    "<div>-3 9L</div><div>-2 10L</div><p>+50<p>+20 4L<p>+70<div>-4 12L</div><div>-8L</div>",
    "<p>-1L<p>-3<p>-2L<h2>+6</h2><p>+22<p>+16<p>+2<p>+25<p>-3L<p>-2<p>-2L<p>-12<p>-1L",
    "<p>+150<p>-10L<p>-12L<p>-3<p>-9L", "<p>-2L<p>-8<p>-3L<p>+33<p>+8<p>+41",
    "<h1>+5</h1><p>+28<h2>+3</h2><p>+2<p>+17<h2>+1</h2><p>+55<p>-2L<p>-1 2L",
    # Names that contradict each other.
    "<div class='content related'><h1>+6</h1><p>+70<p>+4<p>+50<p>+12 1L<p>+33</div><ul><li>-3L<li>-4L</ul>",
    "<p>+40<p>+52<div class='related post'><p>-6L<p>-7L<p>-5L<p>-4<p>-6L</div>",
    "<div class='post header'><h1>+9</h1><p>+44<p>+3<p>+61</div>", "<article><p>+20<div class='widget entry'><p>-3L<p>-4L<p>-2<p>-5L</div><p>+30</article>",
    "<article><div class='story footer'><h2>+4</h2><p>+31<p>+2<p>+26</div><p>+12</article>",
    # Text outside the article of a page that has one.
    "<ul><li>-1L<li>-2L</ul><p>-10<article><h1>+8</h1><p>+60<p>+2<p>+5L<p>+3 3L<p>+150</article><p>-50<p>-7<p>-3L<p>-100",
    "<p>-30<p>-40<main><p>+1<p>+12L<p>+4L<p>+3L<p>+25</main><p>-60<p>-45", "<article>+4L</article><p>-5", "<article><ul><li>+2L<li>+3L<li>+1L</ul><p>+6<p>+2</article><h2>-3</h2><p>-20",
    "<div class=post><h1>+6</h1><p>+9 9L<p>+1<p>+20L</div><p>-70<p>-4<div>-4L</div>", "<article><p>+8<h2>+1</h2><p>+1<p>+1L<p>+200<h3>+2</h3></article>",
    # Marked parts: before, within and after an article, and without one; of any length and in any company.
    "<nav><p>-1L<p>-2L</nav><header><h2>-3</h2></header><p>+50<p>+30<footer><p>-9<p>-40</footer>",
    "<article><p>+60<div class=ad><p>-30 2L<p>-15</div><p>+45<div class=share>-4</div><p>+70<div class=comments><h2>-4</h2><p>-120<p>-90<p>-2</div></article>",
    "<div class=cookie>-45</div><p>+80<aside><h2>-2</h2><p>-90<p>-5</aside><p>+6<p>+75<form>-3</form><div id=comments><p>-35<p>-40<p>-1</div>",
    "<div class=ad>-8</div><article><p>+10<p>+40</article><div class=ad>-60</div><footer>-25</footer>", "<div class='sidebar'><p>-12<p>-70<p>-3L</div><p>+90", "<div class=notice>-20</div><p>+3<p>+4",
)


@cache
def table() -> tuple[tuple, ...]:
    """Rows of features with their labels at the end."""
    out = []
    for page in LABELLED:
        page = re.sub(r"(\d+)L", lambda m: "<a href=x>" + "w " * int(m[1]) + "</a>", page)
        page = re.sub(r"(?<=[-+> ])(\d+)(?=[< ]|$)", lambda m: "w " * int(m[1]), page)
        found = blocks(page)
        labels = [b.text[0] for b in found]
        out += [(*row, int(label == "+")) for row, label in zip(rows(found), labels, strict=True)]
    return tuple(dict.fromkeys(out))


def _gini(labels: list[int]) -> float:
    p = sum(labels) / len(labels)
    return 2 * p * (1 - p) * len(labels)


def grow(table: list[tuple], depth: int = 9):
    """A decision tree by least Gini impurity: (feature, threshold, tree up to it, tree above it) or a label."""
    labels = [r[-1] for r in table]
    if depth == 0 or len(set(labels)) == 1:
        return int(2 * sum(labels) > len(labels))
    best = None
    for f in range(len(table[0]) - 1):
        values = sorted({r[f] for r in table})
        for low, high in zip(values, values[1:]):
            t = (low + high) / 2
            left, right = [r[-1] for r in table if r[f] <= t], [r[-1] for r in table if r[f] > t]
            cost = _gini(left) + _gini(right)
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, t
    if best is None:
        return int(2 * sum(labels) > len(labels))
    _, f, t = best
    return f, t, grow([r for r in table if r[f] <= t], depth - 1), grow([r for r in table if r[f] > t], depth - 1)


@cache
def tree():
    return grow(list(table()))


def is_main(row: tuple, node) -> bool:
    while not isinstance(node, int):
        f, t, low, high = node
        node = low if row[f] <= t else high
    return bool(node)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, r in zip(found, rows(found), strict=True) if is_main(r, tree()))


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every page, its main text and the text's code points."""
    small_batches(pages.sparkSession, 500)
    keep = [k for k in keep if k not in ("text", "n_chars")]
    whole = pages.select(*keep, pages["html"].alias("html_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    return whole.mapInArrow(tidy(run), whole.drop("html_page").schema.add("text", "string").add("n_chars", "long"))
