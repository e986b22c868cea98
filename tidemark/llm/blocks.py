"""Operator 11, main text of web pages by the distribution of text over blocks of lines.

Markup is stripped first: every block-level element starts a new line, and elements that never are article text (scripts,
styles, forms, menus, page headers and footers, sidebars, notices, adverts, reader comments: by element name, role, or
words in class and id) leave empty lines behind. Then the lengths of text outside links are summed over windows of WINDOW
lines. A stretch of text starts at a surge (a line whose window reaches a threshold and is followed by more text) and ends
at a dive (a window without text); the lines between are kept. Inside the page's article (else its main element) every
line of text counts, so the threshold is one character there and lines outside are emptied. On pages without either,
the threshold is THRESHOLD characters, the stretch starts at its heading if one is near its top, and stretches of less
than a share of the longest one go.

Each page is its own row, so nothing is shuffled, and one pass over its tags makes the lines.

Cases: null and empty html give an empty text; broken markup is read as browsers do (unclosed elements end with their
parent, unmatched end tags are ignored, an unclosed comment or script runs to the end); a line break element is white
space within its block; very long pages take linear time; of several articles of one page the one with the most text is
the page's, ties going to the first (the main element's own text, if that is more); repeated rows give equal rows; an empty table gives an empty result; only page_id,
url and html are read, so others may be named anything.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import slices

WINDOW, THRESHOLD, SHARE = 3, 80, 0.2
TAG = re.compile(r"""<(?:!--(?P<remark>.*?)(?:-->|\Z)|(?P<bogus>(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*))(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
# fixed values of HTML: elements without content, with raw text, and that start a block
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2".split())
# what is no article text: by element, by role, and by words of class and id
NEVER = frozenset("nav aside footer menu dialog button select object svg math canvas audio video template noscript search fieldset map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs cookie cookies consent gdpr"
    " notice notices popup modal newsletter subscribe subscription share sharing social related recommended recommendations pagination pager footer masthead widget widgets toolbar skip login signup".split()
)
REPLIES = frozenset("comment comments disqus reply replies respond".split())
HEADERS = frozenset("header topbar banner".split())
OWN = frozenset("article entry post story content body main text".split())  # words of an article's own header
LAYOUT = frozenset("no has with without".split())  # words that say what stands beside an element


@dataclass
class Line:
    text: str
    plain: int  # characters outside links
    scope: int  # the article or main element that holds it: its number, or -1
    heading: bool


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    scopes: list[str] = field(default_factory=list)  # names of the article and main elements


def attributes(rest: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ('"', "'") else value))
    return found


def aside(name: str, rest: str, in_article: bool, by_words: bool = True) -> str:
    """Why an element holds no article text: 'replies', 'never', 'other' (an article within it still does), or ''."""
    if name in NEVER or (name == "header" and not in_article):
        return "never"
    if name == "form":
        return "other"
    if not rest or name in ("html", "body"):
        return ""
    has = attributes(rest)
    if "hidden" in has or has.get("role", "").lower() in (ROLES - {"banner"} if in_article else ROLES):
        return "never"
    words = {w.lower() for value in (has.get("class", ""), has.get("id", "")) for w in PART.findall(value)}
    if not by_words or words & LAYOUT:
        return ""
    if words & REPLIES or (name == "article" and "teaser" in words):
        return "replies"
    if name in ("article", "main"):
        return ""
    return "other" if words & OTHER or (words & HEADERS and not words & OWN and not in_article) else ""


def lines_of(html: str, by_words: bool = True) -> Page:
    """Strip markup: the lines of a page in order, empty ones included, in one pass over the tags with a stack of open
    elements. by_words: words of class and id tell what is no article text."""
    page, at, pieces, links = Page(), 0, [], 0
    stack: list[tuple[str, str, int]] = []  # name, why it holds no article text, the scope around it
    opened: Counter[str] = Counter()
    scope, heading = -1, False

    def ended() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join("".join(x for x, _ in pieces).split())
            plain = sum(len(x) - x.count(" ") for x, linked in pieces if not linked)
            page.lines.append(Line(text, plain if text else 0, scope, heading))
            pieces = []
        elif gone() and page.lines and page.lines[-1].text:  # a window of empty lines stands for what is stripped
            page.lines += [Line("", 0, scope, False)] * WINDOW

    def gone() -> str:
        return stack[-1][1] if stack else ""

    def closed(name: str) -> None:
        nonlocal scope, links
        while stack:
            last, _, around = stack.pop()
            opened[last] -= 1
            links -= last == "a"
            if last in ("article", "main"):
                scope = around
            if last == name:
                return

    def add(text: str) -> None:
        if text and not gone():
            pieces.append((unescape(text), links > 0))

    while found := TAG.search(html, at):
        add(html[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            pieces.append((" ", False))
            continue
        if name in BLOCK:
            ended()
            heading = False
        if found["end"]:
            if opened[name]:
                closed(name)
            continue
        rest = found["rest"]
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = close.start() if close else len(html)
            continue
        if name in VOID:
            continue
        if name in BLOCK and opened["p"] and (name == "p" or name not in ("body", "html")):
            closed("p")
        if name in ("li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            closed(name)
        if rest.endswith("/") and name not in BLOCK:  # as in svg: <path/>
            continue
        inside = scope >= 0 and page.scopes[scope] == "article"
        why = aside(name, rest, inside, by_words)
        before = gone()
        if before and not (before == "other" and name in ("article", "main") and not why):
            why = before
        stack.append((name, why, scope))
        opened[name] += 1
        links += name == "a"
        heading = name in HEADING
        if name in ("article", "main") and not why and not inside:
            page.scopes.append(name)
            scope = len(page.scopes) - 1
    if at < len(html):
        add(html[at:])
    ended()
    return page


def window_sums(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The characters of each line and the window - 1 next ones."""
    total = np.concatenate([[0], np.cumsum(lengths), np.full(window, lengths.sum())])
    return total[window : window + len(lengths)] - total[: len(lengths)]


def stretches(lengths: np.ndarray, threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Surge and dive points: from a line whose window holds `threshold` characters, and is followed by one with text,
    to the next window without text. If no line surges, the line with the fullest window does."""
    blocks = window_sums(lengths, window)
    if not blocks.any():
        return []
    after = np.append(blocks[1:], 0)
    surge = np.flatnonzero((lengths > 0) & (blocks >= threshold) & ((after > 0) | (threshold <= 1)))
    if not len(surge):
        surge = np.array([int(np.argmax(np.where(lengths > 0, blocks, 0)))])
    dive = np.append(np.flatnonzero(blocks == 0), len(blocks))
    found, end = [], 0
    for start in surge.tolist():
        if start >= end:
            end = int(dive[np.searchsorted(dive, start)])
            found.append((start, end))
    return found


def main_text(html: str | None) -> tuple[str, int]:
    """The article's blocks joined by line feeds, and how many stretches it has. If words of class and id leave nothing
    (a wrapper of the whole page may bear one), elements and roles alone decide."""
    if not html:
        return "", 0
    found = chosen_text(lines_of(html))
    return found if found[0] else chosen_text(lines_of(html, by_words=False))


def chosen_text(page: Page) -> tuple[str, int]:
    size: Counter[int] = Counter()
    for line in page.lines:
        size[line.scope] += len(line.text)
    largest = lambda kind: max((s for s, k in enumerate(page.scopes) if k == kind and size[s]), key=lambda s: (size[s], -s), default=-1)
    chosen, around = largest("article"), largest("main")
    if around >= 0 and (chosen < 0 or size[chosen] < size[around]):
        chosen = around
    lines = page.lines
    if chosen >= 0:
        lengths = np.array([len(x.text) if x.scope == chosen else 0 for x in lines])
        kept = stretches(lengths, 1)
    else:
        lengths = np.array([x.plain for x in lines])
        kept = stretches(lengths, THRESHOLD)
        most = max((int(lengths[a:b].sum()) for a, b in kept), default=0)
        kept = [(a, b) for a, b in kept if lengths[a:b].sum() >= SHARE * most]
        kept = [(next((i for i in range(a, min(b, a + WINDOW)) if lines[i].heading and lines[i].text), a), b) for a, b in kept]
    return "\n".join(x.text for a, b in kept for x in lines[a:b] if x.text and (chosen < 0 or x.scope == chosen)), len(kept)


OUT = "page_id long, url string, text string, n_chars long, n_stretches int"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text, its code points and the number of its stretches, a row a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, "html")):
            found = [main_text(x.as_py()) for x in part.column(2)]
            columns = [part.column(0), part.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_stretches"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, OUT)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op11_line_blocks": op11}
SQL: dict[str, str] = {}
