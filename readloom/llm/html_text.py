"""Operator 7: main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of a page, with empty lines where containers begin and end. Each line
weighs as many characters as it has outside of links; lines in menus, adverts, notices, forms, comments and the like
weigh nothing and are never kept. Sums over sliding windows of lines give the distribution, which decides every page:
text starts where it surges over the threshold and ends where it dives to nothing.

Regions, which containers of several lines or of a heading with its text set apart, are kept by their share of the
heaviest one, and in them all stretches that surge. A mark around the article adds nothing to a line's weight. It does
three things: empty lines inside it do not count, as it is one text; a region outside of it is kept only if what is
inside would not be kept beside it; and where the whole article is too short to surge, the threshold is what its heaviest window holds.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Lines in a window, and the characters in it from which the text starts: the values of the published line-block method.
WINDOW = 3
SURGE = 86
#: The share of the heaviest region's weight from which another one is kept, and the lines that make a container count.
SHARE, CONTAINER_LINES = 0.25, 3

# Element names of HTML, by what they are to a reader.
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title"
CHROME = frozenset("nav header footer aside form button fieldset dialog menu head script style noscript template svg math iframe object textarea select title".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that name what is no article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer footers cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion widget widgets toolbar pagination pager contentinfo complementary skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
# Blocks that hold a run of text; in an article their names say nothing about comments.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption span".split())
CONTAINERS = BLOCKS - TEXT_BLOCKS - {"br", "hr", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "html", "body"}

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[a-z/!?](?:[^>"']|"[^"]*"|'[^']*')*+>|<[a-z/!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
NAME = re.compile(r"</?\s*([a-z][a-z0-9:-]*)", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def named_aside(tag: str, name: str) -> tuple[bool, bool]:
    """(the tag names what is no article, it names reader comments)."""
    words: set[str] = set()
    hidden = False
    for key, *values in ATTRIBUTE.findall(tag):
        value, key = "".join(values), key.lower()
        if key in ("class", "id", "role"):
            words |= {w.lower() for w in WORD.findall(value)}
        elif key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            hidden |= re.sub(r"\s", "", value.lower()).find("display:none") >= 0
    return hidden or (bool(words & ASIDE_WORDS) and name not in ("html", "body")), bool(words & COMMENT_WORDS)


class Element:
    __slots__ = ("name", "start", "end", "closed", "aside", "comments")

    def __init__(self, name: str, start: int, aside: bool, comments: bool):
        self.name, self.start, self.end, self.closed, self.aside, self.comments = name, start, -1, False, aside, comments


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(line, its characters outside of links, in the marked article, empty lines before it) of each block, in page order."""
    events: list = []
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            events.append(page[at : m.start()])
        at = m.end()
        tag = m.group()
        if m.group(1) or tag.startswith("<!--"):
            events.append(None)  # raw elements have no text of their own
        elif n := NAME.match(tag):
            events.append((n.group(1).lower(), tag))
    if at < len(page):
        events.append(page[at:])

    # Which elements are open where; an end tag without its start tag is skipped.
    elements: list[Element] = []
    open_now: list[Element] = []
    count: dict[str, int] = {}
    marks: list[int] = []
    for i, e in enumerate(events):
        if not isinstance(e, tuple):
            continue
        name, tag = e
        if tag[1] == "/":
            if count.get(name):
                while True:
                    x = open_now.pop()
                    count[x.name] -= 1
                    x.end = i
                    if x.name == name:
                        x.closed = True
                        break
        elif name not in VOID:
            aside, comments = named_aside(tag, name) if name in BLOCKS or name == "span" else (False, False)
            x = Element(name, i, name in CHROME or aside, comments)
            elements.append(x)
            if name == "p" and open_now and open_now[-1].name == "p":
                done = open_now.pop()
                count["p"] -= 1
                done.end, done.closed = i, True
            if not tag.endswith("/>"):
                open_now.append(x)
                count[name] = count.get(name, 0) + 1
            else:
                x.end, x.closed = i, True
            if name in ("article", "main") and not comments:
                marks.append(i)
    for x in open_now:
        x.end = len(events)

    articles = [(x.start, x.end) for x in elements if x.name in ("article", "main") and not x.comments and not (x.aside and x.name == "article")]
    inner = bytearray(len(events) + 1)
    for a, b in articles:
        inner[a + 1 : b] = b"\1" * (b - a - 1)
    drop = bytearray(len(events) + 1)
    for x in elements:
        if not x.aside:
            continue
        if inner[x.start] and (x.name == "header" or (x.comments and x.name in TEXT_BLOCKS)):
            continue  # an article's own heading, or a paragraph of it that is only named like a comment
        if not x.comments and any(x.start < k < x.end for k in marks):
            continue  # it wraps the article, so its name says something else
        end = x.end
        if not x.closed:  # never closed: it ends where other content starts
            end = next((k for k in range(x.start + 1, x.end) if isinstance(events[k], tuple) and events[k][0] in ("p", "h1", "h2", "section", "div", "article", "main") and events[k][1][1] != "/"), x.end)
        drop[x.start : end] = b"\1" * (end - x.start)

    out: list[tuple[str, int, bool]] = []
    spans: list[tuple[int, int]] = []  # the first and last event of each line
    parts: list[str] = []
    linked = links = first = last = 0
    kept_inside = False

    def close() -> None:
        nonlocal linked, kept_inside
        if parts:
            line = " ".join("".join(parts).split())
            if line:
                out.append((line, max(0, len(line) - linked), kept_inside))
                spans.append((first, last))
            parts.clear()
        linked, kept_inside = 0, False

    for i, e in enumerate(events):
        if isinstance(e, tuple):
            name, tag = e
            if name in BLOCKS:
                close()
            elif name == "a":
                links = 0 if tag[1] == "/" else 1
        elif e is not None and not drop[i]:
            text = html.unescape(e) if "&" in e else e
            first, last = first if parts else i, i
            parts.append(text)
            kept_inside |= bool(inner[i])
            if links:
                linked += len(" ".join(text.split()))
    close()
    return [(*line, gap) for line, gap in zip(out, gaps(elements, spans), strict=True)]


def gaps(elements: list[Element], spans: list[tuple[int, int]]) -> list[int]:
    """The empty lines before each line: where a container begins or ends, one, or a window's worth if it holds several
    lines or a heading with its text."""
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    heads = [x.start for x in elements if x.name in HEADINGS]
    before = [0] * (len(spans) + 1)
    for x in elements:
        if x.name in CONTAINERS:
            a, b = bisect_left(starts, x.start), bisect_left(ends, x.end)  # its lines
            headed = b - a > 1 and bisect_left(heads, x.start) < bisect_left(heads, x.end)
            size = WINDOW if b - a >= CONTAINER_LINES or headed else 1
            before[a] += size
            before[b] += size
    return before[:-1]


def surge_and_dive(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """The stretches [start, end) of lines that start where a window's sum reaches ``surge``, with the lines of the rise
    before it, and end where the windows hold nothing any more."""
    out: list[tuple[int, int]] = []
    n, i = len(weights), 0
    sums = [sum(weights[j : j + window]) for j in range(n)]
    while i < n:
        if weights[i] and sums[i] >= surge:
            j = i
            while j < n and sums[j] > 0:
                j += 1
            end = j
            while i > (out[-1][1] if out else 0) and weights[i - 1]:
                i -= 1
            while not weights[end - 1]:
                end -= 1
            out.append((i, end))
            i = j
        i += 1
    return out


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by line ends; empty if there is none.

    On a page without a marked article whose distribution never surges, all lines that weigh something are the text.
    """
    lines = lines_of(page)
    weights: list[int] = []
    at: list[int] = []  # the place of each line among lines and empty lines
    region: list[int] = []
    for k, (line, own, inside, gap) in enumerate(lines):
        joined = inside and k > 0 and lines[k - 1][2]
        weights += [0] * (0 if joined else gap)
        region.append((region[-1] if region else 0) + (k > 0 and not joined and gap >= WINDOW))
        at.append(len(weights))
        weights.append(own if own * 2 >= len(line) else 0)
    heavy: dict[int, int] = {}
    for k, r in enumerate(region):
        heavy[r] = heavy.get(r, 0) + weights[at[k]]
    marked = {region[k] for k, line in enumerate(lines) if line[2]}
    within, surge = max((heavy[r] for r in marked), default=0), SURGE
    if within:
        surge = min(SURGE, max(sum(weights[at[k] : at[k] + WINDOW]) for k, line in enumerate(lines) if line[2]))
    least = SHARE * max(heavy.values(), default=0)
    stretches = surge_and_dive(weights, surge=surge)
    good = [k for k, r in enumerate(region) if (heavy[r] >= least if r in marked or not within else heavy[r] * SHARE > within)]
    if within:  # of the region that holds the mark, what lies outside of it is no part of its text
        good = [k for k in good if lines[k][2] or region[k] not in marked]
    kept = [k for k in good if any(a <= at[k] < b for a, b in stretches)]
    return "\n".join(lines[k][0] for k in kept or [k for k in range(len(lines)) if weights[at[k]]])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row.

    Null or empty html gives an empty text, as do pages without an article; an empty table gives no rows; long pages
    are read whole; rows that repeat each give a row; null ids and urls pass through; other columns are not read.
    Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(x.as_py() or "") for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, with its length in code points."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
