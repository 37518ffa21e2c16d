"""Main text of web pages by line-block distribution.

Markup is stripped in one pass: each block of text becomes a line; what stands in menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments leaves no line, nor do blanks between
tags. A line weighs as many characters as it has outside links. The text dives where a whole block of
BLOCK lines on end weighs nothing, and surges in a stretch between two dives if a block's sum reaches
SURGE characters (or the page's highest sum, if that is less). All lines from the first stretch that
surges to the end of the last one are kept, light lines and links among them too. Where a page marks its
article and the heaviest block lies in it, the body is sought among the article's lines only, and their links weigh as text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 3
SURGE = 80

#: What a tag has after its name: a quote opens a value only behind '='; where it never closes, the tag ends at the next '>'.
_REST = r"(?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
_REST_CLOSED = r"(?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>/]|/(?!>))*+/>"
_EXACT = r"(?![^\s/>])"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:svg|math){_EXACT}{_REST_CLOSED}"
    rf"|<(script|style|noscript|template|textarea|iframe|svg|select|title|object|canvas|math){_EXACT}{_REST}>.*?(?:</\1{_EXACT}[^>]*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_REST})(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Elements that start a new line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where the next block starts or their parent ends.
LOOSE = frozenset("p li dt dd td th tr option thead tbody tfoot".split())
#: Elements that never hold the main text.
DROPPED = frozenset("nav footer aside form button menu dialog label fieldset datalist audio video map head".split())
#: Parts of class names and ids of what isn't the main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner "
    "sidebar aside widget widgets nav navbar navigation menu menus submenu breadcrumb breadcrumbs topbar toolbar header "
    "masthead footer colophon copyright comment comments commentlist disqus respond reply replies notice notices cookie "
    "cookies consent gdpr alert newsletter subscribe subscription signup login popup modal overlay share sharing social "
    "related recommended recommendations pagination pager search searchform skip".split()
)
#: Words beside a mark in a name that still leave the name one of its kind: places, sizes, containers.
PLAIN = frozenset(
    "a area areas article articles bar base block blocks body bottom box boxes btn button buttons card col column container content cta desktop "
    "fixed float fluid for form full global grid group head holder home icon icons image img in inline inner item items js label large layer "
    "layout left line link links list lists logo main mini mobile module news of on outer page pages panel part parts position post posts "
    "primary right row secondary section sections side site slot small space static sticky story stories sub tab tabs tag tags text the title top "
    "unit view wide wp wrap wrapper zone".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
ROOTS = frozenset("html body main".split())
PARTS = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    """Does this element hold no main text? An article's own header may."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ROOTS:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for word in value.split():
                parts = [x for part in PARTS.split(word) if (x := part.lower().strip("0123456789"))]
                if MARKS.intersection(parts) and all(x in MARKS or x in PLAIN for x in parts):
                    return not (in_article and tag == "header")
        elif name == "role" and value.lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def strip_markup(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """Lines of a page as (text, characters outside links, in an article), and whether it marks an article."""
    lines: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked = 0
    open_tags: list[tuple[str, bool]] = []  # each with: dropped, itself or by what it stands in
    places: dict[str, list[int]] = defaultdict(list)  # where in open_tags each name stands
    blocks: list[int] = []  # where the blocks stand
    articles = links = 0
    marked = False

    def flush() -> None:
        nonlocal linked
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append((line, max(0, len(line) - linked), articles > 0))
        linked = 0

    def leave(to: int) -> None:
        nonlocal articles, links
        while len(open_tags) > to:
            tag, _ = open_tags.pop()
            places[tag].pop()
            if tag in BLOCKS:
                blocks.pop()
            articles -= tag in ("article", "main")
            links -= tag == "a"

    for m in TOKEN.finditer(page):
        words = m[5]
        if words is not None:
            if not (open_tags and open_tags[-1][1]):
                text.append(words)
                linked += len(words) if links else 0
            continue
        if m[3] is None:
            if m[1]:
                text.append(" ")
            continue
        tag, closes = m[3].lower(), m[2] == "/"
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if closes:
            # an inline end tag doesn't reach over blocks
            if places[tag] and (tag in BLOCKS or not blocks or places[tag][-1] > blocks[-1]):
                leave(places[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            while open_tags and open_tags[-1][0] not in BLOCKS:  # inline elements left open
                leave(len(open_tags) - 1)
            if tag in LOOSE or tag not in ("table", "ul", "ol", "dl", "div", "section", "article", "main"):
                while open_tags and (open_tags[-1][0] == "p" or (open_tags[-1][0] == tag and tag in LOOSE)):
                    leave(len(open_tags) - 1)
            elif open_tags and open_tags[-1][0] == "p":
                leave(len(open_tags) - 1)
        dropped = bool(open_tags and open_tags[-1][1]) or is_boilerplate(tag, m[4], articles > 0)
        places[tag].append(len(open_tags))
        if tag in BLOCKS:
            blocks.append(len(open_tags))
        open_tags.append((tag, dropped))
        if tag in ("article", "main"):
            articles += 1
            marked |= not dropped
        links += tag == "a"
    flush()
    return lines, marked


def main_text(page: str | None) -> str:
    """The kept blocks, joined by an empty line."""
    lines, marked = strip_markup(page or "")
    article = [line for line in lines if line[2]] if marked else []
    if article and len(article) < len(lines):
        heaviest = max(range(len(lines)), key=lambda i: sum(w for _, w, _ in lines[i : i + BLOCK]))
        # a marked part that the heaviest block lies beside isn't the article
        article = article if any(inside for _, _, inside in lines[heaviest : heaviest + BLOCK]) else []
    if article:
        lines = article
    weights = [len(line) if article else w for line, w, _ in lines]
    n = len(lines)
    sums = [sum(weights[i : i + BLOCK]) for i in range(n)]
    surge = min(SURGE, max(sums, default=0))
    if not surge:
        return ""
    stretches, at = [], 0
    while at < n:
        stop, light = at, 0
        while stop < n and light < BLOCK:  # until a whole block is empty: dive
            light = 0 if weights[stop] else light + 1
            stop += 1
        end = stop - light if light == BLOCK else stop
        if max(sums[at:end], default=0) >= surge:
            stretches.append((at, end))
        at = stop
        while light >= BLOCK and at < n and not weights[at]:
            at += 1
    return "\n\n".join(line for line, _, _ in lines[stretches[0][0] : stretches[-1][1]])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars. Rows are independent: no shuffle.

    Defined results: a null or empty page, and one without main text, has the text ''; null ids and urls
    stay null, and repeated rows each have their own result; pages of any length take time in proportion to it; unclosed or cut-off markup ends with its parent or the page; other columns are not looked at.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
