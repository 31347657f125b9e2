"""Main text of web pages by line-block distribution.

Markup is stripped in one pass that keeps an open-element stack: block tags end
a line, inline tags do not, and text below boilerplate elements (menus,
headers, footers, sidebars, notices, adverts, forms, comments; told by tag,
role, class or id) is left out.

Lines that are more than half link text have length 0. Over the lines' lengths a window slides: a block of text runs from where its sums
surge to where they dive back to near 0, if they rise over a threshold between
(``SURGE`` characters, or half the page's largest sum where that is less). All
lines of a block are kept, in page order, links and words in names or not, and
the headings right before it; all lines outside the blocks go.

Lines of an article element are a block of their own, short ones included, as
long as the blocks outside hold no more than ``TRUST`` times its text: then the
page is its articles. An article beyond that is a teaser, and the blocks outside
it are the text.

Defined results: null and empty html, and pages of boilerplate alone, give "";
unclosed and stray tags, broken references and pages that end in the middle of
a tag are read as browsers do, leniently; repeated pages give repeated rows;
columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

WINDOW = 3
#: Characters in a window that make a block text; the share of them that is near 0.
SURGE, DIVE = 80, 0.1
#: So many times an article's text may stand in blocks outside of it.
TRUST = 2
#: Element names as HTML defines them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template iframe object svg canvas math textarea select button title audio video map".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu fieldset".split())
RAW_TEXT = frozenset("script style textarea title noscript iframe".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words in class, id or role that name boilerplate.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:ted|tion)?|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|aside|widget|header|masthead|topbar|footer|foot|colophon|copyright|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|form|search|share|sharing|social|related|recommended|comments?|commentlist|replies|reply|disqus|respond|"
    r"complementary|contentinfo|dialog|skip-link|toolbar|pagination|pager)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Those that an article's own parts are named by, too.
OF_ARTICLES = frozenset("header banner masthead notice alert search form foot aside promotion copyright overlay consent".split())
#: Names of several words that say boilerplate of a certain kind.
SURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsored|cookies?|gdpr|newsletter|subscribe|breadcrumbs?|navbar|sidebar|widget|disqus|commentlist|pagination|popup|modal|toolbar)(?:$|[\s_-])|"
    r"(?:^|\s)(?:share|sharing|social|related|recommended|comments?|nav|menu|site|page|login|search)[_-](?:buttons?|bar|box|links?|icons?|media|share|posts?|articles?|stories|news|list|form|section|area|menu|nav|footer|header|items?|container|wrapper)(?:$|\s)",
    re.IGNORECASE,
)
PARAGRAPHS = frozenset("p blockquote pre li dt dd td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED, BOILER = 1, 2
TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.DOTALL)
ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Line:
    text: str
    #: Characters but for white space, and those of them in links.
    chars: int
    link_chars: int
    boilerplate: bool
    #: Below an element whose name only holds a word for boilerplate.
    named: bool
    in_article: bool
    heading: bool


@dataclass
class Lines:
    """Lines under way: text pieces of the present one."""

    done: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link: int = 0

    def end(self, mark: int, in_article: bool, heading: bool) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.done.append(Line(" ".join(words), sum(map(len, words)), self.link, mark == BOILER, mark == NAMED, in_article, heading))
            self.parts, self.link = [], 0


def mark_of(name: str, attrs: str, in_article: bool) -> int:
    """BOILER for boilerplate wherever it stands, NAMED for what only its name hints at, else 0. A heading's name tells nothing, nor does the id of an article's section."""
    if name in BOILERPLATE or name == "header" and not in_article:
        return BOILER
    if not attrs or name in ("article", "main", "body", "html"):
        return 0
    own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return BOILER
    if name in HEADINGS:
        return 0
    role, classes, ident = (own.get(k, "").lower() for k in ("role", "class", "id"))
    words = [*role.split(), *classes.split()]
    if not (in_article and name == "section"):
        words.append(ident)
    names = [bool(NAMES.fullmatch(x)) and not (in_article and x in OF_ARTICLES) for x in words if x]
    # A paragraph of an article is boilerplate if nothing in its name says otherwise, other elements if one word says so.
    if (all if in_article and name in PARAGRAPHS else any)(names) and names:
        return BOILER
    if SURE.search(classes) or name != "section" and not in_article and SURE.search(ident):
        return BOILER
    hints = [classes] if name == "section" else [classes, ident]
    return NAMED if not in_article and any(NAMES.search(x) for x in hints) else 0


def strip_markup(page: str) -> list[Line]:
    lines, stack = Lines(), []  # stack: (name, mark from here on, hidden, article depth, in a heading)
    opened, solid = Counter(), []  # names on the stack; places there of elements that are not inline
    hidden = heading = False
    mark = article = links = at = 0

    def close(k: int) -> None:
        """Takes what is on the stack from place k on off it."""
        nonlocal mark, hidden, article, heading
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]
        while solid and solid[-1] >= k:
            solid.pop()
        mark, hidden, article, heading = stack[-1][1:] if stack else (0, False, 0, False)

    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not hidden:
            lines.parts.append(html.unescape(text))
            lines.link += sum(map(len, lines.parts[-1].split())) if links else 0
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        name, block = m["name"].lower(), m["name"].lower() not in INLINE
        if name == "br":
            if not hidden:
                lines.parts.append(" ")
            continue
        if block:
            lines.end(mark, article > 0, heading)
        if m["close"]:
            if name == "a":
                links = max(0, links - 1)
            if opened[name] > 0:  # else it closes nothing, and looking for it would cost the depth of the page
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in VOID or m["attrs"].endswith("/") and name in HIDDEN:
            continue
        if name == "a":
            links += 1
        elif block:
            if name in CLOSES_P:  # an open paragraph, and what is open in it, ends here
                if solid and stack[solid[-1]][0] == "p":
                    close(solid[-1])
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                close(len(stack) - 1)
            links = 0
        if name in RAW_TEXT:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        own = mark_of(name, m["attrs"], article > 0)
        if own > mark and not block:
            lines.end(mark, article > 0, heading)
        article += name in ("article", "main")
        mark, hidden, heading = max(mark, own), hidden or name in HIDDEN, heading or name in HEADINGS
        if block:
            solid.append(len(stack))
        opened[name] += 1
        stack.append((name, mark, hidden, article, heading))
    lines.end(mark, article > 0, heading)
    return lines.done


def blocks(lengths: list[int]) -> list[tuple[int, int]]:
    """First line of each surge and the line after its dive, of the sums over windows of WINDOW lines."""
    sums = [sum(lengths[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(lengths) + WINDOW - 1)]
    high = min(SURGE, max(sums, default=0) / 2)
    out, at = [], 0
    for above, run in groupby(sums, lambda x: x > high * DIVE):
        own = list(run)
        if above and max(own) >= high:
            out.append((at, at + len(own) - WINDOW + 1))
        at += len(own)
    return out


def bounds(lengths: list[int]) -> tuple[int, int]:
    """First line of the first surge and the line after the last dive."""
    found = blocks(lengths)
    return (found[0][0], found[-1][1]) if found else (0, 0)


def of_blocks(lines: list[Line]) -> list[int]:
    """Places of the lines between surges and dives, and of the headings right before them."""
    kept, last = [], 0
    for start, stop in blocks([len(x.text) if not x.named and 2 * x.link_chars <= x.chars else 0 for x in lines]):
        while start > last and lines[start - 1].heading:
            start -= 1
        last = stop
        kept += range(start, stop)
    return kept


def main_text(page: str) -> str:
    lines = [x for x in strip_markup(page) if not x.boilerplate]
    size = lambda x: sum(len(y.text) for y in x)
    article = [x for x in lines if x.in_article]
    between = [lines[k] for k in of_blocks(lines)]
    if size(article) * TRUST >= size([x for x in between if not x.in_article]) and article:
        return "\n".join(x.text for x in article)
    if article:  # a teaser: what it says is no measure of the page
        rest = [x for x in lines if not x.in_article]
        between = [rest[k] for k in of_blocks(rest)]
    return "\n".join(x.text for x in between)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h or "") for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
