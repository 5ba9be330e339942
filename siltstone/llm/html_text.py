"""Main text of web pages by two-pass block rules.

A page falls into blocks at block-level tags. Template parts are out. Pass one
decides every other block of every page from its length, link density and share of
stop words; short blocks stay open. An article or main element is evidence only:
what stands in it is not out for want of stop words but stays open. Pass two gives
an open block the label of its nearest decided neighbours on its side of the
article's bounds: both, or the one they agree on, and headings look ahead to the
text they head. The bounds count as good on the inside and as bad outside.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .quality_rules import STOP_WORDS

ATTRIBUTES = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
COMMENT = r"<(?:!--.*?(?:-->|\Z)"
REST = r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)(?:>|(?=<)|\Z)|[!?][^>]*+>)"
#: A comment, a tag whose quoted values may hold anything, a tag cut short, or a declaration.
TOKEN = re.compile(rf"{COMMENT}|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({ATTRIBUTES})>|{REST}", re.S)
#: The same where quotes mean nothing.
LOOSE_TOKEN = re.compile(rf"{COMMENT}|(?!)()()()|{REST}", re.S)
#: Quotes that never end make each tag read the page to its end; from so many tags cut short on, quotes of a page mean nothing.
CUT_SHORT = 100
#: Elements whose content is never text of the page; it ends at their own end tag and holds no other tags.
RAW = frozenset("script style template textarea title iframe svg math select button object canvas video audio noembed noframes xmp noscript datalist".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Blocks that others can stand in, so that their ends matter.
NESTING = BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6 html body".split())
#: Ends of these close what is open inside, but never one of these.
STRONG = frozenset("article main nav header footer aside form section div body table".split())
TEMPLATE = frozenset("head nav aside footer form menu dialog".split())
CELLS = frozenset("td th".split())
LISTS = frozenset("ul ol menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Words in class, id or role that name template parts.
PARTS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promoted promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies related recommended "
    "recommendations widget pagination pager skip search complementary contentinfo tags tagcloud".split()
)
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
GOOD, BAD, OPEN = 1, 0, -1
#: Limits of pass one.
SHORT_CHARS, LONG_CHARS, LOW_STOP, HIGH_STOP, MAX_LINK = 70, 160, 0.08, 0.15, 0.33


class Block:
    __slots__ = ("chars", "heading", "inside", "linked", "listed", "out", "stop", "text", "words")

    def __init__(self, text: str, linked: int, inside: bool, out: bool, tag: str, listed: bool):
        words = text.split()
        self.text, self.inside, self.out, self.heading, self.listed = text, inside, out, tag in HEADINGS, listed
        self.chars, self.words, self.linked = len(text), len(words), min(linked, len(text))
        self.stop = sum(w.lower().strip(".,;:!?") in STOP_WORDS for w in words)


def named_part(attributes: str) -> bool:
    """Whether an element's attributes say that it is a template part or hidden."""
    if "=" not in attributes:
        return " hidden" in f" {attributes.lower()} ".replace("/", " ") and "hidden" in attributes.lower().split()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role") and not PARTS.isdisjoint(x.lower() for x in NAME_PARTS.findall(value)):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", ATTRIBUTE.sub("", attributes), re.I))


class Open:
    """The elements that are open: of each its tag, whether it is out, whether it is in an article, how many lists it is in.

    The places of each tag and of the strong tags are kept beside, so that an end tag finds its start without a search.
    """

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, int]] = []
        self.places: dict[str, list[int]] = {}
        self.strong: list[int] = []

    def top(self) -> tuple[str, bool, bool, int]:
        return self.stack[-1] if self.stack else ("", False, False, 0)

    def push(self, tag: str, out: bool, inside: bool) -> None:
        at = len(self.stack)
        self.places.setdefault(tag, []).append(at)
        if tag in STRONG:
            self.strong.append(at)
        self.stack.append((tag, out, inside, self.top()[3] + (tag in LISTS)))

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in STRONG:
                self.strong.pop()

    def end(self, tag: str) -> None:
        """Closes the last element of a tag and what is open in it; ends of other than strong elements do not reach beyond a strong one."""
        places = self.places.get(tag)
        if places and (tag in STRONG or not self.strong or places[-1] > self.strong[-1]):
            self.cut(places[-1])


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order. Time grows with the page, however deep its elements nest."""
    found: list[Block] = []
    now = Open()
    pieces: list[str] = []
    linked = at = short = 0
    link = False
    tag = ""
    token = TOKEN

    def close() -> None:
        nonlocal linked, tag
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                _, out, inside, lists = now.top()
                found.append(Block(text, linked, inside, out, tag, lists > 0))
            pieces.clear()
        linked = 0
        tag = ""

    def say(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if link:
                linked += len(" ".join(html.unescape(text).split()))

    end = len(page)
    while at < end:
        m = token.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        if m[5]:
            short += 1
            if short > CUT_SHORT:
                token = LOOSE_TOKEN
        name = name.lower()
        closing = bool(m[1] or m[4])
        if name in RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                stop = RAW_END[name].search(page, at)
                at = stop.end() if stop else end
            pieces.append(" ")
        elif name == "a":
            link = not closing
        elif name == "br" or name in CELLS:
            pieces.append(" ")
        elif name in BLOCKS:
            close()
            link = False
            if name == "body" and not closing:
                now.end("head")
            if name in NESTING:
                if closing:
                    now.end(name)
                else:
                    if name in ("li", "dt", "dd", "tr") and now.top()[0] == name:
                        now.cut(len(now.stack) - 1)
                    _, out, inside, _ = now.top()
                    attributes = m[3] or m[6] or ""
                    main = name in ("article", "main") or "role" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes) is not None
                    out = out or name in TEMPLATE or name == "header" and not inside or bool(attributes) and named_part(attributes)
                    now.push(name, out, (inside or main) and not out)
            if not closing:
                tag = name
    close()
    return found


def first_pass(found: list[Block]) -> list[int]:
    labels = []
    for b in found:
        if b.out:
            labels.append(BAD)
        elif b.linked / b.chars > MAX_LINK:
            labels.append(OPEN if b.inside and not b.listed else BAD)
        elif b.heading or b.chars < SHORT_CHARS:
            labels.append(OPEN)
        else:
            share = b.stop / b.words
            label = GOOD if share >= HIGH_STOP or share >= LOW_STOP and b.chars >= LONG_CHARS else OPEN if share >= LOW_STOP else BAD if b.chars >= LONG_CHARS else OPEN
            labels.append(OPEN if b.inside and label == BAD else label)
    return labels


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Open blocks take the label that their nearest decided neighbours share, of those that stand in an article as they do, or not in one as they do not.

    Where those differ, a heading takes that of the next, others that of the nearer one; the edge counts as good in an article, else as bad.
    """
    out = list(labels)
    for inside, edge in ((True, GOOD), (False, BAD)):
        at = [i for i, b in enumerate(found) if b.inside == inside]
        for i, label in zip(at, from_neighbours([found[i] for i in at], [labels[i] for i in at], edge), strict=True):
            out[i] = label
    return out


def from_neighbours(found: list[Block], labels: list[int], edge: int) -> list[int]:
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if labels[i - 1] != OPEN else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if labels[i + 1] != OPEN else after[i + 1]
    out = list(labels)
    for i, label in enumerate(labels):
        if label == OPEN:
            a = labels[before[i]] if before[i] >= 0 else edge
            z = labels[after[i]] if after[i] < n else edge
            out[i] = a if a == z else z if found[i].heading else a if i - before[i] < after[i] - i else z if i - before[i] > after[i] - i else GOOD
    return out


def extract(page: str) -> str:
    """The page's main text: its blocks, white space collapsed, joined by line feeds."""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, second_pass(found, first_pass(found)), strict=True) if keep == GOOD)


def extract_all(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text and n_chars, one row for each row of pages; no shuffle.

    Null or empty pages and pages without main text give an empty text; text without any tags is one block; tags that are
    never closed end with the page. A block as near to a good neighbour as to a bad one is good. Time and memory grow with
    the longest page in proportion, however deep it nests. Rows that repeat come out as often; an empty table gives an
    empty one.
    """

    def rows(keys, pages):
        out = [extract(p) for p in pages]
        return {"page_id": [k["i"] for k in keys], "url": [k["u"] for k in keys], "text": out, "n_chars": [len(t) for t in out]}

    keyed = pages.select(F.struct(F.col(id_col).alias("i"), F.col(url_col).alias("u")).alias("key"), F.col(html_col).alias("page"))
    return map_texts(keyed, "key", "page", rows, "page_id bigint, url string, text string, n_chars bigint")
