"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. Then three finite-state
transducers, one after another, rewrite disguised stretches (look-alike letters;
spelled digits; "at" and "dot") into plain ones while they keep, for each
character they write, the source characters it came from; the same detectors run
over the result and their spans are mapped back. A transducer reads the text's
tokens once, in a bounded number of states, so time grows with the text and with
nothing else. A text without anything that they would rewrite costs one more
search. All offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, map_texts

KINDS = ("email", "ip", "card", "phone")
#: A match of the base pattern always begins at the start of a run of digits and takes runs whole; said so, no run is read twice.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")

#: Letters that look like Latin ones, and what they look like.
LOOK_ALIKES = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρ＠﹫．。｡․﹒‐‑‒–−",
        "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXovap@@.....-----",
        strict=False,
    )
)
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
INVISIBLE = "​‌‍⁠﻿­"


@lru_cache(maxsize=1)
def look_alikes() -> dict[str, str]:
    """Every look-alike character and its ASCII form; invisible ones vanish."""
    table = dict(LOOK_ALIKES)
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in (*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x1D7CE, 0x1D800), *range(0x2460, 0x2469)):
        table[chr(c)] = str(unicodedata.digit(chr(c)))
    for c in range(0x1D400, 0x1D6A4):
        if (plain := unicodedata.normalize("NFKC", chr(c))).isascii() and plain.isalnum():
            table[chr(c)] = plain
    return table | dict.fromkeys(INVISIBLE, "")


@lru_cache(maxsize=1)
def odd_chars() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, look_alikes())) + "]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The spans of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from the @ outward."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, free := m.end()))
        at = text.find("@", max(at + 1, free))
    return out


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of identifiers in a text as it stands, by kind and start."""
    out = [(0, a, z) for a, z in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


# Disguises ---------------------------------------------------------------

DIGITS = "(?:" + "|".join(DIGIT_WORDS) + ")"
#: Tokens of the digit transducer: letters, digits, a gap, a mark; anything else ends what it reads.
DIGIT_TOKEN = re.compile(r"([A-Za-z]+)|([0-9]+)|([\s,-]+)|([.()\[\]{}+])|[^A-Za-z0-9\s,.()\[\]{}+-]+")
#: Tokens of the mark transducer: a name, blanks, @ or a full stop, an opening bracket; anything else ends what it reads.
MARK_TOKEN = re.compile(r"([A-Za-z0-9_%+-]+)|(\s+)|([@.])|([\[({<])|[^A-Za-z0-9_%+\s@.\[({<-]+")
BRACKETED = re.compile(r"(?i)[\[({<]\s*+(at|dot|\.)\s*+[\])}>]")
OPENING, CLOSING = "[({", "])}"


#: What every stretch that the transducers change contains, look-alikes apart: a spelled digit, a bracketed at or dot, a dot word
#: between blanks, or an @ beside one. It reads letters as they do, so that it misses nothing they would rewrite.
TRIGGER = re.compile(rf"(?i)\b{DIGITS}\b|[\[({{<]\s*(?:at|dot|\.)\s*[\])}}>]|\sdot\s|\s@|@\s")


class Rewritten:
    """A text written from a source, with where each of its characters begins and ends there."""

    def __init__(self, text: str, starts: array, ends: array):
        self.text, self.starts, self.ends = text, starts, ends

    def back(self, a: int, z: int) -> tuple[int, int]:
        return self.starts[a], self.ends[z - 1]


def rewrite(source: Rewritten, pieces: list[tuple[int, int, str]]) -> Rewritten:
    """Puts replacements (start, end, text), in order and apart, into a rewritten text; each new character stands for the whole stretch."""
    out, starts, ends, at = [], array("q"), array("q"), 0
    for a, z, new in pieces:
        out += (source.text[at:a], new)
        starts += source.starts[at:a]
        ends += source.ends[at:a]
        if a < z:
            starts += source.starts[a : a + 1] * len(new)
            ends += source.ends[z - 1 : z] * len(new)
        at = z
    out.append(source.text[at:])
    return Rewritten("".join(out), starts + source.starts[at:], ends + source.ends[at:])


def plain(text: str) -> Rewritten:
    return Rewritten(text, array("q", range(len(text))), array("q", range(1, len(text) + 1)))


def without_look_alikes(source: Rewritten) -> Rewritten:
    table = look_alikes()
    return rewrite(source, [(m.start(), m.end(), table[m[0]]) for m in odd_chars().finditer(source.text)])


def in_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def spoken_digits(source: Rewritten) -> Rewritten:
    """In stretches of digits of which some are spelled, these become digits, plus and dot become marks, and the gaps go.

    A stretch is [plus] number (gap number)*, a number a word of DIGIT_WORDS or a run of digits, a gap blanks, commas and
    hyphens with at most one mark (dot, a bracketed dot, or one of . and round brackets) among them.
    """
    text = source.text
    pieces: list[tuple[int, int, str]] = []
    stretch: list[tuple[int, int, str | None]] = []  # its tokens and what they become, None where they stay
    numbers = spelled = skip = 0
    mark = plus = None  # waiting for the number behind them

    def end() -> None:
        nonlocal numbers, spelled, mark, plus
        if spelled and numbers > 1:
            at = stretch[0][0]
            for a, z, new in stretch:
                if at < a:
                    pieces.append((at, a, ""))
                if new is not None:
                    pieces.append((a, z, new))
                at = z
        stretch.clear()
        numbers = spelled = 0
        mark = plus = None

    for m in DIGIT_TOKEN.finditer(text):
        a, z = m.span()
        if a < skip:
            continue
        kind = m.lastindex
        if kind == 3:
            if plus and "," in m[0]:
                plus = None
            continue
        new = None
        if kind == 1:
            word = m[0].lower()
            if (word in DIGIT_WORDS or word in ("dot", "plus")) and not (a and in_word(text[a - 1]) or z < len(text) and in_word(text[z])):
                new = DIGIT_WORDS.get(word) or ("." if word == "dot" else "+")
        if kind == 2 or new is not None and new.isdigit():
            if not stretch and plus:
                stretch.append(plus)
            elif mark:
                stretch.append(mark)
            mark = plus = None
            stretch.append((a, z, new))
            numbers, spelled = numbers + 1, spelled + (new is not None)
            continue
        if kind == 4:
            if text[a] in OPENING and text[a + 1 : a + 4].lower() == "dot" and text[a + 4 : a + 5] and text[a + 4] in CLOSING:
                new, z = ".", a + 5
                skip = z
            elif text[a] in ".()":
                new = ""
        if kind == 4 and text[a] == "+" or new == "+":
            end()
            plus = a, z, new
        elif new is None or mark or not stretch:
            end()
        else:
            mark = a, z, new or None
    end()
    return rewrite(source, pieces) if pieces else source


def spoken_marks(source: Rewritten) -> Rewritten:
    """In addresses at becomes @ and dot a full stop, without the blanks around them; so does dot between digits.

    Names and marks in turn make a chain. A mark is @, at in brackets, at between blanks, or a full stop, dot or a full
    stop in brackets, dot between blanks. In a chain an address is name (dot name)* at name (dot name)+, the leftmost
    first; behind an at between blanks one dot must be hidden, for prose has "at" before plain names of sites.
    """
    text = source.text
    pieces: list[tuple[int, int, str]] = []
    marks: list[tuple[str, int, int]] = []  # of the chain, each followed by a name, but for the last perhaps
    names = 0
    gap = -1  # where blanks begin that may belong to a mark

    def end() -> None:
        nonlocal names
        if names > 1:
            rewrite_chain(text, marks[: names - 1], pieces)
        marks.clear()
        names = 0

    def put(what: str, a: int, z: int) -> None:
        if names == len(marks) + 1:
            marks.append((what, a, z))
        else:
            end()

    skip = 0
    for m in MARK_TOKEN.finditer(text):
        a, z = m.span()
        if a < skip:
            continue
        kind = m.lastindex
        if kind == 2:
            if names and names == len(marks) and marks[-1][0] != ".":
                marks[-1] = marks[-1][0], marks[-1][1], z
            else:
                gap = a
            continue
        before, gap = gap, -1
        word = m[0].lower() if kind == 1 and z - a <= 3 else ""
        if word in ("at", "dot") and a and text[a - 1].isspace() and z < len(text) and text[z].isspace():
            put(word, before if before >= 0 else a, z)
        elif kind == 1:
            if before >= 0 or names > len(marks):
                end()
            names += 1
        elif kind == 3 and text[a] == "@":
            put("@", before if before >= 0 else a, z)
        elif kind == 3 and before < 0:
            put(".", a, z)
        elif kind == 4 and (b := BRACKETED.match(text, a)):
            put("@" if b[1].lower() == "at" else "dot", before if before >= 0 else a, b.end())
            skip = b.end()
        else:
            end()
    end()
    return rewrite(source, pieces) if pieces else source


def rewrite_chain(text: str, marks: list[tuple[str, int, int]], pieces: list[tuple[int, int, str]]) -> None:
    """Adds the replacements of one chain. Mark j stands between the names j and j + 1."""
    plain_marks = {}
    ats = [j for j, (what, _, _) in enumerate(marks) if what in ("@", "at")]
    free = 0  # the first name that no address has
    for n, j in enumerate(ats):
        first = max(free, ats[n - 1] + 1 if n else 0)
        last = ats[n + 1] if n + 1 < len(ats) else len(marks)
        dots = range(j + 1, last)
        if first <= j and dots and (marks[j][0] == "@" or any(marks[d][0] == "dot" for d in dots)):
            plain_marks[j] = "@"
            plain_marks |= dict.fromkeys((*range(first, j), *dots), ".")
            free = last + 1
    for j, (what, a, z) in enumerate(marks):
        if what == "dot" and j not in plain_marks and text[a - 1] in "0123456789" and text[z] in "0123456789":
            plain_marks[j] = "."
    pieces.extend((marks[j][1], marks[j][2], new) for j, new in sorted(plain_marks.items()) if text[marks[j][1] : marks[j][2]] != new)


def hidden_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of disguised identifiers that no base span of their kind covers."""
    odd = not text.isascii() and not look_alikes().keys().isdisjoint(set(text))  # a search for so many characters is far slower
    if not odd and not TRIGGER.search(text):
        return []
    out = set()
    now = plain(text)
    if odd:
        now = without_look_alikes(now)
    now = spoken_marks(spoken_digits(now))
    for kind, a, z in plain_spans(now.text):
        start, end = now.back(a, z)
        if now.text[a:z] != text[start:end]:  # else the base rules have judged it
            out.add((kind, start, end))
    # base spans of a kind lie apart and in order, so only the last that begins no later can cover one
    return [x for x in sorted(out) if not (n := bisect_right(base, (x[0], x[1], len(text)))) or base[n - 1][0] != x[0] or base[n - 1][2] < x[2]]


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each as (index into KINDS, start, end) sorted by kind, then start."""
    base = plain_spans(text)
    return base, sorted({*base, *hidden_spans(text, base)})


def spelled_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


def redact(text: str) -> str:
    """The text with each stretch of personal data replaced by its kind in capitals and brackets; stretches that overlap become one, named by the first."""
    merged: list[list] = []
    for a, z, k in sorted((a, z, k) for k, a, z in find(text)[1]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z, k])
    out, at = [], 0
    for a, z, k in merged:
        out += (text[at:a], f"[{KINDS[k].upper()}]")
        at = z
    return "".join((*out, text[at:])) if merged else text


def find_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts of base spans by kind, counts with disguised ones, base_sha256 and all spans.

    Null and empty texts have no spans; spans of different kinds may overlap and are all listed; rows that repeat come out
    as often; time and memory grow with the longest text in proportion; an empty table gives an empty one; other columns
    are not read; no shuffle.
    """

    def rows(ids, texts):
        out: dict[str, list] = {"doc_id": ids, "base_sha256": [], "spans": []} | {f"n_{k}": [] for k in KINDS} | {f"n_{k}_all": [] for k in KINDS}
        for text in texts:
            base, spans = find(text)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(x[0] == k for x in base))
                out[f"n_{name}_all"].append(sum(x[0] == k for x in spans))
            out["base_sha256"].append(hashlib.sha256(spelled_out(base).encode()).hexdigest())
            out["spans"].append(spelled_out(spans))
        return out

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_texts(docs, id_col, text_col, rows, f"doc_id bigint, {counts}, base_sha256 string, spans string, {counts.replace(' bigint', '_all bigint')}")


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with redact() applied to each text, and length_col, where docs have it, set to the new length; null texts stay null, with a null length."""
    names = set(docs.columns)

    def change(texts):
        new = [None if t is None else redact(t) for t in texts]
        out = {text_col: pa.array(new, type=pa.string())}
        if length_col in names:
            out[length_col] = pa.array([None if t is None else len(t) for t in new], type=pa.int64())
        return out

    return map_rows(docs, text_col, change)
