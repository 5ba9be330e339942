"""Attribute values and their canonical JSON.

A value is None (empty), StringIndex, str, bool, int, float, bytes, a list (array) or Pairs (a map that keeps order and
repeats of its keys).
"""

from __future__ import annotations

import base64
import json
import math
import re

MAX_DEPTH = 64


class Pairs(list):
    """(key, value) entries of a map, as they came."""


class StringIndex(int):
    """A reference into a string table that is not there; it reads as null."""


class TooDeep(ValueError):
    """Values nest deeper than MAX_DEPTH."""


def canonical(value) -> str:
    """Canonical JSON: keys in the order of their UTF-8 bytes, the last of repeats, no blanks; bytes and non-finite numbers are tagged."""
    return written(plain(value, 0))


def canonical_attributes(pairs) -> str:
    return written(plain_map(pairs, 0))


def plain(value, depth: int):
    """The value in JSON's terms."""
    if depth >= MAX_DEPTH:
        raise TooDeep(f"values nest deeper than {MAX_DEPTH} levels")
    if value is None or isinstance(value, StringIndex):
        return None
    if isinstance(value, Pairs):
        return plain_map(value, depth + 1)
    if isinstance(value, list):
        return [plain(x, depth + 1) for x in value]
    if isinstance(value, bytes):
        return {"$bytes": base64.b64encode(value).decode()}
    if isinstance(value, float) and not math.isfinite(value):
        return {"$float": "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"}
    return value


def plain_map(pairs, depth: int) -> dict:
    return {k: plain(v, depth) for k, v in pairs}


def written(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{text(k)}:{written(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(written, value)) + "]"
    if isinstance(value, float):
        return number(value)
    return text(value) if isinstance(value, str) else json.dumps(value)


def text(value: str) -> str:
    return json.dumps(value, ensure_ascii=False)


def number(value: float) -> str:
    """The shortest decimal that reads back as the same double: plain from 0.00001 to below 1e16, with an exponent beyond."""
    found = re.fullmatch(r"(-?)(\d)(?:\.(\d+))?e([+-])(\d+)", repr(value))
    if not found:
        return repr(value)
    sign, head, tail, direction, exponent = found.groups()
    if direction == "-" and int(exponent) == 5:
        return f"{sign}0.0000{head}{tail or ''}"
    return f"{sign}{head}{'.' + tail if tail else ''}e{'-' if direction == '-' else ''}{int(exponent)}"
