"""Columns discovered from attributes: flattening, names, collisions and caps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import types as T

from .blake3 import hexdigest
from .values import Pairs, StringIndex, canonical

#: Sources and kinds with their tags in a name's digest, kinds with their Spark types.
SOURCES = {"resource": 1, "scope": 2, "log": 3}
KINDS = {"bool": 1, "i64": 2, "f64": 3, "string": 4, "bytes": 5, "json": 6}
TYPES = {"bool": T.BooleanType(), "i64": T.LongType(), "f64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "json": T.StringType()}
HEX = 8


class Identity(NamedTuple):
    """Where a value came from and what it is; tags order like the sources and kinds themselves."""

    source: str
    path: tuple[str, ...]
    kind: str

    def key(self) -> tuple:
        return SOURCES[self.source], self.path, KINDS[self.kind]

    @property
    def base_name(self) -> str:
        return "_".join((self.source, *map(normal, self.path), self.kind))

    @property
    def digest(self) -> str:
        parts = [s.encode() for s in self.path]
        sized = b"".join(len(p).to_bytes(8, "big") + p for p in parts)
        return hexdigest(bytes([SOURCES[self.source]]) + len(parts).to_bytes(8, "big") + sized + bytes([KINDS[self.kind]]))


def normal(segment: str) -> str:
    """Lower case; whatever is not an ASCII letter or digit becomes an underscore."""
    return "".join(c if c.isascii() and c.isalnum() else "_" for x in segment for c in x.lower())


def kind_of(value) -> str:
    for kind, types in (("bool", bool), ("i64", int), ("f64", float), ("string", str), ("bytes", bytes)):
        if isinstance(value, types):
            return kind
    return "json"


def flatten(source: str, pairs: Iterable[tuple], max_depth: int) -> dict[Identity, object]:
    """The leaves of an attribute list. A later key deletes what an earlier one of the same path, or below it, left."""
    def tree(pairs, depth: int) -> dict:
        """By key a (kind, value), or a tree of what lies below it."""
        out: dict = {}
        for key, value in pairs:
            out.pop(key, None)
            if value is None or isinstance(value, StringIndex):
                continue
            if isinstance(value, Pairs) and depth < max_depth:
                out[key] = tree(value, depth + 1)
            elif isinstance(value, list):
                out[key] = "json", canonical(value)
            else:
                out[key] = kind_of(value), value
        return out

    def leaves(tree: dict, path: tuple[str, ...]) -> Iterator[tuple[Identity, object]]:
        for key, found in tree.items():
            if isinstance(found, dict):
                yield from leaves(found, (*path, key))
            else:
                yield Identity(source, (*path, key), found[0]), found[1]

    return dict(leaves(tree(pairs, 0), ()))


def names(identities: Iterable[Identity]) -> dict[Identity, str]:
    """A column name for each identity. All that share a base name get as much of their digest as tells them apart, eight characters at a time."""
    groups: dict[str, list[Identity]] = {}
    for i in sorted(set(identities), key=Identity.key):
        groups.setdefault(i.base_name, []).append(i)
    out = {}
    for base, members in groups.items():
        if len(members) == 1:
            out[members[0]] = base
            continue
        digests = [m.digest for m in members]
        width = next(w for w in range(HEX, 65, HEX) if len({d[:w] for d in digests}) == len(digests))
        out |= {m: f"{base}__{d[:width]}" for m, d in zip(members, digests, strict=True)}
    return out


def admitted_by_frame(found: Iterable[Identity], max_columns: int) -> list[Identity]:
    """The first of a frame's identities by base name, then identity; the rest stays in the JSON columns only."""
    return sorted(set(found), key=lambda i: (i.base_name, i.key()))[:max_columns]


@dataclass
class Generation:
    """The identities that a run of frames has admitted, in the order they arrived."""

    max_columns: int
    admitted: dict[Identity, None] = field(default_factory=dict)

    def admit(self, frame: Iterable[Identity]) -> None:
        for i in admitted_by_frame(frame, self.max_columns):
            if i not in self.admitted and len(self.admitted) < self.max_columns:
                self.admitted[i] = None


def struct_field(identity: Identity, name: str) -> T.StructField:
    return T.StructField(name, TYPES[identity.kind], True, {"attribute.source": identity.source, "attribute.path": list(identity.path), "attribute.kind": identity.kind})
