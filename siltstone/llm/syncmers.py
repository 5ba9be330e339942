"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the smallest hash among its inner
s-mers stands at its first or last place. That depends on nothing outside the
k-mer, so an edit moves only the anchors it touches. A fingerprint keeps every
anchor at every position, however long the text is, and two fingerprints are alike
by the anchors that both have and that keep their order of position.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, sliced

#: About 2 in K - S + 2 windows are anchors: one in nine characters.
K, S = 24, 8
#: Odd multiplier of the rolling polynomial and a public 64-bit mixing constant.
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Characters of one stretch of a long text that are hashed at once; stretches overlap by K - 1.
STRETCH = 1_000_000
HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
#: Hexadecimal digits of an anchor's hash.
DIGITS = 16
#: Rows that choose the ranges of ids, for each range; more make the ranges more even and change nothing else.
CUT_ROWS = 40


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-character windows."""
    out = codes[: len(codes) - n + 1].copy()
    for i in range(1, n):
        out = out * BASE + codes[i : len(codes) - n + 1 + i]
    return scrambled(out)


def anchors_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the closed syncmers; a text shorter than K is one anchor, the empty text none."""
    if len(text) < K:
        return (scrambled(np.array([hash_of(text)], dtype=np.uint64)), np.zeros(1, dtype=np.int64)) if text else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    hashes, places = [], []
    for at in range(0, len(codes) - K + 1, STRETCH):
        part = codes[at : at + STRETCH + K - 1].astype(np.uint64)
        small = rolled(part, S)
        width = K - S + 1
        low, span = small, 1
        while span * 2 <= width:  # smallest of windows, by doubling
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = width - span
        low = np.minimum(low[: len(low) - rest], low[rest:])
        chosen = np.flatnonzero((small[: len(low)] == low) | (small[width - 1 : width - 1 + len(low)] == low))
        whole = part[chosen].copy()
        for i in range(1, K):
            whole = whole * BASE + part[chosen + i]
        hashes.append(scrambled(whole))
        places.append(chosen + at)
    return np.concatenate(hashes), np.concatenate(places)


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")


def sketched(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All anchors and their positions, by hash, then position."""
    hashes, places = anchors_of(text)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], places[order]


def sketch(text: str) -> list[tuple[int, int]]:
    """All anchors (hash, position), sorted."""
    return listed(sketched(text))


def listed(found: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    return list(zip(found[0].tolist(), found[1].tolist(), strict=True))


def arrays(found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([h for h, _ in found], dtype=np.uint64), np.array([p for _, p in found], dtype=np.int64)


def spelled(found: list[tuple[int, int]]) -> str:
    """hash:position for each anchor, in hexadecimal, by position."""
    return written(arrays(found))


def written(found: tuple[np.ndarray, np.ndarray]) -> str:
    """What spelled() gives, from arrays: rows of fixed width whose leading zeros of the position are left out."""
    if not len(found[0]):
        return ""
    order = np.argsort(found[1])
    hashes, places = found[0][order], found[1][order]
    width = max(1, (int(places[-1]).bit_length() + 3) // 4)
    rows = np.empty((len(order), DIGITS + 1 + width + 1), dtype=np.uint8)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 0:DIGITS:2], rows[:, 1:DIGITS:2] = HEX[octets >> 4], HEX[octets & 15]
    rows[:, DIGITS] = ord(":")
    kept = np.ones(rows.shape, dtype=bool)
    for i in range(width):
        shift = 4 * (width - 1 - i)
        rows[:, DIGITS + 1 + i] = HEX[(places >> shift) & 15]
        if shift:
            kept[:, DIGITS + 1 + i] = places >> shift > 0
    rows[:, -1] = ord(",")
    kept[-1, -1] = False
    return rows[kept].tobytes().decode("ascii")


def parsed(fingerprint: str) -> list[tuple[int, int]]:
    return sorted((int(h, 16), int(p, 16)) for x in fingerprint.split(",") if x for h, _, p in (x.partition(":"),))


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    """How alike two sketches are, 0 to 1: twice the shared anchors that keep their order, over the anchors of both.

    An anchor that stands several times in both texts is shared as often, first with first; of ways to choose shared
    anchors in order the longest counts. Two texts without anchors are alike.
    """
    return alike(arrays(a), arrays(b))


def told_apart(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes with the second and later of equal ones scrambled by their number, so that all differ."""
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    if new.all():
        return hashes
    number = np.arange(len(hashes)) - np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
    return np.where(new, hashes, scrambled(hashes + number.astype(np.uint64) * MIX))


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """What likeness() gives, from arrays sorted by hash, then position."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, x, y = np.intersect1d(told_apart(a[0]), told_apart(b[0]), assume_unique=True, return_indices=True)
    kept = in_rising_order(b[1][y][np.argsort(a[1][x])])
    return 2 * kept / (len(a[0]) + len(b[0]))


def in_rising_order(places: np.ndarray) -> int:
    """The length of the longest rising run, gaps allowed."""
    if (np.diff(places) > 0).all():
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        if not tails or p > tails[-1]:
            tails.append(p)
        else:
            tails[bisect_left(tails, p)] = p
    return len(tails)


def in_order(docs: DataFrame, id_col: str, text_col: str, partitions: int | None = None) -> DataFrame:
    """The rows (i, t) in partitions of ranges, sorted, each range followed by a copy of the row behind it: columns part, guard, i, t.

    Rows are in the order of (id, hash of the text), nulls first. Equal rows, which may be any number, are dealt among
    the ranges that their place spans by a salt. Ranges are cut at a sample of the keys, CUT_ROWS for each range. One
    shuffle of the texts; the driver gets that sample and one key for each range, and one row a range is copied. Behind
    the last range comes the first row.
    """
    i = F.col(id_col).cast("bigint")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(i.alias("i"), text.alias("t"))
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the salt parts a row from its equals
    place = F.struct(F.col("i").isNotNull().alias("o"), F.coalesce("i", F.lit(0)).alias("i"), F.xxhash64("t").alias("h"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).alias("s"))
    keyed = rows.select("i", "t", place.alias("k"))
    cuts: list = []
    if n > 1:
        total = docs.select(id_col).count()
        sample = keyed.select("k").sample(min(1.0, n * CUT_ROWS / max(1, total)), seed=11).collect()
        places = sorted(r.k for r in sample)
        cuts = [places[len(places) * c // n] for c in range(1, n)] if places else []
    part = count_below(F.col("k"), cuts)
    parted = keyed.withColumn("part", part)
    key = F.struct("k.o", "k.i", "k.h").alias("key")
    firsts = {r.part: tuple(r.first) for r in parted.groupBy("part").agg(F.min(key).alias("first")).collect()}
    dealt = parted.select("part", F.lit(0).alias("guard"), "i", F.col("k.h").alias("h"), "t")
    if firsts:
        order = sorted(firsts)
        behind = [next((p for p in order if p > at), order[0]) for at in range(n)]  # for every range, also one that proves empty
        wanted: dict[tuple, list[int]] = {}
        for at, p in enumerate(behind):
            wanted.setdefault(firsts[p], []).append(at)
        small = spark.createDataFrame([(*k, to) for k, to in wanted.items()], "o boolean, i bigint, h bigint, to array<int>")  # a row for each range at most
        met = keyed.select("k.o", "k.i", "k.h", "t").join(F.broadcast(small), ["o", "i", "h"])
        one = met.groupBy("o", "i", "h", "to").agg(F.min("t").alias("t"))
        guards = one.select(F.explode("to").alias("part"), F.lit(1).alias("guard"), F.when(F.col("o"), F.col("i")).alias("i"), "h", "t")
        dealt = dealt.union(guards)
    own = F.get(constant(own_keys(spark, n), "array<bigint>"), F.col("part"))
    return dealt.repartition(n, own).sortWithinPartitions("part", "guard", "i", "h").select("part", "guard", "i", "t")


def constant(values: list, kind: str):
    """A long literal, which is planned as one."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def own_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a key that hashes to it, so that every range gets a partition of its own."""
    found = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("key")).collect()
    keys = {r["at"]: r["key"] for r in found}
    return [keys.get(k, k) for k in range(n)]


def count_below(place, cuts: list):
    """How many of the sorted cuts are at most a place, by halving."""
    if not cuts:
        return F.lit(0)
    table = constant([c.asDict() for c in cuts], "array<struct<o boolean, i bigint, h bigint, s bigint>>")
    # the answer's bits from the highest on: a bit is set if the cut before so many places is at most the place
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))))

    def bit(held, step):
        more = held + step
        return F.when((more <= len(cuts)) & (F.get(table, more - 1) <= place), more).otherwise(held)

    return F.aggregate(steps, F.lit(0), bit)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n / 2) characters are the first as many (or all) of the next row's text, and likenesses.

    The next row is that of the next id; rows that repeat an id follow each other by their texts' 64-bit hash (xxHash, seed
    42, signed), null ids come first, and the first row follows the last. Null texts count as empty; an empty text has no
    anchors and an empty fingerprint, and is alike only to another. However long a text is, all its anchors are kept, in
    memory in proportion. An empty table gives an empty one; other columns are not read.
    """
    arrow = arrow_schema(docs.sparkSession, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # part, id, text, sketch of the row whose next row is to come
        for batch in batches:
            for small in sliced([batch], "t"):
                for part, guard, i, t in zip(*(small.column(c).to_pylist() for c in ("part", "guard", "i", "t")), strict=True):
                    own = None
                    if held is not None and held[0] == part:
                        own = sketched(t)
                        out.append(finished(held, t, own))
                        held = None
                    if not guard:
                        held = (part, i, t, sketched(t) if own is None else own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []

    def finished(held, after: str, after_sketch) -> tuple:
        _, i, t, own = held
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        changed = sketched(edited) if edited != t else own
        return i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed), alike(own, changed), alike(own, after_sketch)

    return in_order(docs, id_col, text_col).mapInArrow(run, SCHEMA)
