"""Groups of texts whose sets of word shingles have a similarity of at least a given one, for SimHash's near-duplicate stage.

Fingerprints within a few bits are not enough there: texts of similarity 0.8 lie up to 17 of 64 bits apart, and at
such a radius neither block keys nor pivots choose pairs. So links have two nets, both verified by exact similarity:
fingerprints within a radius, by pivot tables; and common shingles. For the latter all shingles have one order, and a
set's keys are so many of its first ones that two similar sets, which differ in fewer, share a key: every pair of
similar sets has one, whatever the order. The order puts the shingles last that a sample of texts shows to be frequent,
so that a passage of many texts brings few together that are not similar.

Texts under a key meet in stars first, each with the key's first text. That joins most groups without all their pairs.
Then, under keys whose texts are in several groups still, all pairs of texts of different groups are looked at, but only
by their sketches, counts of shingles by hash: where these differ by more than similar sets can, so do the sets. Of keys
that just the same texts have one is looked at. Of what passes a key hands on only spanning forests of its groups, a few
at first, so its pairs grow with its texts and not with their square. These are verified, and under keys that have more
pairs between groups still ever more forests, until no pair is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpointed, map_texts, released, sliced, texts, trimmed

#: Texts in which frequent shingles are looked for, about, or one of so many where that is more, and how many of these go last in the order of shingles. They only choose the order.
SAMPLE, EVERY, FREQUENT = 10_000, 16, 100_000
#: Keys that a worker holds before it hands them on, one for each key and first text.
HELD = 2_000_000
#: Rows of a batch that a worker hands on: the JVM holds a batch outside its heap.
BATCH_ROWS = 65_536
#: Pairs of so many rows at most are broadcast, 40 bytes each.
SMALL = 200_000
#: Counts of a sketch, and shingles up to which there are no more; for every doubling of these twice as many, and a quarter of that beyond WIDE counts, which are the bulk of what is shuffled.
COUNTS, SKETCHED, WIDE = 128, 128, 512
#: Sketches of a key meet by sums of so many counts first.
SUMMED = 4
#: Texts of a key that one task looks at; a key with more is split into chunks that meet pairwise.
GROUP_ROWS = 4096
#: Spanning forests of a key's groups, without a common pair, that are verified first, and how many times more in each round after.
FIRST_PAIRS, MORE_PAIRS = 4, 32
#: Counts of sketches that are compared at once.
COMPARED_COUNTS = 2**21
#: Bits, as a power of 2, of the map by which workers hand on few sets that no pair wants.
MAP_BITS = 24
#: Texts that one task compares with one other.
COMPARED = 1024


def shingles(text: str, n: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles; a shorter text is one shingle, one without words none."""
    return np.unique(simhash.shingle_hashes(text, n))


def node(found: np.ndarray) -> int:
    """A 64-bit hash of a set of shingles."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), simhash.SEED)


def classes(size: int, similarity: float) -> tuple[int, int, int]:
    """A size's class, and the largest size of it and of the next: two similar sets are in the same class or in neighbours."""
    at, number = 1, 0
    while (after := int(at / similarity + 1e-9) + 1) <= size:
        at, number = after, number + 1
    return number, after - 1, int(after / similarity + 1e-9)


def keys(found: np.ndarray, similarity: float, frequent: np.ndarray | None = None) -> np.ndarray:
    """The keys of a sorted set: its first shingles, one more than it may have that a similar set lacks. frequent: the sorted shingles that come last."""
    most = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1 if len(found) else 0
    if frequent is None or not len(frequent):
        return found[:most]
    at = np.searchsorted(frequent, found)
    at[at == len(frequent)] = 0
    last = frequent[at] == found
    first = found[~last][:most]
    return np.concatenate((first, found[last][: most - len(first)]))


def sketch(found: np.ndarray) -> bytes:
    """How many shingles of a set have each value of their lowest bits, 255 at most."""
    width = COUNTS
    while width * SKETCHED < len(found) * COUNTS // (1 if width < WIDE else 4):
        width *= 2
    return np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width).clip(max=255).astype(np.uint8).tobytes()


def counts(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length as rows of so many counts, which may be fewer."""
    out = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1).astype(np.int16)
    while out.shape[1] > width:
        half = out.shape[1] // 2
        out = out[:, :half] + out[:, half:]
    return out


def counted(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of any lengths as rows of so many counts."""
    lengths = np.array([len(x) for x in sketches])
    out = np.zeros((len(sketches), width), dtype=np.int16)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[at] = counts([sketches[x] for x in at], width)
    return out


def alike(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets may be similar: their counts differ by no more than similar sets of these sizes do."""
    return np.abs(a - b).sum(axis=1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * (sizes_a + sizes_b) + 1e-6


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def nodes(docs: DataFrame, id_col: str, text_col: str, similarity: float, n: int) -> DataFrame:
    """doc_id, node and fp, the set's hash and the SimHash of the text, size, class and sketch of the set, and of some nodes the set."""
    every = max(1, min(EVERY, docs.count() // SAMPLE))

    def rows(ids, some):
        prints, names, sizes, bands, sketches, sample = [], [], [], [], [], []
        for t in some:
            found = simhash.shingle_hashes(t, n)
            prints.append(simhash.fingerprint_of(found))
            found = np.unique(found)
            names.append(node(found))
            sizes.append(len(found))
            bands.append(classes(len(found), similarity)[0])
            sketches.append(sketch(found))
            sample.append(found.view(np.int64) if names[-1] % every == 0 else None)
        return {"doc_id": ids, "node": signed(np.array(names, dtype=np.uint64)), "fp": signed(np.array(prints, dtype=np.uint64)), "size": sizes, "band": bands, "sketch": sketches, "sample": sample}

    return map_texts(docs, id_col, text_col, rows, "doc_id bigint, node bigint, fp bigint, size int, band int, sketch binary, sample array<bigint>")


def frequent_shingles(own: DataFrame) -> np.ndarray:
    """The most frequent shingles of the sampled nodes, sorted: FREQUENT at most."""
    some = own.filter("sample is not null").groupBy("node").agg(F.first("sample").alias("sample"))
    found = some.select(F.explode("sample").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    return np.sort(found.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow().column("s").to_numpy().view(np.uint64))


def meetings(docs: DataFrame, text_col: str, similarity: float, n: int, frequent: np.ndarray | None = None) -> DataFrame:
    """key, lead and node for all keys that two nodes have: each node but the first with an earlier one.

    A worker hands on one node a key of those it holds, and the pairs with it of the others. So a key that most texts have
    comes to its task once from each handful of texts.
    """
    schema = pa.schema([("key", pa.int64()), ("lead", pa.int64()), ("node", pa.int64())])

    def firsts(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows sorted by key and node: which open a key, and the place of each row's opener."""
        opens = np.concatenate(([True], key[1:] != key[:-1]))
        return opens, np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in sliced(batches, "t"):
            for t in texts(part, "t"):
                found = shingles(t, n)
                k = keys(found, similarity, frequent)
                held.append((k, np.full(len(k), np.uint64(node(found)))))
            if sum(len(k) for k, _ in held) > HELD:
                yield from handed_on(held)
                held = []
        if held:
            yield from handed_on(held)
        held = []
        trimmed()

    def handed_on(held) -> Iterator[pa.RecordBatch]:
        key, own = (np.concatenate(x).view(np.int64) for x in zip(*held, strict=True))
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1]))) if len(key) else np.zeros(0, dtype=bool)
        key, own = key[new], own[new]
        if not len(key):
            return
        opens, at = firsts(key, own)
        for begin in range(0, len(key), BATCH_ROWS):
            some = slice(begin, begin + BATCH_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(own[at[some]], mask=opens[some]), pa.array(own[some])], schema=schema)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key and its first node
        for batch in batches:
            done = batch.filter(batch.column("lead").is_valid())
            yield done
            rest = batch.filter(batch.column("lead").is_null())
            if not len(rest):
                continue
            key, own = rest.column("key").to_numpy(), rest.column("node").to_numpy()
            opens, at = firsts(key, own)
            lead = own[at]
            if last is not None and key[0] == last[0]:
                lead = np.where(key == key[0], last[1], lead)
            last = key[-1], lead[-1]
            differ = lead != own
            yield pa.RecordBatch.from_arrays([pa.array(key[differ]), pa.array(lead[differ]), pa.array(own[differ])], schema=schema)

    ddl = "key bigint, lead bigint, node bigint"
    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, ddl)
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(met, ddl)


def verified(docs: DataFrame, id_col: str, text_col: str, own: DataFrame, pairs: DataFrame, similarity: float, n: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes whose sets are similar. own: doc_id and node of all rows of docs.

    Where the pairs are few only one document of each node is worked out, found by its id, and all without an id; else all,
    but few sets go on that no pair wants.

    One shuffle of the sets of b, and of that of a once for each COMPARED of them, so that a text with many is split.
    """
    counts = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(COMPARED)).cast("int").alias("n")))
    seconds = pairs.join(counts, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt"), F.lit(1).alias("second"))
    firsts = counts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(0).alias("second"))
    wanted = checkpointed(firsts.union(seconds))
    few = wanted.count() <= SMALL
    if few:
        least = own.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        ids = least.join(F.broadcast(wanted.select("node").distinct()), "node", "left_semi").select(F.col("doc_id").alias("wanted_id")).distinct()
        docs = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias(text_col))
        docs = docs.join(F.broadcast(ids), F.col("i") == F.col("wanted_id"), "left_semi").union(docs.filter("i is null"))
    bits = None if few else bit_map(wanted)
    wanted = F.broadcast(wanted) if few else wanted.hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of the task's nodes: copies need not go twice
        for part in sliced(batches, "t"):
            names, found = [], []
            for t in texts(part, "t"):
                own = shingles(t, n)
                if (name := node(own)) not in seen and (bits is None or bits[(at := name % 2**MAP_BITS) >> 3] >> (at & 7) & 1):
                    seen.add(name)
                    names.append(name)
                    found.append(own)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([signed(np.array(names, dtype=np.uint64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["node", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = first_of = None
        for batch in batches:
            a, names, second, lists = batch.column("a").to_pylist(), batch.column("node").to_pylist(), batch.column("second").to_pylist(), batch.column("s")
            out: list[tuple[int, int]] = []
            for i, at in enumerate(a):
                own = lists[i].values.to_numpy().view(np.uint64)
                if not second[i]:
                    first, first_of = own, at
                elif first_of == at:
                    shared = len(np.intersect1d(first, own, assume_unique=True))
                    if shared >= similarity / (1 + similarity) * (len(first) + len(own)) - 1e-9:
                        out.append((at, names[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "node bigint, s array<bigint>")
    met = rows.join(wanted, "node").repartition("a", "salt").sortWithinPartitions("a", "salt", "second", "node")
    return met.select("a", "second", "node", "s").mapInArrow(compare, "a bigint, b bigint").distinct()


def assigned(docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle_words: int = 5, radius: int = simhash.RADIUS) -> DataFrame:
    """doc_id, node (a hash of its set of shingles), root (the smallest node of its group) and component_id, the smallest doc_id of the group.

    Null and empty texts have the empty set and are equal to each other only. A similarity equal to the given one links.
    """
    if not 0 < similarity <= 1:
        raise ValueError("a similarity lies above 0, up to 1")
    own = checkpointed(nodes(docs, id_col, text_col, similarity, shingle_words))
    return simhash.rooted(own.select("doc_id", "node"), lambda _: roots(docs, id_col, text_col, own, similarity, shingle_words, radius))


def roots(docs: DataFrame, id_col: str, text_col: str, own: DataFrame, similarity: float, n: int, radius: int) -> DataFrame:
    """node and root of all nodes that links connect."""
    # nodes under one fingerprint hang on its first, and that on those of fingerprints near it
    prints = checkpointed(own.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")))
    same = own.select("fp", "node").join(prints.filter("first < last"), "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = checkpointed(simhash.forest(prints.select("fp"), radius, simhash.enough_blocks(radius, None)))
    first = prints.select("fp", "first")
    near = near.join(first, near.a == first.fp).select(F.col("first").alias("x"), "b").join(first.withColumnRenamed("first", "y"), F.col("b") == F.col("fp")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    prints = same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = checkpointed(meetings(docs, text_col, similarity, n, frequent_shingles(own)))
    sketches = checkpointed(own.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "band", "sketch"))))

    def connected(pairs: DataFrame, links: DataFrame | None) -> tuple[DataFrame, bool]:
        """The links so far and those of new pairs, and whether there is a new one."""
        docs.sparkSession._jvm.System.gc()  # Spark deletes shuffles that no frame refers to any more, and only then
        more = checkpointed(verified(docs, id_col, text_col, own, checkpointed(likely(pairs, sketches, similarity)), similarity, n))
        return (more if links is None else checkpointed(links.union(more))), not more.isEmpty()

    # each node with the one that leads most of its keys, and those with near fingerprints
    stars = met.groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n")).groupBy("b").agg(F.max(F.struct("n", "a")).alias("of")).select(F.col("of.a").alias("a"), "b")
    tested = checkpointed(prints.union(stars).filter("a < b").distinct())
    links, _ = connected(tested, None)
    found = checkpointed(simhash.components(links))
    # keys whose nodes are in several groups: all pairs of different groups, by and by
    members = open_keys(one_of_equal_keys(met), found)
    released(met)
    most = FIRST_PAIRS
    while not members.isEmpty():
        some = across(members, sketches, similarity, most)
        rest = checkpointed(some.filter("a is null").select(F.col("b").alias("key")).distinct())
        pairs = checkpointed(some.filter("a is not null").distinct().join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            links, new = connected(pairs, links)
            tested = checkpointed(tested.union(pairs))
            found = checkpointed(simhash.components(links)) if new else found
        released(some)
        if rest.isEmpty():
            break
        before, members, most = members, open_keys(members.select("key", "node").join(rest, "key", "left_semi"), found), most * MORE_PAIRS
        released(before, rest)
    return found


def bit_map(wanted: DataFrame) -> bytes:
    """A bit for each value of the lowest bits of a node, set where a wanted node has it. Its size is fixed."""
    low = F.col("node").bitwiseAND(F.lit(2**MAP_BITS - 1))
    found = wanted.select(F.shiftright(low, 3).cast("int").alias("at"), F.expr("shiftleft(1, cast(node & 7 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(2**MAP_BITS // 8, dtype=np.uint8)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets may be similar by their sizes and sketches."""
    joined = pairs.select("a", "b")
    for x in "ab":
        joined = joined.join(sketches.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}")), x)
    joined = checkpointed(joined.filter(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6))
    for x in "ab":
        joined = joined.join(sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
            sizes = [batch.column(c).to_numpy() for c in ("size_a", "size_b")]
            widths = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], dtype=np.int64).reshape(-1, 2)
            good = np.zeros(len(left), dtype=bool)
            for w in np.unique(widths, axis=0):
                at = np.flatnonzero((widths == w).all(axis=1))
                x, y = (counts([some[i] for i in at], int(w.min())) for some in (left, right))
                good[at] = alike(x, y, sizes[0][at], sizes[1][at], similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return joined.mapInArrow(run, "a bigint, b bigint")


def across(members: DataFrame, sketches: DataFrame, similarity: float, most: int) -> DataFrame:
    """Pairs (a, b) of nodes under one key but with different roots whose sets may be similar by their sketches. members: key, node and root.

    Of a key, or two chunks of one, those of so many spanning forests of its roots; where pairs were left out, a row of null and the key says so.
    """
    # by class: a set also goes to the next one, where those of its own class do not meet again
    rows = checkpointed(members.join(sketches.drop("sketch"), "node").withColumn("label", F.explode(F.array("band", F.col("band") + 1))))
    chunks = checkpointed(rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key", "label", F.ceil(F.col("n") / F.lit(GROUP_ROWS)).cast("int").alias("chunks")))
    grouped = (
        rows.join(chunks, ["key", "label"])
        .select("key", "label", "node", "root", "size", "band", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("key", "node", "root", "size", (F.col("band") < F.col("label")).alias("below"), F.xxhash64("key", "label", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("g"), F.when(F.col("chunk") != F.col("other"), F.col("chunk")).alias("chunk"))
        .join(sketches.select("node", "sketch"), "node")
    )
    names = "key", "node", "root", "size", "sketch", "below", "g", "chunk"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch]).select(names)
            table = table if held is None else pa.concat_tables([held, table])
            g = table.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            held = table.slice(cut)
            if cut:
                yield found(table.slice(0, cut))
        if held is not None:
            yield found(held)

    def found(table: pa.Table) -> pa.RecordBatch:
        key, node, root, size, below, g = (table.column(c).to_numpy() for c in ("key", "node", "root", "size", "below", "g"))
        # a chunk's rows do not meet each other where they meet another chunk
        chunk = table.column("chunk").fill_null(-1).to_numpy()
        sketch = table.column("sketch").to_pylist()
        starts = np.concatenate(([0], np.flatnonzero(np.diff(g)) + 1, [len(g)]))
        out, rest = [np.zeros((0, 2), dtype=np.int64)], []
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            order = start + np.argsort(size[start:end], kind="stable")
            sizes, roots, own, low = size[order].astype(np.int64), root[order], chunk[order], below[order]
            some = [sketch[i] for i in order]
            width = min(map(len, some))
            summed = counted(some, width // SUMMED)
            last = np.searchsorted(sizes, sizes / similarity + 1e-6, side="right")
            forests, cut = Forests(roots, most), False
            for i in range(len(order) - 1):
                j = np.arange(i + 1, last[i])
                j = j[(roots[j] != roots[i]) & ((own[j] != own[i]) | (own[i] < 0)) & ~(low[j] & low[i])]
                if not len(j):
                    continue
                j = j[alike(summed[i], summed[j], sizes[i], sizes[j], similarity)]
                full = forests.full(i, j)
                cut |= bool(full.any())
                if not len(j := j[~full]):
                    continue
                mine, step = counted(some[i : i + 1], width), max(1, COMPARED_COUNTS // width)
                near = [alike(mine, counted([some[x] for x in j[at : at + step]], width), sizes[i], sizes[j[at : at + step]], similarity) for at in range(0, len(j), step)]
                kept, more = forests.add(i, j[np.concatenate(near)])
                cut |= more
                out.append(np.sort(node[order][np.stack((np.full(len(kept), i), kept), axis=1)], axis=1))
            if cut:
                rest.append(int(key[start]))
        a, b = np.concatenate(out).T
        left = pa.array(rest, pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), pa.nulls(len(rest), pa.int64())]), pa.concat_arrays([pa.array(b), left])], names=["a", "b"])

    done = checkpointed(grouped.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint"))
    released(rows, chunks)
    return done


class Forests:
    """Spanning forests of the roots of a key's rows: a pair goes into the first forest that does not connect its roots, at most so many there are."""

    def __init__(self, roots: np.ndarray, most: int):
        self.roots = np.unique(roots, return_inverse=True)[1].astype(np.int32)
        self.most, self.labels = most, []

    def full(self, i: int, j: np.ndarray) -> np.ndarray:
        """Which rows j no forest has room for beside row i. What the last forest connects, all before it do."""
        return self.labels[-1][j] == self.labels[-1][i] if len(self.labels) == self.most else np.zeros(len(j), dtype=bool)

    def add(self, i: int, j: np.ndarray) -> tuple[np.ndarray, bool]:
        """Those of the rows j that a forest takes in pairs with row i, and whether there are others."""
        taken, at = [j[:0]], 0
        while len(j) and at < self.most:
            if at == len(self.labels):
                self.labels.append(self.roots.copy())
            labels = self.labels[at]
            other, first = np.unique(labels[j], return_index=True)
            first = first[other != labels[i]]
            taken.append(j[first])
            joined = np.zeros(len(labels), dtype=bool)
            joined[labels[j[first]]] = True
            labels[joined[labels]] = labels[i]
            j = np.delete(j, first)
            at += 1
        return np.concatenate(taken), len(j) > 0


def one_of_equal_keys(met: DataFrame) -> DataFrame:
    """key and node of all nodes of the met keys, but of keys with the same nodes only the smallest: the others bring the same pairs together. Nodes are told apart by two hashes of 64 bits and their number."""
    members = checkpointed(met.select("key", "lead").union(met.select("key", "node")).toDF("key", "node").distinct())
    sets = members.groupBy("key").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)))
    kept = checkpointed(sets.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key"))
    done = checkpointed(members.join(kept, "key", "left_semi"))
    released(members, kept)
    return done


def open_keys(members: DataFrame, found: DataFrame) -> DataFrame:
    """key, node and root of the members of keys whose nodes have several roots."""
    rooted = checkpointed(members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    several = checkpointed(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key"))
    done = checkpointed(rooted.join(several, "key", "left_semi"))
    released(rooted, several)
    return done
