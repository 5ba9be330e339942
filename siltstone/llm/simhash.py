"""SimHash near-duplicates with pivot distance tables.

Fingerprints of equal documents are equal, so everything after the first scan
works on distinct fingerprints. Two that differ in at most `radius` bits agree on
at least `BLOCKS - radius` of BLOCKS blocks of bits, so they meet under at least
one key that spells that many whole blocks (complete, no sampling). Within a key
every fingerprint has a row of Hamming distances to the pivots; a pair with a
coordinate difference above the radius is discarded (the triangle inequality
allows no link), survivors are verified bit by bit, and a group hands on a
spanning forest of its links rather than the pairs. Keys with more than
GROUP_ROWS fingerprints are split into chunks that meet pairwise, so no task
holds more than two chunks of a key whatever its size. Components come from
alternating large-star and small-star rounds on the forest's edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpointed, free_name, map_rows, map_texts

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: A key spells BLOCKS - RADIUS of so many blocks: 10 keys of 25 or 26 bits.
BLOCKS = 5
GROUP_ROWS = 4096
#: Reference fingerprints: fixed pseudo-random numbers, spread over the space.
PIVOTS = np.random.default_rng(20).integers(0, 2**64, size=24, dtype=np.uint64)


def shingle_hashes(text: str, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The hashes of the words' shingles, repeats included; a shorter text is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: only A-Z and ASCII white space count
    n = len(words)
    if n <= words_per_shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - words_per_shingle + 1].tolist()
    stops = (ends[words_per_shingle - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(starts))


def fingerprint(text: str, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of the words' shingles, 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text, words_per_shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 for none."""
    count = len(hashes)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, count, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed bigint, one row for each row of docs."""

    def rows(ids, texts):
        fps = np.fromiter((fingerprint(t, shingle_words) for t in texts), dtype=np.uint64, count=len(texts))
        return {"doc_id": ids, "fp": fps.astype(np.int64).tolist()}

    return map_texts(docs, id_col, text_col, rows, "doc_id bigint, fp bigint")


def block_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """The keys of a fingerprint: an array of (which blocks, their bits)."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(a, z)) for a, z in zip(cuts, cuts[1:], strict=False)]

    def signed(x: int) -> int:
        return x - 2**64 if x >= 2**63 else x

    chosen = list(combinations(range(blocks), blocks - radius))
    return F.array(*(F.struct(F.lit(i).alias("which"), fp.bitwiseAND(F.lit(signed(reduce(int.__or__, (masks[b] for b in c))))).alias("bits")) for i, c in enumerate(chosen)))


def linked(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS, pivots: np.ndarray = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (member, root) positions, of the links inside each group; rows come sorted by group."""
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
    sizes = np.diff(starts)
    labels = np.arange(len(fps))
    small = sizes <= 256

    def join(a: np.ndarray, b: np.ndarray) -> None:
        near = np.ones(len(a), dtype=bool)
        for at in range(0, table.shape[1], 8):
            left = np.flatnonzero(near)
            if not len(left):
                return
            near[left] = (np.abs(table[a[left], at : at + 8] - table[b[left], at : at + 8]) <= radius).all(axis=1)
        a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        unite(labels, a[near], b[near])

    # small groups together: the pairs of rows n apart, for each n
    ends = np.repeat(starts[1:], sizes)
    inside = np.repeat(small, sizes)
    at = np.flatnonzero(inside)
    n = 1
    while len(at := at[at + n < ends[at]]):
        join(at, at + n)
        n += 1
    for a, z in zip(starts[:-1][~small], starts[1:][~small], strict=True):
        for row in range(a, z, 64):
            x, y = np.divmod(np.arange(min(64, z - row) * (z - a)), z - a)
            x, y = x + row, y + a
            up = x < y
            join(x[up], y[up])
    member = np.flatnonzero(labels != np.arange(len(fps)))
    return member, labels[member]


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives rows that links connect, directly or over others, the smallest label among them."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := labels[labels], labels):
            labels[:] = further


def forest(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect just what all links within the radius connect. fps: a column fp without repeats."""
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("k")).select("fp", "k.which", "k.bits")
    # written out, so that the join deals out both its sides itself and can split the rows of a hot key
    met = checkpointed(keyed.groupBy("which", "bits").agg(F.count("*").alias("n")).filter("n > 1"))
    chunks = F.ceil(F.col("n") / F.lit(group_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    grouped = (
        keyed.join(met, ["which", "bits"])
        .select("which", "bits", "fp", chunks.alias("chunks"))
        .select("which", "bits", "fp", own.alias("own"), other)
        .select("fp", F.xxhash64("which", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("g"))
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        for batch in batches:
            fp, g = (np.concatenate((x, batch.column(c).to_numpy(zero_copy_only=False))) for x, c in zip(held, ("fp", "g"), strict=True))
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on in the next batch
            held = fp[cut:], g[cut:]
            if cut:
                yield found(fp[:cut], g[:cut])
        if len(held[0]):
            yield found(*held)

    def found(fp: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
        member, root = linked(fp.view(np.uint64), g, radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[root])], schema=schema)

    return grouped.repartition("g").sortWithinPartitions("g").mapInArrow(links, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that edges (a, b) reach, for each node of an edge. Alternating large-star and small-star rounds.

    What is joined is written out first, so that the joins deal out both their sides themselves and can split a star's centre.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    state = None
    while state is None or state[1] != state[0]:
        if edges.isEmpty():
            break
        # large star: a node's larger neighbours hang on its smallest one (or itself)
        both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = checkpointed(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
        # small star: a node and its smaller neighbours hang on the smallest of them
        low = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31))).alias("s")).first())
        state = (None if state is None else state[1]), now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def enough_blocks(radius: int, blocks: int | None) -> int:
    """The blocks given, or BLOCKS, or two more than the radius where that is more: fewer than one more leave no whole block to meet under."""
    if blocks is None:
        return max(BLOCKS, radius + 2)
    if not radius < blocks <= 64:
        raise ValueError(f"{blocks} blocks are not complete for a radius of {radius}")
    return blocks


def assigned(docs: DataFrame, id_col: str, text_col: str, radius: int, shingle_words: int = SHINGLE_WORDS, blocks: int | None = None) -> DataFrame:
    """doc_id, node (its fingerprint), root (the smallest fingerprint of the component) and component_id."""
    blocks = enough_blocks(radius, blocks)
    own = checkpointed(fingerprints(docs, id_col, text_col, shingle_words).withColumnRenamed("fp", "node"))
    return rooted(own, lambda distinct: components(forest(distinct.withColumnRenamed("node", "fp"), radius, blocks)))


def rooted(own: DataFrame, roots_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, node, root and component_id from rows (doc_id, node) and a function from distinct nodes to (node, root) of the linked ones."""
    distinct = checkpointed(own.groupBy("node").agg(F.min("doc_id").alias("least")))
    roots = checkpointed(roots_of(distinct.select("node")))
    linked_to = checkpointed(roots.join(distinct, "node").select("root", "node", "least"))
    named = checkpointed(linked_to.groupBy("root").agg(F.min("least").alias("component_id")))
    # a node without links is its own component
    alone = F.col("root").isNull()
    by_node = distinct.join(linked_to.join(named, "root").select("node", "root", "component_id"), "node", "left")
    by_node = by_node.select("node", F.coalesce("root", "node").alias("root"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # written out, so that the join deals out both its sides itself and can split the rows of a hot node
    return own.join(checkpointed(by_node), "node").select("doc_id", "node", "root", "component_id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, blocks: int | None = None) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, one row for each row of docs.

    Null and empty texts have fingerprint 0 and link to whatever lies within the radius of it. Rows that repeat share
    their component. A component without any non-null doc_id has a null component_id. Other columns are not read;
    an empty table gives an empty one.
    """
    return assigned(docs, id_col, text_col, radius, shingle_words, blocks).select("doc_id", F.col("node").alias("fp"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, blocks: int | None = None, similarity: float | None = None) -> DataFrame:
    """The rows of docs with the smallest id of their group, with docs' columns.

    Groups are those of groups(), or, where a similarity is given, those of similar.assigned(). Of rows that repeat that id
    the one with the smallest text stays. A group that has no ids keeps one row, of its smallest node; rows without an id
    leave groups that have ids. An empty table gives an empty one.
    """
    from . import similar

    if similarity is None:
        found = assigned(docs, id_col, text_col, radius, shingle_words, blocks)
        node_of = lambda text: fingerprint(text, shingle_words)
    else:
        found = similar.assigned(docs, id_col, text_col, similarity, shingle_words, radius)
        node_of = lambda text: similar.node(similar.shingles(text, shingle_words))
    found = checkpointed(found)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # ids are narrow: a hash table of one partition's ids beside a stream of texts, no sort of texts
    rows = docs.join(kept.hint("shuffle_hash"), docs[id_col] == kept["doc_id"], "left_semi")

    def first(some: DataFrame, key: str) -> DataFrame:
        """Of rows of a key the one with the smallest text; each task hands on one row a key."""
        order = F.struct(F.col(text_col).isNotNull(), F.col(text_col))
        return some.select(F.col(key).alias("key"), F.struct(*docs.columns).alias("row"), order.alias("order")).groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*")

    repeated = checkpointed(docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if not repeated.isEmpty():
        several = rows[id_col] == repeated["doc_id"]
        rows = rows.join(repeated, several, "left_anti").union(first(rows.join(repeated, several, "left_semi"), id_col))
    nameless = docs.filter(F.col(id_col).isNull())
    if not nameless.select(id_col).isEmpty():
        mark = free_name("_node", docs.columns)
        schema = StructType([*docs.schema.fields, StructField(mark, LongType())])
        marked = map_rows(nameless, text_col, lambda texts: {mark: pa.array(np.array([node_of(t or "") for t in texts], dtype=np.uint64).astype(np.int64))}, schema)
        roots = checkpointed(found.filter(F.col("component_id").isNull() & (F.col("node") == F.col("root"))).select(F.col("root")).distinct())
        rows = rows.union(first(marked.join(roots, marked[mark] == roots["root"], "left_semi"), mark))
    return rows
