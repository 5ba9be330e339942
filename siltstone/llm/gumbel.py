"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

Every segmentation of a text is a leaf of a tree whose branches are the pieces of
the lattice. Gumbel-perturbed log-probabilities are arrival times in disguise
(t = exp(-g)): a subtree of probability r has its first arrival an exponential
time of rate r after its parent's. So a best-first search (A*, with the exact
subtree mass as its bound) pops the k best perturbed leaves: the root's first
arrival descends by ancestral sampling, each branch left aside on the way is a
queued subtree with an arrival of its own, the earliest of which is popped next.
The (k+1)-th arrival is the threshold of the inclusion scores.

Segmentations of a text are products of those of its segments, so lattices are
built once for each distinct segment, with numpy over many at a time; random
numbers are a hash of row key, draw and place, alike however rows are batched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unigram
from .common import arrow_schema, sliced, texts
from .unigram import SCALE, Unigram

SCHEMA = "doc_id bigint, sample int, ids array<int>, n_pieces int, log_prob double, score double, log_inclusion double"
#: Edges of the lattices that a worker keeps, 22 bytes each; all lattices go when there are more.
STORE_EDGES = 3_000_000
#: Bytes of text that are worked on at once; their segments, paths and random numbers take some fifty times as much.
SLICE_BYTES = 600_000
#: Characters of the segments whose lattices are built at once.
BUILT_CHARS = 30_000
#: How far apart the keys of a row's copies are.
COPY_STRIDE = 0x632BE59BD9B4E019
MULTIPLIER = 0x9E3779B97F4A7C15
_lattices: dict[tuple, Lattices] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit integers (the finaliser of the public splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, counter) -> np.ndarray:
    """Numbers in (0, 1) for 64-bit keys and a counter."""
    bits = mixed(keys + np.uint64(MULTIPLIER) * (np.array(counter, dtype=np.uint64, ndmin=1) + np.uint64(1)))
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Trie:
    """Child nodes by (node, character) in hash tables that numpy looks up for many keys at once."""

    def __init__(self, model: Unigram):
        nodes, edges, piece = {"": 0}, {}, [-1]
        for text, i in model.ids.items():
            for n in range(1, len(text) + 1):
                if text[:n] not in nodes:
                    nodes[text[:n]] = len(piece)
                    edges[(nodes[text[: n - 1]] << 21) | ord(text[n - 1])] = len(piece)
                    piece.append(-1)
            piece[nodes[text]] = i
        self.piece = np.array(piece, dtype=np.int64)
        self.tables = []
        keys, values = np.array(list(edges), dtype=np.uint64), np.array(list(edges.values()), dtype=np.int64)
        bits, factor = 19, MULTIPLIER
        while len(keys):
            slots = (keys * np.uint64(factor)) >> np.uint64(64 - bits)
            _, first = np.unique(slots, return_index=True)
            table = np.full(1 << bits, (1 << 64) - 1, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int64)
            table[0][slots[first]], table[1][slots[first]] = keys[first], values[first]
            self.tables.append((bits, factor, *table))
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, values, bits, factor = keys[rest], values[rest], 14, (factor * 0xD1342543DE82EF95 + 2) % 2**64 | 1

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The children, -1 where there is none."""
        keys = (nodes.astype(np.uint64) << np.uint64(21)) | chars
        out = np.full(len(keys), -1, dtype=np.int64)
        for bits, factor, known, values in self.tables:
            slots = ((keys * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)
            hit = known[slots] == keys
            out[hit] = values[slots[hit]]
        return out


class Column:
    """An array that grows at its end. Room that was never used takes no memory."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(STORE_EDGES * 3 // 2, dtype=kind), 0

    def append(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), dtype=self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : end] = values
        self.n = end

    def values(self) -> np.ndarray:
        return self.room[: self.n]


class Numbers(dict):
    """Numbers segments as they are first asked for; fresh holds those since it was last emptied."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.fresh.append(segment)
        return n


class Lattices:
    """The lattices of distinct segments: nodes are character boundaries, edges into a node are adjacent."""

    def __init__(self, model: Unigram, theta: float):
        self.model, self.theta, self.trie = model, theta, Trie(model)
        self.log_p = np.full(len(model.pieces), -np.inf)
        for i, s in model.scores.items():
            self.log_p[i] = theta * s / SCALE
        self.columns = {name: Column(kind) for name, kind in self.KINDS.items()}
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.unknown: list[str] = []
        self.unknown_ids: dict[int, int] = {}
        for column in self.columns.values():
            column.n = 0
        self.columns["first"].append(np.zeros(1, dtype=np.int64))
        self.view()

    #: Of segments: first node and size; of nodes: first edge; of edges: running and own probability, piece (below 0: an unknown character) and length.
    KINDS = {"base": np.int64, "size": np.int64, "first": np.int64, "reach": np.float64, "p": np.float64, "piece": np.int32, "length": np.int16}

    def view(self) -> None:
        self.base, self.size, self.first, self.reach, self.p, self.piece, self.length = (self.columns[name].values() for name in self.KINDS)

    def look_up(self, segments: list[str]) -> np.ndarray:
        """Numbers of segments, adding lattices of new ones. What was numbered before may be forgotten."""
        if len(self.p) > STORE_EDGES:
            self.clear()
        index = self.index
        found = np.fromiter(map(index.__getitem__, segments), dtype=np.int64, count=len(segments))
        if fresh := index.fresh:
            index.fresh = []
            share = np.cumsum(np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh))) // BUILT_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(fresh)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                self.add(fresh[a:z])
        return found

    def add(self, segments: list[str]) -> None:
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        ends = np.cumsum(size)
        # a node for each boundary: that of character c of segment w and the one behind it are c + w and c + w + 1
        word = np.repeat(np.arange(len(size)), size)
        limit = ends[word]
        found = []
        at, node, n = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64), 0
        known = np.zeros(len(chars), dtype=bool)
        while len(at):
            child = self.trie.step(node, chars[at + n])
            n += 1
            hit = child >= 0
            at, node = at[hit], child[hit]
            piece = self.trie.piece[node]
            is_piece = piece >= 0
            found.append((at[is_piece], piece[is_piece], n))
            if n == 1:
                known[at[is_piece]] = True
            more = at + n < limit[at]
            at, node = at[more], node[more]
        lone = np.flatnonzero(~known)
        degree = np.zeros(len(chars) + len(size), dtype=np.int64)
        for a, _, n in found:
            degree[a + word[a] + n] += 1
        degree[lone + word[lone] + 1] += 1
        first = np.concatenate(([0], np.cumsum(degree)))
        total = int(first[-1])
        piece, length, log_w = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int16), np.empty(total)
        fill = first[:-1].copy()
        for a, ids, n in reversed(found):  # the longest, mostly the likeliest, first
            slot_of = a + word[a] + n
            slots = fill[slot_of]
            fill[slot_of] += 1
            piece[slots], length[slots], log_w[slots] = ids, n, self.log_p[ids]
        if len(lone):
            slots = fill[lone + word[lone] + 1]
            codes, which = np.unique(chars[lone], return_inverse=True)
            ids = np.fromiter(map(self.unknown_id, codes.tolist()), dtype=np.int64, count=len(codes))
            piece[slots], length[slots], log_w[slots] = ids[which], 1, self.theta * self.model.unknown / SCALE
        base = np.concatenate(([0], ends[:-1])) + np.arange(len(size))
        log_a = np.zeros(len(degree))
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1), side="right")
        p = np.empty(total)
        part = np.empty(total)
        for level, count in enumerate(alive, 1):
            nodes = base[order[:count]] + level
            deg = degree[nodes]
            cut = np.cumsum(deg) - deg
            flat = np.arange(int(deg.sum())) + np.repeat(first[nodes] - cut, deg)
            into = np.repeat(nodes, deg)
            value = log_a[into - length[flat]] + log_w[flat]
            top = np.maximum.reduceat(value, cut)
            value = np.exp(value - np.repeat(top, deg))
            mass = np.add.reduceat(value, cut)
            log_a[nodes] = top + np.log(mass)
            value /= np.repeat(mass, deg)
            p[flat] = value
            steps = np.cumsum(value)
            part[flat] = steps - np.repeat(steps[cut] - value[cut], deg)
        single = first[1:] - first[:-1] == 1
        p[first[:-1][single]] = 1.0
        has = degree > 0
        part[first[1:][has] - 1] = 2.0  # beyond any draw
        node, edge = len(self.first) - 1, self.first[-1]
        for name, values in {"base": base + node, "size": size, "first": first[1:] + edge, "reach": part, "p": p, "piece": piece, "length": length}.items():
            self.columns[name].append(values)
        self.view()

    def unknown_id(self, code: int) -> int:
        """The piece of a character that is none: its byte's, or where it has several bytes a number below 0."""
        if code not in self.unknown_ids:
            raw = self.model.byte_ids(chr(code))
            self.unknown_ids[code] = raw[0] if len(raw) == 1 else -1 - len(self.unknown)
            if len(raw) > 1:
                self.unknown.append(chr(code))
        return self.unknown_ids[code]

    def draw(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples a path through each word from its end to its start: all edges word by word, and how many each has."""
        base = self.base[words]
        node = base + self.size[words]
        who = np.flatnonzero(node > base)
        counts = np.zeros(len(words), dtype=np.int64)
        steps = []
        step = 0
        at = node[who]
        while len(who):
            u = uniform(keys[who], step)
            slot = self.first[at]
            late = np.flatnonzero(self.reach[slot] <= u)
            while len(late):
                slot[late] += 1
                late = late[self.reach[slot[late]] <= u[late]]
            steps.append((who, slot))
            counts[who] += 1
            at = at - self.length[slot]
            more = at > base[who]
            who, at = who[more], at[more]
            step += 1
        offset = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int64)
        for n, (who, slot) in enumerate(steps):
            out[offset[who] + n] = slot
        return out, counts


def lattices(path: str, theta: float) -> Lattices:
    key = path, theta
    if key not in _lattices:
        _lattices[key] = Lattices(unigram.load(path), theta)
    return _lattices[key]


class Path:
    """A segmentation: the edges as sampled, how many each word has, and when the subtrees left aside arrive."""

    __slots__ = ("arrivals", "counts", "edges", "first_word", "log_prob", "log_before", "out", "time")

    def __init__(self, store: Lattices, edges, log: np.ndarray, counts, time: float, key: np.ndarray, branch: int):
        self.edges, self.counts, self.time = edges, counts, time
        self.log_prob = float(log.sum())
        # beyond a prefix of probability 0 in double precision no subtree ever arrives
        n = 512
        while n < len(log) and log[:n].sum() > -800:
            n *= 2
        near = edges[:n]
        self.log_before = np.cumsum(log[:n]) - log[:n]
        self.out = {}
        rate = np.exp(self.log_before) * (1.0 - store.p[near])
        self.arrivals = time - np.log(uniform(key, np.arange(len(near)) * 2 + 1_000_003)) / np.maximum(rate, 0.0)
        self.arrivals[:branch] = np.inf  # the path it branches from has those


def sample_texts(store: Lattices, keys: list[int], all_texts: list[str], k: int) -> list[list[tuple]]:
    """For each text its k best perturbed segmentations: (ids, log_prob, score, log_inclusion)."""
    model = store.model
    parts = [model.segments(t) for t in all_texts]
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    words = store.look_up([s for x in parts for s in x])
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        seeds = mixed(np.array([x % 2**64 for x in keys], dtype=np.uint64) * np.uint64(MULTIPLIER) + np.uint64(1))

    def keyed(doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(seeds[doc] + np.uint64(MULTIPLIER) * (place.astype(np.uint64) * np.uint64(64) + np.uint64(n + 2)))

    found: list[list[Path]] = [[] for _ in all_texts]
    kappa = [np.inf] * len(all_texts)
    pending = dict.fromkeys(range(len(all_texts)))
    everyone = np.arange(len(all_texts))
    for n in range(k + 1):
        plans = {}
        own = keyed(everyone, np.full(len(everyone), 2**40), n)
        first = -np.log(uniform(own, 0))
        for d in list(pending):
            if n == 0:
                plans[d] = ([], [], 0, float(first[d]), own[d])
                continue
            source = min(found[d], key=lambda path: path.arrivals.min(initial=np.inf))
            time = float(source.arrivals.min(initial=np.inf))
            if not time < np.inf:
                del pending[d]
                continue
            if n == k:
                kappa[d] = time
                continue
            b = int(source.arrivals.argmin())
            plans[d] = branch(store, source, b, own[d], words[starts[d] : starts[d] + sizes[d]], time)
        if n == k or not plans:
            break
        docs = np.fromiter(plans, dtype=np.int64, count=len(plans))
        done = np.array([len(plans[d][1]) for d in plans], dtype=np.int64)
        left = sizes[docs] - done
        doc = np.repeat(docs, left)
        place = np.arange(int(left.sum())) - np.repeat(np.cumsum(left) - left, left) + np.repeat(done, left)
        edges, counts = store.draw(words[starts[doc] + place], keyed(doc, place, n))
        with np.errstate(divide="ignore"):
            logs = np.log(store.p[edges])
        total = np.concatenate(([0], np.cumsum(counts)))
        word_cut = np.concatenate(([0], np.cumsum(left)))
        for j, d in enumerate(plans):
            head, head_counts, b, time, mine = plans[d]
            a, z = word_cut[j], word_cut[j + 1]
            fresh, fresh_logs, fresh_counts = edges[total[a] : total[z]], logs[total[a] : total[z]], counts[a:z]
            with np.errstate(divide="ignore", over="ignore"):
                if len(head_counts):
                    fresh_logs = np.concatenate((np.log(store.p[head]), fresh_logs))
                    fresh, fresh_counts = np.concatenate((head, fresh)), np.concatenate((head_counts, fresh_counts))
                found[d].append(Path(store, fresh, fresh_logs, fresh_counts, time, mine, b))
    return [[finished(store, path, kappa[d]) for path in paths] for d, paths in enumerate(found)]


def branch(store: Lattices, source: Path, b: int, key: np.uint64, words: np.ndarray, time: float) -> tuple:
    """Takes another edge at place b of a path, and goes on to that word's start; what the path had left aside there waits again."""
    bounds = np.cumsum(source.counts)
    w = int(np.searchsorted(bounds, b, side="right"))
    before = int(bounds[w] - source.counts[w])
    base = int(store.base[words[w]])
    node = base + int(store.size[words[w]]) - int(store.length[source.edges[before:b]].sum())
    out = source.out.setdefault(b, {int(source.edges[b])})
    keys = np.full(1, key)
    choice = [e for e in range(int(store.first[node]), int(store.first[node + 1])) if e not in out]
    weights = np.cumsum(store.p[choice])
    edge = choice[min(len(choice) - 1, int(np.searchsorted(weights, float(uniform(keys, 2)[0]) * weights[-1], side="right")))]
    out.add(edge)
    rest = sum(float(store.p[e]) for e in choice if e != edge)
    with np.errstate(divide="ignore"):
        rate = float(np.exp(source.log_before[b])) * rest
        source.arrivals[b] = time - float(np.log(uniform(keys, 4)[0])) / rate if rate > 0 else np.inf
    new, step = [edge], 0
    node -= int(store.length[edge])
    while node > base:
        u = float(uniform(keys, 6 + 2 * step)[0])
        edge = int(store.first[node])
        while store.reach[edge] <= u:
            edge += 1
        new.append(edge)
        node -= int(store.length[edge])
        step += 1
    head = np.concatenate((source.edges[:b], np.array(new, dtype=np.int64)))
    return head, np.concatenate((source.counts[:w], [b - before + len(new)])), b + 1, time, key


def finished(store: Lattices, path: Path, kappa_time: float) -> tuple:
    """Ids from left to right, log-probability, perturbed log-probability, log of the chance to be among the k."""
    counts = path.counts
    offset = np.cumsum(counts) - counts
    order = np.repeat(2 * offset + counts - 1, counts) - np.arange(len(path.edges))
    ids = store.piece[path.edges[order]]
    if len(ids) and ids.min() < 0:
        flat = []
        for i in ids.tolist():
            flat.extend(store.model.byte_ids(store.unknown[-1 - i]) if i < 0 else (i,))
        ids = np.array(flat, dtype=np.int64)
    log_x = path.log_prob + np.log(kappa_time) if kappa_time < np.inf else np.inf
    inclusion = float(np.log(-np.expm1(-np.exp(log_x)))) if log_x > -30 else float(log_x)
    return ids, path.log_prob, -float(np.log(path.time)), inclusion


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, theta: float = 1.0, seed: int = 42, model: str = unigram.DEFAULT_MODEL, number_copies: bool = False) -> DataFrame:
    """For each row up to k distinct segmentations in the order of their perturbed log-probability; no shuffle.

    sample counts from 0; ids decode to the text exactly; log_prob is the path's log-probability under the unigram model
    raised to theta; score is the perturbed one; log_inclusion is the log of the chance to exceed the (k+1)-th score, 0 if
    there are no more than k segmentations. The draw depends on the row's key (null: as key 0), its text and the seed, so rows
    that repeat get equal samples; with number_copies equal rows that follow each other in a partition, as mixing leaves
    copies, are told apart by their place in that run, and only the first draws as a row alone does. Equal scores, which no
    two random numbers should give, leave the search's order. Null and empty texts have one segmentation, without pieces.
    Long texts take time and memory in proportion, characters that are no piece included. An empty table gives an empty
    one; other columns are not read.
    """
    arrow = arrow_schema(docs.sparkSession, SCHEMA)

    def run(batches):
        store = lattices(model, theta)
        last, copy = None, 0
        for part in sliced(batches, "t", SLICE_BYTES):
            ids, keys, some = part.column("i").to_pylist(), part.column("k").to_pylist(), texts(part, "t")
            if number_copies:
                for n, row in enumerate(zip(ids, some, strict=True)):
                    last, copy = row, copy + 1 if row == last else 0
                    keys[n] += copy * COPY_STRIDE
            found = sample_texts(store, [x * 1_000_003 + seed for x in keys], some, k)
            flat = [(i, n, *s) for i, x in zip(ids, found, strict=True) for n, s in enumerate(x)]
            lengths = np.array([len(x[2]) for x in flat], dtype=np.int32)
            values = np.concatenate([x[2] for x in flat] or [np.zeros(0)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32()), lists.cast(arrow.field("ids").type), pa.array(lengths), *(pa.array([x[c] for x in flat], pa.float64()) for c in (3, 4, 5))],
                schema=arrow,
            )

    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(0))
    return docs.select(F.col(id_col).cast("bigint").alias("i"), key.alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = unigram.DEFAULT_MODEL, out_col: str = "text") -> DataFrame:
    """Adds the text of an array of ids as out_col (or replaces a column of that name); null ids give null."""
    def texts_of(ids: pa.Array) -> pa.Array:
        own = unigram.load(model)
        return pa.array([None if x is None else own.decode(x) for x in ids.to_pylist()], pa.string())

    back = F.arrow_udf(texts_of, "string", F.ArrowUDFType.SCALAR)

    return encoded.withColumn(out_col, back(F.col(ids_col)))
