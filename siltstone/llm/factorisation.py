"""Quality scores by a factorisation machine.

A document is a sparse vector: hashed words by the logarithm of their counts,
and one-hot bins of structure statistics and metadata. Every pair of features
interacts through the product of their k-dimensional factors; the sum over all
pairs takes linear time as half the square of the sum less the sum of squares.
The model is fit in numpy on the driver, on a bounded sample of labelled rows
whose features (not texts) come from the executors, and scores every document
where it lies, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from math import log, log1p

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .quality_rules import measure

#: Hash buckets of words, bins of a statistic, factors of a feature.
WORDS, BINS, FACTORS = 1 << 13, 8, 8
#: At most so many labelled rows fit the model: those of smallest hash of their id.
LABELLED_ROWS = 4_000
STATISTICS = 11
SIZE = WORDS + STATISTICS * BINS


def statistics(text: str) -> list[float]:
    """Structure and metadata, each scaled to 0 to 1; of an empty text all 0."""
    words, chars, symbols, lines_twice, repeats, lines, upper, bangs, letters, stop = measure(text)
    n = max(words, 1)
    values = (chars / n / 16, symbols / n, repeats / n, lines_twice / max(lines, 1), upper / n, bangs / n, letters / n, 2 * stop / n, log1p(words) / 11, log1p(len(text)) / 14, words / max(lines, 1) / 80)
    return [min(max(x, 0.0), 1.0) for x in values]


def vector(text: str) -> tuple[list[int], list[float]]:
    """Indices and values of a document's features; the words' part has length 1, and so has the statistics'."""
    counts: Counter = Counter()
    for word, n in Counter(text.split()).items():
        counts[zlib.crc32(word.encode()) % WORDS] += n
    raw = [1 + log(n) for n in counts.values()]
    length = sum(x * x for x in raw) ** 0.5
    index = list(counts)
    values = [x / length for x in raw]
    one = STATISTICS**-0.5
    for i, x in enumerate(statistics(text)):
        # half the bins below 0.1, where most ratios lie
        index.append(WORDS + i * BINS + (min(int(x * 40), 3) if x < 0.1 else 4 + min(int((x - 0.1) / 0.9 * 4), 3)))
        values.append(one)
    return index, values


class Machine:
    """w0 + <w, x> + the sum over pairs i < j of <v_i, v_j> x_i x_j, through the logistic function."""

    def __init__(self, w0: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.w0 = w0
        self.w = np.zeros(SIZE) if w is None else w
        self.v = np.zeros((SIZE, FACTORS)) if v is None else v

    def scores(self, index: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Raw scores of rows whose features lie one after another from `starts` on; no row is without any."""
        if not len(starts):
            return np.zeros(0)
        xv = self.v[index] * values[:, None]
        total = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat((xv * xv).sum(axis=1), starts)
        return self.w0 + np.add.reduceat(self.w[index] * values, starts) + 0.5 * ((total * total).sum(axis=1) - squares)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def flat(rows: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i, _ in rows], dtype=np.int64)
    return np.array([x for i, _ in rows for x in i], dtype=np.int64), np.array([x for _, v in rows for x in v]), np.cumsum(sizes) - sizes


def train(rows: list[tuple[list[int], list[float]]], labels: list[int], epochs: int = 12, rate: float = 0.15, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> Machine:
    """Adaptive gradient descent on the logistic loss, both classes with equal weight; without both classes a machine that says 0.5 or near the one class."""
    rng = np.random.default_rng(seed)
    model = Machine(v=rng.normal(0, 0.05, (SIZE, FACTORS)))
    y = np.array(labels, dtype=float)
    if not len(y):
        return Machine()
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) if 0 < share < 1 else np.ones(len(y))
    sums = [1e-8, np.full(SIZE, 1e-8), np.full((SIZE, FACTORS), 1e-8)]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            index, values, starts = flat([rows[i] for i in some])
            row = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(index))))
            slope = (logistic(model.scores(index, values, starts)) - y[some]) * weight[some] / len(some)
            xv = model.v[index] * values[:, None]
            total = np.add.reduceat(xv, starts, axis=0)
            g = slope[row] * values
            gw = np.bincount(index, g, SIZE)
            touched = np.unique(index)
            gv = np.zeros((SIZE, FACTORS))
            np.add.at(gv, index, g[:, None] * (total[row] - xv))
            g0 = slope.sum()
            sums[0] += g0 * g0
            model.w0 -= rate * g0 / sums[0] ** 0.5
            gw[touched] += decay * model.w[touched]
            sums[1][touched] += gw[touched] ** 2
            model.w[touched] -= rate * gw[touched] / sums[1][touched] ** 0.5
            grad = gv[touched] + decay * model.v[touched]
            sums[2][touched] += grad**2
            model.v[touched] -= 0.3 * rate * grad / sums[2][touched] ** 0.5
    return model


def held_out(id_col: Column) -> Column:
    """Whether a row's label is never learnt from: crc32 of the id as text leaves 1 modulo 3. False for a null id, which no label names."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = LABELLED_ROWS) -> Machine:
    """Learns from at most `limit` labelled rows that are not held out; null labels and ids do not count, of several labels of an id the greatest does."""
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("key"))
        .agg(F.max(label_col).alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(limit)
    )
    # at most `limit` narrow rows
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("words")).join(F.broadcast(chosen), "key")

    def vectors(keys, texts):
        found = list(map(vector, texts))
        return {"key": [k["key"] for k in keys], "label": [k["label"] for k in keys], "index": [i for i, _ in found], "value": [v for _, v in found]}

    keyed = rows.select(F.struct(F.col("key").cast("bigint").alias("key"), F.col("label").cast("int").alias("label")).alias("k"), "words")
    got = map_texts(keyed, "k", "words", vectors, "key bigint, label int, index array<int>, value array<double>").toArrow().sort_by("key")
    pairs = list(zip(got.column("index").to_pylist(), got.column("value").to_pylist(), strict=True))
    return train(pairs, got.column("label").to_pylist())


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted, one row for each row of docs.

    Null and empty texts are scored on their statistics; equal texts have equal scores; a score of 0.5 predicts 1; rows
    without an id are not held out; time and memory grow with the longest text in proportion; an empty table gives an empty
    one; no other column is read.
    """

    def rows(ids, texts):
        values = logistic(model.scores(*flat(list(map(vector, texts))))).tolist()
        return {"doc_id": ids, "score": values, "predicted": [int(x >= 0.5) for x in values]}

    scored = map_texts(docs, id_col, text_col, rows, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
