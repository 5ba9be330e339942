"""Quality rules by weak supervision.

Each rule votes good or bad on a document, or abstains, and none alone decides.
Expectation-maximisation on the counts of vote patterns (at most 3 ** len(RULES)
rows, so the driver's share has a fixed bound) estimates the class shares and each
rule's accuracy; the posterior of "good" decides. Bad documents come in kinds, of
which each trips some rules together, so the bad class is a mixture of as many
kinds as there are rules. It is learnt from the documents that pass the base
rules. One scan of the documents, one small shuffle of pattern counts, no shuffle
of texts.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import checkpointed, free_name, map_rows, map_texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Frequent words of the corpus's languages.
STOP_WORDS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with you "
    "au aux avec ce dans de des du elle en et est il la le les ne pas par pour que qui se sur un une "
    "als auf aus das dem den der des die ein eine es für im in ist mit nicht sich und von zu "
    "al con del el en es la las lo los para por que se su un una y".split()
)
#: Features that the rules read, in the order of measure().
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_alpha", "n_stop")
SCHEMA = "doc_id bigint, " + ", ".join(f"{f} bigint" for f in FEATURES)


def measure(text: str) -> tuple[int, ...]:
    """FEATURES of a whole text; the empty text has only zeros."""
    words = text.encode().split()  # of bytes: ASCII white space only, as the contract's [^\x20\x09-\x0D]+
    loose = text.split()
    n = len(words)
    spaces = sum(map(text.count, SPACES))
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(set(grams)) < len(grams):
        counts = Counter(grams)
        reach = 0  # words before it are counted
        for i, g in enumerate(grams):
            if counts[g] > 1:
                repeats += i + 3 - max(i, reach)
                reach = i + 3
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), sum(map(str.isupper, loose)), text.count("!"), sum(map(str.isalpha, loose)), sum(map(STOP_WORDS.__contains__, loose)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of FEATURES for each row of docs."""

    def rows(ids, texts):
        cols = list(zip(*map(measure, texts), strict=True)) or [[]] * len(FEATURES)
        return {"doc_id": ids, **dict(zip(FEATURES, map(list, cols), strict=True))}

    return map_texts(docs, id_col, text_col, rows, SCHEMA)


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule, when it votes good and when it votes bad; it abstains otherwise. None restates a base rule. Thresholds are strict: a rule may be wrong, as others outvote it."""
    def below(x: Column, good: float, bad: float) -> tuple[Column, Column]:
        return x <= good, x > bad

    length, dup, enough = ratio("word_chars", "n_words"), ratio("n_dup_lines", "n_lines"), F.col("n_words") >= 20
    return {
        "word_length": (length.between(3, 7), ~length.between(3, 10)),
        "symbols": below(ratio("n_symbols", "n_words"), 0.02, 0.1),
        "repeats": below(ratio("n_repeat_words", "n_words"), 0.05, 0.15),
        "lines": ((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1), dup > 0.1),
        "capitals": below(ratio("n_upper", "n_words"), 0.05, 0.1),
        "bangs": below(ratio("n_bangs", "n_words"), 0.02, 0.1),
        "stop_words": (enough & (ratio("n_stop", "n_words") >= 0.1), enough & (ratio("n_stop", "n_words") < 0.06)),
        "letters": (enough & (ratio("n_alpha", "n_words") >= 0.75), enough & (ratio("n_alpha", "n_words") < 0.7)),
        "line_length": (ratio("n_words", "n_lines") >= 10, ratio("n_words", "n_lines") < 5),
    }


def pattern() -> Column:
    """The votes as one string over g, b and - (abstains)."""
    return F.concat(*(F.when(good, "g").when(bad, "b").otherwise("-") for good, bad in rules().values()))


def repeats_itself() -> Column:
    return 100 * F.col("n_repeat_words") > 50 * F.col("n_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | repeats_itself()


#: Prior beliefs, weighed as WEIGHT of the documents: how many are bad, how often a rule is wrong on a good document, and how often the rule that names a
#: kind of bad ones, and any other rule, is right on it. No estimate is bounded by them.
BAD, WRONG, OWN, OTHER, WEIGHT = 0.1, 0.05, 0.9, 0.5, 0.1


def estimate(patterns: dict[str, tuple[int, int]], steps: int = 500) -> dict:
    """EM on vote patterns, each with how many documents have it and how many of these to learn from.

    Gives the share of good documents, the shares of the kinds of bad ones, for each rule its chance to vote bad, when it
    votes, on good documents and on each kind, and the posterior of "good" for each pattern. The start is lopsided: good
    documents hardly trip a rule, and kind j trips rule j. The priors' weight is at least that of ten documents, which
    keeps every estimate inside (0, 1), also on an empty table.
    """
    keys = sorted(patterns)
    m = len(rules())
    votes = np.array([[{"g": 1, "b": -1}.get(c, 0) for c in k] for k in keys], dtype=float).reshape(len(keys), m)
    bad, good = (votes < 0).astype(float), (votes > 0).astype(float)
    counts = np.array([patterns[k][1] for k in keys], dtype=float)
    start = np.concatenate(([1 - BAD], np.full(m, BAD / m)))
    prior = np.vstack([np.full(m, WRONG), np.where(np.eye(m) > 0, OWN, OTHER)])
    weight = np.maximum(10, WEIGHT * counts.sum() * start)[:, None]
    share, trips = start, prior
    for _ in range(steps):
        held = counts[:, None] * members(bad, good, share, trips)
        before = share, trips
        share = (held.sum(axis=0) + 10 * start) / (counts.sum() + 10)
        trips = (held.T @ bad + weight * prior) / (held.T @ (bad + good) + weight)
        if np.abs(share - before[0]).sum() + np.abs(trips - before[1]).sum() < 1e-9:
            break
    found = members(bad, good, share, trips)[:, 0]
    return {"share": float(share[0]), "kinds": share[1:].tolist(), "wrong_good": trips[0].tolist(), "right_bad": trips[1:].tolist(), "posterior": dict(zip(keys, found.tolist(), strict=True))}


def members(bad: np.ndarray, good: np.ndarray, share: np.ndarray, trips: np.ndarray) -> np.ndarray:
    """For each pattern the chances of being good (column 0) and of each kind of bad. A rule that abstains says nothing."""
    logs = np.log(share) + bad @ np.log(trips).T + good @ np.log(1 - trips).T
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def fit(measured: DataFrame) -> dict:
    """The label model of a table of features(), learnt from the rows that pass the base rules."""
    learnt = F.sum(F.when(base_failed(), 0).otherwise(1))
    return estimate({r.votes: (r.n, r.m) for r in measured.groupBy(pattern().alias("votes")).agg(F.count("*").alias("n"), learnt.alias("m")).collect()})


def looked_up(model: dict) -> Column:
    """The posterior of a row's vote pattern; the table has at most 3 ** len(RULES) entries and in practice some dozens."""
    pairs = list(chain.from_iterable((F.lit(k), F.lit(v)) for k, v in sorted(model["posterior"].items())))
    return F.element_at(F.create_map(*pairs), pattern()) if pairs else F.lit(None).cast("double")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Features, base_failed, votes, the posterior p_good and kept, one row for each row of docs.

    Null or empty texts have no words, fail the base rules and are not kept; rows that repeat count as often as they occur;
    a posterior equal to the threshold keeps; texts are measured whole, in memory in proportion to the longest; an empty
    table gives an empty one; columns besides the two named are not read.
    """
    measured = checkpointed(features(docs, id_col, text_col))
    model = fit(measured)
    return measured.withColumns({"base_failed": base_failed(), "votes": pattern(), "p_good": looked_up(model)}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, min_words: int = 50) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns.

    With a smaller min_words also those short texts, of at least so many words, that fail the base rules for nothing but
    their length and have a posterior that keeps them: shortness alone says nothing against a text. Each text is measured
    once: the rows are written out with their features, so that no text is shuffled and neither null nor repeated ids
    matter. Rows that repeat stay or go together; an empty table gives an empty one.
    """
    mark = free_name("_measured", docs.columns)

    def change(texts):
        return {mark: pa.array([",".join(map(str, measure(t or ""))) for t in texts], type=pa.string())}

    wide = checkpointed(map_rows(docs, text_col, change, StructType([*docs.schema.fields, StructField(mark, StringType())])))
    values = F.split(F.col(mark), ",")
    inner = wide.select(F.struct(*docs.columns).alias("row"), *(values[i].cast("bigint").alias(f) for i, f in enumerate(FEATURES)))
    model = fit(inner)
    return inner.filter((F.col("n_words") >= max(1, min_words)) & ~repeats_itself() & (looked_up(model) >= threshold)).select("row.*")
