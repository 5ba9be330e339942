"""Mixing documents to target weights of domains with soft membership.

A naive Bayes classifier over hashed words, learnt from labelled rows, gives each
document a posterior over domains. Then nonnegative document rates r are fit so
that the expected domain totals, the sum over documents of tokens x rate x
posterior, match the targets: weighted least squares by projected gradient,
minimising the sum over domains of (e_k - tau_k) ** 2 / s_k, where e, tau and s are
the reached, the wanted and the present shares. In that scaling the curvature is
at most 1, so a step of 1 always descends. A step changes a document's rate only
through its posterior and the K numbers (e_k - tau_k) / s_k, so the history of
those vectors is the whole state: rates are recomputed from it by an expression,
and a step is one scan and a sum of K numbers. All of it is DataFrame expressions;
nothing is shuffled but partial sums.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

BUCKETS = 2048
#: At most so many labelled rows fit the classifier: those of smallest hash of their id.
LABELLED_ROWS = 5_000
#: Words a document's evidence counts for at most: longer ones are averaged, so that mixed documents keep soft membership.
EVIDENCE = 20.0
STEPS, TOLERANCE = 60, 1e-7
#: The classifier is a table of so many domains by BUCKETS in the plan.
DOMAINS = 64


def words(text: Column) -> Column:
    """Lower-case words; none for null and empty texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class Classifier:
    """Log-weights of hashed words for each domain, scaled by their spread over domains; no domain at all means no labelled rows."""

    def __init__(self, domains: list[str], priors: list[float], weights: list[list[float]]):
        self.domains, self.priors, self.weights = domains, priors, weights

    def posterior(self, found: Column) -> Column:
        """An array of the domains' probabilities from an array of words; the priors for no words."""
        tables = [F.array(*map(F.lit, row)) for row in self.weights]

        def logs(b: Column) -> Column:
            scale = F.when(F.size(b) > 0, F.least(F.size(b).cast("double"), F.lit(EVIDENCE)) / F.size(b)).otherwise(0.0)
            return F.array(*(F.lit(math.log(prior)) + scale * added(b, table) for prior, table in zip(self.priors, tables, strict=True)))

        odds = once(once(F.transform(found, bucket), logs), lambda x: F.transform(x, lambda y: F.exp(y - F.array_max(x))))
        return once(odds, lambda x: F.transform(x, lambda y: y / F.aggregate(x, F.lit(0.0), lambda a, b: a + b)))


def added(buckets: Column, table: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))


def once(value: Column, use) -> Column:
    """use(value) for an array-valued use of a value that is worked out only once however often it occurs there."""
    return F.flatten(F.transform(F.array(value), use))


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", limit: int = LABELLED_ROWS) -> Classifier:
    """Learns domains from at most `limit` rows of docs whose id the labelled table has and whose domain is not null."""
    chosen = labelled.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("key")).distinct().orderBy(F.xxhash64("key"), "key").limit(limit)
    own = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("t"), F.col(domain_col).cast("string").alias("d")).filter("d is not null").join(F.broadcast(chosen), "key", "left_semi")
    own = checkpointed(own.select("d", F.transform(words(F.col("t")), bucket).alias("b")))
    seen = {r.d: r.n for r in own.groupBy("d").agg(F.count("*").alias("n")).collect()}
    counts = own.select("d", F.explode("b").alias("b")).groupBy("d", "b").agg(F.count("*").alias("n")).collect()  # domains x BUCKETS rows at most
    domains = sorted(seen)
    table = {d: [0.5] * BUCKETS for d in domains}
    for r in counts:
        table[r.d][r.b] += r.n
    if len(domains) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    totals = {d: sum(table[d]) for d in domains}
    rows = sum(seen.values())
    return Classifier(domains, [seen[d] / rows for d in domains], [[math.log(x / totals[d]) for x in table[d]] for d in domains])


def rate(p: Column, history: list[list[float]], least: float = 0.0) -> Column:
    """A document's rate after the steps so far: from 1 on, each takes off the posterior's part of that step's vector and stops at `least`."""
    r = F.lit(1.0)
    if not history:
        return r
    steps = F.array(*(F.array(*map(F.lit, g)) for g in history))
    return F.aggregate(steps, r, lambda r, g: F.greatest(F.lit(least), r - F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))


def solve(members: DataFrame, domains: list[str], targets: dict[str, float], raise_only: bool = False) -> tuple[list[list[float]], list[float], list[float]]:
    """The history of steps, reached shares and wanted shares, from columns n (tokens) and p (posterior).

    Targets are weights, scaled to sum to 1 over the domains there are; a domain without target wants 0. Shares are of
    the present tokens; with raise_only no rate falls below 1, the wanted total is the smallest that lets no domain with a target shrink, and a
    domain without one wants its present share. Domains that no document belongs to stay out.
    """
    k = len(domains)
    least = 1.0 if raise_only else 0.0

    def sums(history: list[list[float]]) -> list[float]:
        r = rate(F.col("p"), history, least)
        found = members.agg(*(F.sum(F.col("n") * r * F.get("p", F.lit(i))).alias(f"e{i}") for i in range(k))).first()
        return [float(x or 0.0) for x in found]

    if not k:
        return [], [], []
    start = sums([])
    total = sum(start)
    wanted = [max(0.0, targets.get(d, 0.0)) for d in domains]
    if total <= 0 or sum(wanted) <= 0:
        return [], [], []
    share = [x / total for x in start]
    wanted = [x / sum(wanted) for x in wanted]
    if raise_only:
        grow = max(s / w for s, w in zip(share, wanted, strict=True) if w > 0)
        wanted = [w * grow if w > 0 else s for s, w in zip(share, wanted, strict=True)]
    history: list[list[float]] = []
    reached = share
    for _ in range(STEPS):
        gap = [e - w for e, w in zip(reached, wanted, strict=True)]
        if max(map(abs, gap)) <= TOLERANCE * max(1.0, sum(wanted)):
            break
        step = [g / s if s > 1e-12 else 0.0 for g, s in zip(gap, share, strict=True)]
        if history and max(abs(a - b) for a, b in zip(step, history[-1], strict=True)) <= 1e-12:
            break  # no document can give more
        history.append(step)
        reached = [x / total for x in sums(history)]
    return history, reached, wanted


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", domain_col: str = "lang") -> DataFrame:
    """doc_id, source, n_tokens, a probability p_<domain> for each domain, domain (the likeliest) and rate, one row for each row of docs.

    Null and empty texts have no tokens and the priors as posterior; their rate follows from it and weighs nothing. Rows
    that repeat have equal rates; of domains with equal posteriors the first by name is the likeliest. Without labelled rows
    there are no domains and every rate is 1; an empty table gives an empty one. Where no rates reach the targets, a warning
    says by how much; the rates are then the nearest by least squares.
    """
    model = fit(docs, labelled, id_col, text_col, domain_col)
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("w"))
    p = model.posterior(F.col("w")) if model.domains else F.array().cast("array<double>")
    members = checkpointed(found.select("doc_id", "source", F.size("w").cast("bigint").alias("n"), p.alias("p")))
    history, reached, wanted = solve(members, model.domains, targets)
    told(reached, wanted)
    names = F.array(*map(F.lit, model.domains)) if model.domains else F.array().cast("array<string>")
    likeliest = F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return members.select("doc_id", "source", F.col("n").alias("n_tokens"), *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)), likeliest.alias("domain"), rate(F.col("p"), history).alias("rate"))


def by_source(mixed: DataFrame) -> DataFrame:
    """source, its tokens, the tokens that mix()'s rates give it, and the quotient (null for a source without tokens). Partial sums come before the shuffle, so a source with most rows is no task of its own."""
    sums = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_tokens") * F.col("rate")).alias("mixed_tokens"))
    return sums.withColumn("rate", F.when(F.col("n_tokens") > 0, F.col("mixed_tokens") / F.col("n_tokens")))


def drawn(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", seed: int = 42) -> DataFrame:
    """The rows of docs, each as often as its rate says: the whole part, and once more with the chance of the rest, drawn by a hash of the id.

    Rates are 1 or more, so mixing loses no document; a domain without a target keeps its present share. Copies of a row
    follow each other. Rows without an id are drawn alike; null and empty texts have the priors as posterior; without
    labelled rows, and for an empty table, docs come back as they are.
    """
    model = fit(docs, labelled, id_col, text_col, domain_col)
    if not model.domains:
        return docs
    found = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("i"), words(F.col(text_col)).alias("w"))
    # written out with the rows, so that no posterior is worked out again for the rates; and without them, for the steps
    members = checkpointed(found.select("row", "i", F.size("w").cast("bigint").alias("n"), model.posterior(F.col("w")).alias("p")))
    history, reached, wanted = solve(checkpointed(members.select("n", "p")), model.domains, targets, raise_only=True)
    told(reached, wanted)
    chance = F.pmod(F.xxhash64(F.col("i"), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(rate(F.col("p"), history, 1.0) + chance).cast("int")
    repeated = F.explode(F.array_repeat(F.lit(True), copies))
    return members.select("row", repeated.alias("again")).select("row.*")


def told(reached: list[float], wanted: list[float]) -> None:
    """Warns where no rates, or not STEPS steps, reach what is wanted."""
    gap = max((abs(a - b) for a, b in zip(reached, wanted, strict=True)), default=0.0)
    if gap > 100 * TOLERANCE * max(1.0, sum(wanted)):
        warnings.warn(f"the mix misses its targets by up to {gap:.3g} of the tokens there are", stacklevel=3)
