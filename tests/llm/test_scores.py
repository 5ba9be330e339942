"""Quality rules, the factorisation machine, pseudo-likelihood and mixing."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import factorisation, mixing, pseudo_likelihood, quality_rules


def brute_measure(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


@pytest.mark.parametrize("text", ["", " \n\t", "a b c a b c", "a b a b a b a b", "x\ny\nx\n \nx", "é# $ñ | <b>\x85 z", "a a a a", "one two\x0bthree four", "a b c d a b c e b c d"])
def test_measure(text):
    assert quality_rules.measure(text)[:5] == brute_measure(text)


def test_judge(docs, corpus, labels):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == docs.count()
    texts = {d.doc_id: d.text or "" for d in docs.collect() if d.doc_id is not None}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 7:
            n, chars, symbols, dup, repeats = brute_measure(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeats)
            assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.base_failed and r.kept)
    assert quality_rules.judge(docs.limit(0)).count() == 0 and quality_rules.keep(docs.limit(0)).count() == 0
    found = quality_rules.judge(corpus)
    both = found.join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    shares = {r.quality: r.kept for r in both}
    assert shares[1] > 0.99 and shares.get(0, 0) < 0.05
    kept = quality_rules.keep(corpus)
    assert kept.columns == corpus.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in found.filter("kept").collect())
    assert quality_rules.keep(docs).columns == docs.columns


def test_label_model_finds_kinds_and_accuracies(spark):
    """Planted: good texts that each rule wrongs at times, and two kinds of bad ones of which each trips three rules."""
    rng = np.random.default_rng(0)
    m = len(quality_rules.rules())
    chance = np.full((3, m), 0.03)
    chance[1, :3], chance[2, 4:7] = 0.85, 0.85
    kinds = rng.choice(3, 20_000, p=[0.8, 0.12, 0.08])
    rows, truth = {}, {}
    for k in kinds:
        key = "".join("-" if rng.random() < 0.2 else "gb"[int(rng.random() < chance[k, j])] for j in range(m))
        n = rows.get(key, (0, 0))[0] + 1
        rows[key] = (n, n)
        truth.setdefault(key, []).append(k == 0)
    model = quality_rules.estimate(rows)
    assert model["share"] == pytest.approx(0.8, abs=0.02) and sorted(model["kinds"])[-2:] == pytest.approx([0.08, 0.12], abs=0.02)
    assert np.allclose(model["wrong_good"], 0.03, atol=0.02)
    right = sum(sum(t) if model["posterior"][k] >= 0.5 else len(t) - sum(t) for k, t in truth.items())
    all_pass = sum(sum(t) if "b" not in k else len(t) - sum(t) for k, t in truth.items())
    votes = np.array([[{"g": 1, "b": -1}.get(c, 0) for c in key] for key in truth])
    best = quality_rules.members((votes < 0).astype(float), (votes > 0).astype(float), np.array([0.8, 0.12, 0.08]), chance)[:, 0]  # by the planted chances
    possible = sum(sum(t) if p >= 0.5 else len(t) - sum(t) for p, t in zip(best, truth.values(), strict=True))
    assert right >= possible - 0.003 * len(kinds) and all_pass < possible - 0.05 * len(kinds)
    assert quality_rules.estimate({})["posterior"] == {}


def test_posterior_equals_bayes(spark):
    """The posterior by the definition, one vote at a time."""
    patterns = {"ggggggggg": (60, 60), "gb-gggbbg": (9, 9), "---------": (2, 0), "bbbbbbbbb": (1, 0)}
    model = quality_rules.estimate(patterns)
    for key, p in model["posterior"].items():
        odds = []
        for share, trips in [(model["share"], model["wrong_good"]), *zip(model["kinds"], model["right_bad"], strict=True)]:
            for vote, trip in zip(key, trips, strict=True):
                share *= {"b": trip, "g": 1 - trip, "-": 1}[vote]
            odds.append(share)
        assert p == pytest.approx(odds[0] / sum(odds))


def test_votes_beat_all_must_pass(spark, labels):
    """On documents that pass the base rules the verdict differs from "no bad vote" and agrees better with the labels, which the model never sees."""
    found = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("not base_failed")
    both = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").withColumn("all_pass", ~F.col("votes").contains("b"))
    r = both.agg(*(F.avg((F.col(c) == (F.col("quality") == 1)).cast("int")).alias(c) for c in ("kept", "all_pass")), F.sum((F.col("kept") != F.col("all_pass")).cast("int")).alias("differ")).first()
    assert r.kept > 0.99 and r.kept > r.all_pass and r.differ > 0


def test_keep_short_texts(spark, corpus, labels):
    found = quality_rules.judge(corpus)
    kept = {r.doc_id for r in quality_rules.keep(corpus, min_words=1).select("doc_id").collect()}
    want = found.filter("kept or n_words between 1 and 49 and not 100 * n_repeat_words > 50 * n_words and p_good >= 0.5")
    assert kept == {r.doc_id for r in want.collect()}


# Factorisation machine ----------------------------------------------------


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(3)
    m = factorisation.Machine(0.3, rng.normal(size=factorisation.SIZE), rng.normal(size=(factorisation.SIZE, factorisation.FACTORS)))
    rows = [factorisation.vector(t) for t in ("", "a b c a", "some more words 123 $$$")]
    got = m.scores(*factorisation.flat(rows))
    for (index, values), score in zip(rows, got, strict=True):
        pairs = sum(m.v[i] @ m.v[j] * x * y for a, (i, x) in enumerate(zip(index, values, strict=True)) for j, y in list(zip(index, values, strict=True))[a + 1 :])
        assert score == pytest.approx(m.w0 + sum(m.w[i] * x for i, x in zip(index, values, strict=True)) + pairs)


def test_held_out_accuracy(spark, docs):
    sf = "/root/testdata/sf0.01"
    some, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = factorisation.fit(some, labels)
    rows = factorisation.score(some, model).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    # labels that are held out teach nothing
    changed = labels.withColumn("quality", F.when(factorisation.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(factorisation.fit(some, changed).w, model.w)
    out = factorisation.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1 and len({r.score for r in out if r.doc_id in (3, 4)}) == 1
    assert factorisation.score(docs.limit(0), model).count() == 0
    nothing = factorisation.fit(some, labels.limit(0))
    assert {r.score for r in factorisation.score(docs, nothing).collect()} == {0.5}


# Pseudo-likelihood --------------------------------------------------------


def shares_of(words):
    """A model of the given counts, in which the first word is frequent and all others are rare."""
    p = pseudo_likelihood
    hashes = {w: p.hash_of(w) for w in words}
    signed = {w: int(np.uint64(h).astype(np.int64)) for w, h in hashes.items()}
    first, *others = words
    rest = np.zeros(p.CLASSES, dtype=np.int64)
    for w in others:
        rest[(hashes[w] >> 40) % p.CLASSES] += words[w]
    others.sort(key=signed.get)
    logs = np.array([np.log(words[w] / rest[(hashes[w] >> 40) % p.CLASSES]) for w in others])
    return p.Shares(np.array([signed[first]]), np.array([1]), rest, np.array([signed[w] for w in others]), logs), hashes, rest


def test_network_equals_loops():
    p = pseudo_likelihood
    counts = {b"a": 9, b"b": 3, b"c": 2, b"x": 2, b"d": 1, b"e": 1, b"f": 1}
    model, hashes, rest = shares_of(counts)
    net, words = p.Network(seed=5), p.Words(model)
    some = ["a b C a", "", "x", "a b c d e f"]
    sizes, got, _ = p.score_texts(net, words, some)
    assert sizes.tolist() == [4, 0, 1, 6]

    def log_softmax(z, at):
        return z[at] - np.log(np.exp(z).sum())

    for text, score in zip(some, got, strict=True):
        found = p.tokens(text)
        cls = [(hashes[w] >> 40) % p.CLASSES for w in found]
        inputs = [c * p.SLOTS + 1 if w == b"a" else p.TOP + hashes[w] % p.BUCKETS for w, c in zip(found, cls, strict=True)]
        total = 0.0
        for i, w in enumerate(found):
            x = net.p["b"].astype(float).copy()
            for n, o in enumerate(p.OFFSETS):
                x += net.p["e"][inputs[i + o] if 0 <= i + o < len(found) else p.EDGE] * net.p["a"][n]
            h = np.tanh(x)
            total += log_softmax(h @ net.p["w"] + net.p["c"], cls[i]) + log_softmax(h @ net.p["u"][cls[i]] + net.p["v"][cls[i]], int(w == b"a"))
            total += 0 if w == b"a" else np.log(counts[w] / rest[cls[i]])
        assert score == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_gradient():
    """One step of learning equals the numerical gradient of the cross-entropy, adaptively scaled; many steps learn what a neighbour says."""
    p = pseudo_likelihood
    rng = np.random.default_rng(0)
    window = rng.integers(0, 20, (60, 4))
    classes, slots = np.sort(rng.integers(0, 3, 60)), rng.integers(0, 4, 60)

    def loss(net):
        return -net.log_probabilities(window, classes, slots).mean()

    for name, at in (("e", (7, 3)), ("a", (1, 2)), ("b", (5,)), ("w", (4, 1)), ("c", (2,)), ("u", (1, 6, 2)), ("v", (2, 3))):
        net = p.Network(seed=1)
        for key in net.p:
            net.p[key] = net.p[key].astype(np.float64)
        step = 1e-3
        net.p[name][at] += step
        up = loss(net)
        net.p[name][at] -= 2 * step
        down = loss(net)
        net.p[name][at] += step
        before = net.sums[name].copy()
        net.learn(window, classes, slots)
        got = np.sqrt(max(0.0, float(net.sums[name][at] - before[at])))
        assert got == pytest.approx(abs(up - down) / (2 * step), rel=0.03, abs=2e-4), name
    net = p.Network(seed=1)
    classes = np.sort(window[:, 1] % 5)
    window = window[np.argsort(window[:, 1] % 5, kind="stable")]
    before = net.log_probabilities(window, classes, slots).mean()
    for _ in range(200):
        net.learn(window, classes, slots)
    assert net.log_probabilities(window, classes, slots).mean() > before + 2


def test_pseudo_likelihood(spark, docs, corpus):
    p = pseudo_likelihood
    rows = p.score(docs).collect()
    assert len(rows) == docs.count()
    assert all((r.n_tokens, r.log_likelihood, r.mean_log_likelihood) == (0, 0, 0) for r in rows if r.doc_id in (3, 4, 9))
    assert len({r.log_likelihood for r in rows if r.doc_id in (1, 2)}) == 1
    assert p.score(docs.limit(0)).count() == 0
    counts = p.word_counts(corpus)
    want = Counter(w for r in corpus.collect() for w in p.tokens(r.text))
    assert {r.h % 2**64: r.n for r in counts.collect()} == {p.hash_of(w): n for w, n in want.items()}
    # the words of a class share what its frequent ones leave, and these are the most frequent
    model = p.shares(counts, vocabulary=100)
    top = set(model.top.tolist())
    assert len(top) == sum(min(p.SLOTS - 1, n) for n in Counter((h >> 40) % p.CLASSES for h in map(p.hash_of, want)).values())
    parts = Counter()
    for r in p.own_shares(counts, model).collect():
        if r.h not in top:
            parts[(r.h % 2**64 >> 40) % p.CLASSES] += np.exp(r.part / p.PARTS)
    assert all(x == pytest.approx(1, abs=1e-6) for x in parts.values())
    # sees more than frequencies
    total = sum(want.values())
    unigram = sum(n * np.log(n / total) for n in want.values()) / total
    scores = p.score(corpus.coalesce(1)).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert scores > unigram


def test_words_are_hashed_together_and_numbered_by_first_look_up():
    p = pseudo_likelihood
    words = [b"the", b"", "naïve".encode(), b"x" * 300]
    assert p.hashes_of(words).tolist() == [p.hash_of(w) for w in words] and len(p.hashes_of([])) == 0
    known = p.Words(p.Shares(*(np.zeros(0, dtype=np.int64) for _ in range(4)), np.zeros(0)))
    for _ in range(2):
        assert [x.tolist() for x in known.look_up(["b a b", "", "c a"])] == [[3, 0, 2], [0, 1, 0, 2, 1]] and known.hash.tolist() == p.hashes_of([b"b", b"a", b"c"]).view(np.int64).tolist()
        known.clear()


def test_every_word_has_its_own_share(corpus):
    """However few words the tasks are sent."""
    some = corpus.coalesce(1)
    whole = {r.doc_id: r.log_likelihood for r in pseudo_likelihood.score(some).collect()}
    for few in (0, 100):
        assert {r.doc_id: r.log_likelihood for r in pseudo_likelihood.score(some, vocabulary=few).collect()} == pytest.approx(whole, rel=1e-5)


def test_scores_hardly_depend_on_the_split(spark):
    """Documents are ranked alike however many tasks learn."""
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 500")
    found = [{r.doc_id: r.mean_log_likelihood for r in pseudo_likelihood.score(some.repartition(n, "doc_id")).collect()} for n in (3, 6)]
    a, b = (np.array([x[i] for i in sorted(x)]) for x in found)
    assert np.corrcoef(a, b)[0, 1] > 0.99 and np.abs(a - b).mean() < 0.3


# Mixing -------------------------------------------------------------------

TARGETS = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}


def test_mix_meets_targets(spark, docs, corpus, labels):
    out = mixing.mix(corpus, labels, TARGETS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = out.collect()
    assert len(rows) == corpus.count() and min(r.rate for r in rows) >= 0
    tokens = sum(r.n_tokens for r in rows)
    for domain, want in TARGETS.items():
        got = sum(r.n_tokens * r.rate * r[f"p_{domain}"] for r in rows) / tokens
        assert got == pytest.approx(want, abs=1e-5)
    assert all(sum(r[f"p_{d}"] for d in TARGETS) == pytest.approx(1) for r in rows)
    sources = {r.source: r for r in mixing.by_source(out).collect()}
    assert sum(r.mixed_tokens for r in sources.values()) == pytest.approx(tokens, rel=1e-4)
    assert all(r.rate == pytest.approx(r.mixed_tokens / r.n_tokens) for r in sources.values())
    langs = {r.doc_id: r.lang for r in corpus.collect()}
    assert np.mean([r.domain == langs[r.doc_id] for r in rows if r.n_tokens > 20]) > 0.9


def test_rates_equal_numpy(spark, corpus, labels):
    rows = mixing.mix(corpus, labels, TARGETS).collect()
    n, p = np.array([r.n_tokens for r in rows], float), np.array([[r[f"p_{d}"] for d in sorted(TARGETS)] for r in rows])
    want = np.array([TARGETS[d] for d in sorted(TARGETS)])
    share = n @ p / n.sum()
    r = np.ones(len(n))
    for _ in range(200):
        r = np.maximum(0, r - p @ (((n * r) @ p / n.sum() - want) / share))
    assert np.allclose(r, [x.rate for x in rows], atol=1e-4)


def test_a_target_that_needs_the_bound(spark):
    members = spark.createDataFrame([(100, [0.9, 0.1]), (100, [0.5, 0.5]), (50, [0.2, 0.8])], "n bigint, p array<double>")
    history, reached, wanted = mixing.solve(members, ["a", "b"], {"a": 1.0})
    rates = [r.r for r in members.select(mixing.rate(F.col("p"), history).alias("r")).collect()]
    assert min(rates) == 0 and wanted == [1.0, 0.0] and reached[0] > 0.5 > reached[1]


def test_drawn_keeps_every_document(docs, corpus, labels):
    out = mixing.drawn(corpus, labels, TARGETS)
    assert out.columns == corpus.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(counts) == {r.doc_id for r in corpus.collect()} and max(counts.values()) > 1
    assert sorted(map(repr, out.select("doc_id").collect())) == sorted(map(repr, mixing.drawn(corpus.coalesce(1), labels, TARGETS).select("doc_id").collect()))
    assert mixing.drawn(docs, labels, TARGETS).columns == docs.columns
    assert mixing.mix(docs, labels, TARGETS).count() == docs.count()
    assert mixing.mix(docs, labels.limit(0), TARGETS).select("rate").distinct().collect()[0].rate == 1
    assert mixing.mix(docs.limit(0), labels, TARGETS).count() == 0 and mixing.drawn(docs.limit(0), labels, TARGETS).count() == 0


def test_raising_lowers_no_rate(spark):
    """Mixed documents that are raised for b add to a, and no target is set for c."""
    rows = [(100, [1.0, 0.0, 0.0])] * 6 + [(100, [0.5, 0.5, 0.0])] * 2 + [(100, [0.0, 0.0, 1.0])] * 2
    members = spark.createDataFrame(rows, "n bigint, p array<double>")
    history, reached, wanted = mixing.solve(members, ["a", "b", "c"], {"a": 0.6, "b": 0.4}, raise_only=True)
    rates = [r.r for r in members.select(mixing.rate(F.col("p"), history, 1.0).alias("r")).collect()]
    assert min(rates) == 1 and rates[6] > 1.5 and rates[8:] == [1, 1] and wanted[2] == pytest.approx(0.2) == reached[2]


def test_drawn_keeps_documents_of_domains_without_target(corpus, labels):
    for targets in ({"en": 1.0}, {"en": 0.2, "fr": 0.8}):
        assert {r.doc_id for r in mixing.drawn(corpus, labels, targets).collect()} == {r.doc_id for r in corpus.collect()}


def test_a_text_scores_alike_beside_any_others():
    p = pseudo_likelihood
    rng = np.random.default_rng(4)
    net, none = p.Network(), np.zeros(0, dtype=np.int64)
    words = p.Words(p.Shares(none, none, np.full(p.CLASSES, 10**6), none, np.zeros(0)))
    some = [" ".join(f"w{i}" for i in rng.integers(0, 400, n)) for n in (1, 2, 9, 60, 300, 5000)]
    for text in some:
        found = {float(p.score_texts(net, words, [*others, text])[1][-1]) for others in ([], some[:2], some[:4], some, some * 4)}
        assert len(found) == 1


def test_counted_equals_unique():
    rng = np.random.default_rng(5)
    for n in (0, 1, 500):
        doc, h = rng.integers(0, 9, n), rng.integers(-5, 5, n)
        pairs, times = np.unique(np.stack((doc, h)), axis=1, return_counts=True)
        got = pseudo_likelihood.counted(doc, h)
        assert got[0].tolist() == pairs.tolist() and got[1].tolist() == times.tolist()
