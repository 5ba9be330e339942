"""Token counts and sampled segmentations against the tokenizer library and brute force."""

import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import gumbel, token_counts, unigram
from siltstone.llm.token_counts import PieceCounts

MODEL = unigram.load()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL.library_model())
STORE = gumbel.Lattices(MODEL, 1.0)
COUNTS = PieceCounts(MODEL)
TEXTS = st.text(alphabet="aeinrst th.,\n\t▁é日\U0001f600\x00", max_size=60) | st.text(max_size=30).filter(lambda t: t.encode("utf-8", "ignore").decode() == t)


@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_counts_equal_the_library(text):
    score, n = COUNTS.total(text)
    ids = LIBRARY.encode(text)
    assert n == len(ids)
    if text:
        assert score / 16 == pytest.approx(best(text), abs=1e-9)


def best(text):
    """The best score by a plain dynamic program over the whole text."""
    t = MODEL.prefix + text.replace(" ", unigram.SPACE)
    top = [0.0] + [-math.inf] * len(t)
    for a in range(len(t)):
        for z in range(a + 1, min(len(t), a + MODEL.longest) + 1):
            if (i := MODEL.ids.get(t[a:z])) is not None:
                top[z] = max(top[z], top[a] + MODEL.scores[i] / 16)
        if t[a] not in MODEL.ids:
            top[a + 1] = max(top[a + 1], top[a] + MODEL.unknown / 16)
    return top[-1]


def test_count_query(docs, spark):
    rows = token_counts.count_tokens(docs).collect()
    assert len(rows) == docs.count()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((d.doc_id, len(LIBRARY.encode(d.text or ""))) for d in docs.collect())
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def segmentations(text):
    """Every segmentation of a text with its probability."""
    t = MODEL.prefix + text.replace(" ", unigram.SPACE)
    out = {}

    def go(a, ids, score):
        if a == len(t):
            out[tuple(ids)] = math.exp(score)
            return
        for z in range(a + 1, min(len(t), a + MODEL.longest) + 1):
            if (i := MODEL.ids.get(t[a:z])) is not None:
                go(z, [*ids, i], score + MODEL.scores[i] / 16 * THETA)
        if t[a] not in MODEL.ids:
            go(a + 1, ids + MODEL.byte_ids(t[a]), score + MODEL.unknown / 16 * THETA)

    go(0, [], 0.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


THETA = 0.15
FLAT = gumbel.Lattices(MODEL, THETA)


def test_samples_are_drawn_without_replacement():
    text, n, k = "of it", 4000, 3
    p = segmentations(text)
    found = gumbel.sample_texts(FLAT, [i * 7 for i in range(n)], [text] * n, k)
    first = Counter(tuple(x[0][0].tolist()) for x in found)
    second = Counter((tuple(x[0][0].tolist()), tuple(x[1][0].tolist())) for x in found)
    top = sorted(p, key=p.get)[-4:]
    for a in top:
        assert first[a] / n == pytest.approx(p[a], abs=5 * math.sqrt(p[a] / n))
        for b in top:
            if a != b:
                both = p[a] * p[b] / (1 - p[a])
                assert second[(a, b)] / n == pytest.approx(both, abs=5 * math.sqrt(both / n))
    for x in found:
        keys = [tuple(s[0].tolist()) for s in x]
        assert len(set(keys)) == k
        assert all(s[1] == pytest.approx(math.log(p[key]), abs=1e-6) for s, key in zip(x, keys, strict=True))
        assert x[0][2] > x[1][2] > x[2][2]
    # with the inclusion scores the weights estimate the whole mass without bias
    assert np.mean([sum(math.exp(s[1] - s[3]) for s in x) for x in found]) == pytest.approx(1, abs=0.03)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_samples_decode_to_the_text(text):
    for ids, log_p, _, inclusion in gumbel.sample_texts(STORE, [3], [text], 3)[0]:
        assert MODEL.decode(ids.tolist()) == text.replace(unigram.SPACE, " ")
        assert log_p <= 1e-9 and inclusion <= 1e-9


def test_few_segmentations():
    (only,) = gumbel.sample_texts(STORE, [1], [""], 3)[0]
    assert (only[0].tolist(), only[1], only[3]) == ([], 0.0, 0.0)


def test_sample_query(docs, spark):
    rows = gumbel.sample(docs, k=2).collect()
    by_text = {(d.doc_id, d.text) for d in docs.collect()}
    assert {r.doc_id for r in rows} == {i for i, _ in by_text}
    texts = {}
    for i, t in by_text:
        texts.setdefault(i, set()).add(t or "")
    for r in rows:
        assert MODEL.decode(r.ids) in texts[r.doc_id] and r.n_pieces == len(r.ids)
    # repeated rows get equal samples, and batches do not matter
    assert len({(tuple(r.ids), r.score) for r in rows if r.doc_id == 8}) == 2
    again = gumbel.sample(docs.coalesce(1), k=2).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    back = gumbel.decode(gumbel.sample(docs.filter("doc_id = 1"), k=1)).collect()
    assert back[0].text == docs.filter("doc_id = 1").first().text
    assert gumbel.sample(docs.limit(0)).count() == 0


def test_a_worker_keeps_a_bounded_store(monkeypatch):
    """What is kept is bounded by edges, not by segments, which may be long; forgetting and building by pieces change no sample."""
    rng = np.random.default_rng(31)
    some = ["".join(rng.choice(list("etaoin shrdlu"), 400)) for _ in range(40)]
    model = unigram.load()
    whole = gumbel.Lattices(model, 1.0)
    want = gumbel.sample_texts(whole, list(range(40)), some, 2)
    monkeypatch.setattr(gumbel, "STORE_EDGES", 2000)
    monkeypatch.setattr(gumbel, "BUILT_CHARS", 50)
    store = gumbel.Lattices(model, 1.0)
    got, most = [], 0
    for i, text in enumerate(some):
        got += gumbel.sample_texts(store, [i], [text], 2)
        most = max(most, len(store.p))
    assert most < 2000 + 400 * 20 < len(whole.p)
    for a, b in zip(want, got, strict=True):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b] and [x[1:] for x in a] == [x[1:] for x in b]
