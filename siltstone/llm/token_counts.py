"""Token counts without tokens.

Aho-Corasick enumerates the vocabulary's matches in a segment and a Viterbi pass
carries only the best score and its piece count for the last few positions. Of
equally good paths into a position the longest last piece wins, and an unknown
character loses to any piece, as in the tokenizer. A count is a sum over the
segments, so each distinct segment is worked out once for a worker's cache.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import unigram
from .common import map_texts
from .unigram import SCALE, Unigram

#: Segments kept by a worker, and their greatest length; the cache starts anew when it is full.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: A cached value holds minus the score, in sixteenths, above these bits and the count below.
SHIFT = 32
_counters: dict[str, PieceCounts] = {}


class PieceCounts(dict):
    """Maps a segment to its packed score and count."""

    def __init__(self, model: Unigram):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for piece, i in model.ids.items():
            self.automaton.add_word(piece, (len(piece), model.scores[i]))
        self.automaton.make_automaton()
        self.singles = {p for p in model.ids if len(p) == 1}

    def __missing__(self, segment: str) -> int:
        score, count = self.best(segment)
        packed = (-score << SHIFT) + count
        if len(segment) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[segment] = packed
        return packed

    def best(self, segment: str) -> tuple[int, int]:
        """Score in sixteenths and piece count of the best path; holds no more than the longest piece's positions."""
        ring, unknown, singles = self.model.longest + 1, self.model.unknown, self.singles
        scores, counts = [0] * ring, [0] * ring
        matches = self.automaton.iter(segment)
        match = next(matches, None)
        for end, char in enumerate(segment):
            best = None
            length = count = 0
            while match is not None and match[0] == end:
                n, s = match[1]
                at = (end + 1 - n) % ring
                s += scores[at]
                if best is None or s > best or s == best and n > length:
                    best, length, count = s, n, counts[at] + 1
                match = next(matches, None)
            if char not in singles:
                at = end % ring
                s = scores[at] + unknown
                if best is None or s > best:
                    best, count = s, counts[at] + len(char.encode())
            at = (end + 1) % ring
            scores[at], counts[at] = best, count
        at = len(segment) % ring
        return scores[at], counts[at]

    def total(self, text: str) -> tuple[int, int]:
        packed = sum(map(self.__getitem__, self.model.segments(text)))
        return -(packed >> SHIFT), packed & ((1 << SHIFT) - 1)


def counter(path: str) -> PieceCounts:
    if path not in _counters:
        _counters[path] = PieceCounts(unigram.load(path))
    return _counters[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = unigram.DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens and the best path's score in nats, one row for each row of docs; no shuffle.

    Null and empty texts have no tokens and score 0; rows that repeat come out as
    often; an empty table gives an empty one; other columns are not read. A long
    segment takes time in proportion and memory for its last few positions; of
    equally good paths the tokenizer's own counts. `model` is a file that every
    executor has.
    """

    def rows(ids, texts):
        found = [counter(model).total(t) for t in texts]
        return {"doc_id": ids, "n_tokens": [n for _, n in found], "score": [s / SCALE for s, _ in found]}

    return map_texts(docs, id_col, text_col, rows, "doc_id bigint, n_tokens bigint, score double")
