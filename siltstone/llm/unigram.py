"""A unigram language model over the pieces of a SentencePiece model file.

The file's pieces are taken as they are. A BPE model has merge ranks and no
probabilities, so its normal pieces get Zipf's law over their rank: the piece of
rank r (1 for the first merge) has probability 1 / (r H), H the sum that makes
them add up to 1. Log-probabilities are rounded to multiples of 1/16; sums of
them are exact even in the 32-bit floats that tokenizer libraries add up, up to
2 ** 20 nats, so scores, ties and counts do not depend on where a text is cut.
A unigram model file keeps its own scores, rounded likewise.

No piece has white space inside a word, so a text falls into segments (a run of
blanks with the word behind it, or a line feed) that no piece crosses.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCALE = 16
SPACE = "▁"
#: Fixed value: how much worse than the worst piece an unknown character scores, in nats.
UNKNOWN_PENALTY = 10
NORMAL, BYTE, UNIGRAM, BPE = 1, 6, 1, 2


class Unigram:
    """Pieces, their scores in sixteenths of a nat, and the ids of bytes."""

    def __init__(self, path: str = DEFAULT_MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError(f"{path}: only models that keep the text as it is are supported")
        self.prefix = SPACE if proto.normalizer_spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if len(self.bytes) != 256:
            raise ValueError(f"{path}: only models with byte fallback are supported")
        normal = [i for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        if proto.trainer_spec.model_type == BPE:
            ranked = sorted(normal, key=lambda i: (-proto.pieces[i].score, i))
            total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
            self.scores = {i: -round(SCALE * (math.log(r) + total)) for r, i in enumerate(ranked, 1)}
        else:
            self.scores = {i: round(SCALE * proto.pieces[i].score) for i in normal}
        self.unknown = min(self.scores.values()) - SCALE * UNKNOWN_PENALTY
        self.ids = {self.pieces[i]: i for i in normal}
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in self.ids):
            raise ValueError(f"{path}: a piece crosses a word boundary")
        self._proto = proto

    def library_model(self) -> bytes:
        """The same model as a file for the sentencepiece library, to test against."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.CopyFrom(self._proto)
        proto.trainer_spec.model_type = UNIGRAM
        for i, s in self.scores.items():
            proto.pieces[i].score = s / SCALE
        return proto.SerializeToString()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_proto"}

    def segments(self, text: str) -> list[str]:
        """The segments of a text, blanks and all; the empty text has none. A blank and ▁ are the same to the model."""
        return SEGMENT.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, exactly as it was encoded (▁ comes back as a blank)."""
        back = self.byte_values
        raw = b"".join(bytes((back[i],)) if i in back else self.pieces[i].encode() for i in ids)
        text = raw.decode().replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    @property
    def byte_values(self) -> dict[int, int]:
        if "_byte_values" not in self.__dict__:
            self._byte_values = {i: b for b, i in self.bytes.items()}
        return self._byte_values


SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_MODEL) -> Unigram:
    return Unigram(path)
