"""The public BLAKE3 hash of short messages, for names of colliding columns."""

from __future__ import annotations

import struct

# Fixed values of the published specification: initial vector, message order, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK = 64, 1024
COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def compress(state: tuple, block: tuple, counter: int, size: int, flags: int) -> tuple:
    """The eight words that a block turns a chaining value into."""
    v = [*state, *IV[:4], counter & 0xFFFFFFFF, counter >> 32, size, flags]
    words = block
    for _ in range(7):
        for i, (a, b, c, d) in enumerate(COLUMNS):
            for word, down, left in ((words[2 * i], 16, 12), (words[2 * i + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & 0xFFFFFFFF
                v[d] = turned(v[d] ^ v[a], down)
                v[c] = (v[c] + v[d]) & 0xFFFFFFFF
                v[b] = turned(v[b] ^ v[c], left)
        words = tuple(words[i] for i in ORDER)
    return tuple(v[i] ^ v[i + 8] for i in range(8))


def turned(x: int, n: int) -> int:
    return (x >> n | x << (32 - n)) & 0xFFFFFFFF


def words_of(block: bytes) -> tuple:
    return struct.unpack("<16I", block.ljust(BLOCK, b"\0"))


def chunk(data: bytes, counter: int, root: bool) -> tuple:
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
    state = IV
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        flags = (CHUNK_START if i == 0 else 0) | (CHUNK_END | (ROOT if root else 0) if last else 0)
        state = compress(state, words_of(block), counter, len(block), flags)
    return state


def subtree(data: bytes, counter: int, root: bool) -> tuple:
    """The value of the tree over data, whose left side is the largest power of two of chunks that leaves something."""
    if len(data) <= CHUNK:
        return chunk(data, counter, root)
    left = CHUNK
    while left * 2 < len(data):
        left *= 2
    both = subtree(data[:left], counter, False) + subtree(data[left:], counter + left // CHUNK, False)
    return compress(IV, both, 0, BLOCK, PARENT | (ROOT if root else 0))


def hexdigest(data: bytes) -> str:
    return struct.pack("<8I", *subtree(data, 0, True)).hex()
