"""MD5 of many short texts at once in numpy: what the bootstraps' seeded draws are made of, digest for digest as Spark's md5.

A message is a prefix that all share, or that each row has, and a number in decimal behind it.
Messages of one length differ in few of their words, so each step runs over arrays of those only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers that are taken at once: arrays that stay in a core's cache.
CHUNK = 32768


def block_step(state: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """The state after one block of sixteen words; all are uint32 arrays that broadcast."""
    a, b, c, d = state
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + (a + (words[g] + np.uint32(SINES[i])))
        s = SHIFTS[turn][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
    return [x + y for x, y in zip(state, (a, b, c, d))]


def md5_words(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The digests' four words (first byte highest) of messages given byte by byte: one uint32 array a byte, arrays that broadcast."""
    n = len(columns)
    size = (n + 8) // 64 * 64 + 64
    fixed = lambda v: np.array([v], dtype=np.uint32)
    padded = [*columns, fixed(128), *[fixed(0)] * (size - n - 9), *[fixed(8 * n >> 8 * k & 255) for k in range(8)]]
    words = []
    for i in range(0, size, 4):
        p, q, r, s = padded[i : i + 4]
        words.append(p | q << np.uint32(8) | r << np.uint32(16) | s << np.uint32(24))
    state = [fixed(v) for v in START]
    for i in range(0, len(words), 16):
        state = block_step(state, words[i : i + 16])
    return [x.byteswap() for x in state]


def decimals(first: int, last: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """first, last and the digits (as bytes) of runs of numbers from first to before last: each of one length, at most CHUNK long."""
    while first < last:
        width = len(str(first))
        end = min(last, 10**width, first + CHUNK)
        numbers = np.arange(first, end, dtype=np.int64)
        yield first, end, [((numbers // 10 ** (width - 1 - k)) % 10 + 48).astype(np.uint32) for k in range(width)]
        first = end


def constant(text: bytes) -> list[np.ndarray]:
    return [np.array([b], dtype=np.uint32) for b in text]


def picks(prefixes: list[bytes], size: int, modulus: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each prefix (by its place) and run of numbers below size: the first 32 bits of the digests, modulo modulus."""
    for _, _, digits in decimals(0, size):
        for i, prefix in enumerate(prefixes):
            yield i, np.broadcast_to(md5_words([*constant(prefix), *digits])[0], digits[0].shape) .astype(np.int64) % modulus
