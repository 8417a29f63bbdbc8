"""The perfect binary Golay code of length 23, decoded in bulk."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

# Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, PARITY = 23, 11


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1, PARITY - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - PARITY)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; per syndrome the error patterns of weight at most 4, and their number."""
    low = np.array([_remainder(i) for i in range(1 << 12)], dtype=np.uint16)
    high = np.array([_remainder(i << 12) for i in range(1 << 11)], dtype=np.uint16)
    patterns = np.zeros((1 << PARITY, 6), dtype=np.uint32)
    counts = np.zeros(1 << PARITY, dtype=np.int8)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            pattern = sum(1 << b for b in bits)
            syndrome = int(low[pattern & 0xFFF] ^ high[pattern >> 12])
            patterns[syndrome, counts[syndrome]] = pattern
            counts[syndrome] += 1
    return low, high, patterns, counts


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within distance 4 of each 23-bit word, nearest first: an (n, 6) table and how many count.

    The code is perfect, so the first is within distance 3 and unique. Five more lie at distance 4 when the first is at
    distance 3, none otherwise. If two words differ in at most one bit, the nearest codeword of either is within
    distance 4 of the other.
    """
    low, high, patterns, counts = _tables()
    words = words.astype(np.uint32)
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return ((words[:, None] ^ patterns[syndrome]) >> PARITY).astype(np.uint64), counts[syndrome]


@cache
def _signs() -> np.ndarray:
    """Every codeword as a column of -1 and 1."""
    index = np.arange(1 << (LENGTH - PARITY), dtype=np.uint32) << PARITY
    low, high, _, _ = _tables()
    words = index ^ low[index & 0xFFF] ^ high[index >> 12]
    return ((words[None, :] >> np.arange(LENGTH, dtype=np.uint32)[:, None] & 1) * 2.0 - 1).astype(np.float32)


def nearest(weights: np.ndarray, number: int, block: int = 512) -> np.ndarray:
    """Soft decoding: indices of the ``number`` codewords that agree best with each row of 23 signed weights.

    Ties go to the smaller index; weights that are whole numbers are added without rounding."""
    out = np.empty((len(weights), number), np.int64)
    for at in range(0, len(weights), block):
        score = weights[at : at + block].astype(np.float32) @ _signs()
        rows = np.arange(len(score))
        for k in range(number):
            best = score.argmax(axis=1)
            out[at : at + block, k] = best
            score[rows, best] = -np.inf
    return out
