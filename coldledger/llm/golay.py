"""The binary Golay code of 23 bits: which codewords lie near a word.

Every word lies within 3 bits of exactly one codeword, its nearest. Words whose nearest codeword is 3
bits away have five more codewords at distance 4. So if two words differ in one bit, the nearest
codeword of either is among the up to six codewords within 4 bits of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS, NEAR = 23, 11, 6
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndrome(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each bit, and for each syndrome the error patterns of weight 4 or less (-1: none).

    The first pattern of a row is the lightest, the step to the nearest codeword.
    """
    bits = np.array([_syndrome(1 << i) for i in range(LENGTH)], dtype=np.int64)
    errors = np.full((1 << CHECKS, NEAR), -1, dtype=np.int64)
    used = np.zeros(1 << CHECKS, dtype=np.int64)
    for weight in range(5):
        for positions in combinations(range(LENGTH), weight):
            s = int(np.bitwise_xor.reduce(bits[list(positions)])) if positions else 0
            errors[s, used[s]] = sum(1 << p for p in positions)
            used[s] += 1
    return bits, errors


def near_indices(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of each codeword within 4 bits of each word, the nearest first; -1: no more."""
    bits, errors = tables()
    syndromes = np.zeros(len(words), dtype=np.int64)
    for i in range(LENGTH):
        syndromes ^= np.where(words >> i & 1, bits[i], 0)
    steps = errors[syndromes]
    return np.where(steps < 0, -1, (words[:, None] ^ steps) >> CHECKS)
