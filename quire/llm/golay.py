"""Fuzzy hashing with the binary Golay code (23, 12).

The code is perfect: every 23-bit vector lies within 3 bits of exactly one codeword. A vector's keys are the codewords
nearest to it and to each of its 23 neighbours: one key if it lies within 2 bits of its codeword, else six. Two vectors
that differ in at most two bits have a common neighbour (or are neighbours), hence a common key; and of two vectors that
differ in at most one bit, the nearest codeword of either is a key of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
N, CHECK = 23, 11
KEYS = 6


@cache
def columns() -> tuple[int, ...]:
    """Syndrome of each single-bit vector: its remainder modulo the generator."""
    out, x = [], 1
    for _ in range(N):
        out.append(x)
        x <<= 1
        if x >> CHECK:
            x ^= GENERATOR
    return tuple(out)


def syndromes(v: np.ndarray) -> np.ndarray:
    s = np.zeros(len(v), np.int64)
    for k, c in enumerate(columns()):
        s ^= np.where((v >> k) & 1, c, 0)
    return s


@cache
def offsets() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the vectors that lead to its keys (repeated where there is only one key), and the number of keys.

    Offset 0 leads to the nearest codeword.
    """
    leader = np.zeros(1 << CHECK, np.int64)
    col = columns()
    for weight in (1, 2, 3):
        for bits in combinations(range(N), weight):
            s = v = 0
            for b in bits:
                s, v = s ^ col[b], v | 1 << b
            leader[s] = v
    table, count = np.zeros((1 << CHECK, KEYS), np.int64), np.zeros(1 << CHECK, np.int64)
    for s in range(1 << CHECK):
        first = int(leader[s])
        rest = {(1 << b) ^ int(leader[s ^ col[b]]) for b in range(N)} - {first}
        own = [first, *sorted(rest)]
        count[s] = len(own)
        table[s] = own + [first] * (KEYS - len(own))
    return table, count


def keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the keys of each 23-bit vector, the nearest codeword first; and which of the six are not repetitions."""
    table, count = offsets()
    s = syndromes(v)
    return (v[:, None] ^ table[s]) >> CHECK, np.arange(KEYS) < count[s][:, None]
