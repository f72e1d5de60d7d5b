"""Words, their hashes and word windows of many texts at once, as NumPy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_LETTER = numbers(256, 1)
_PLACE = numbers(4096, 2)


def lowered() -> np.ndarray:
    """A table that makes A-Z lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def letters(*gaps: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to words; bytes in the ranges ``gaps`` separate them."""
    table = np.ones(256, bool)
    for a, b in gaps:
        table[a:b + 1] = False
    return table


@dataclass
class Words:
    """Words of several texts: where each begins and ends, its hash, and the first word of each text (and one past the last)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def windows(self, size: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the ``size`` words from each word on, and whether they lie in one text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, bool)
        with np.errstate(over="ignore"):
            total = np.zeros(n, U64)
            for k, factor in enumerate(numbers(size, seed) | U64(1)):
                total += self.hashes[k:k + n] * factor
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return mixed(total), text[:n] == text[size - 1:]


def split_words(data: np.ndarray, offsets: np.ndarray, is_letter: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; positions are those in ``data``."""
    base = int(offsets[0])
    block = data[base:int(offsets[-1])]
    inside = is_letter[block]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = (offsets[:-1] - base)[offsets[:-1] < offsets[-1]]
    begins[borders] = inside[borders]  # a word that ends a text doesn't go on in the next
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(*(np.zeros(0, np.int64),) * 2, np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    at = np.flatnonzero(inside)
    lead = np.flatnonzero(begins[at])  # of each word's first byte, the place among all its bytes
    sizes = np.diff(np.append(lead, len(at)))
    place = np.arange(len(at)) - np.repeat(lead, sizes)
    if (longest := int(sizes.max())) <= len(_PLACE):
        factors = _PLACE[place]
    else:
        factors = numbers(longest, 2)[place]
    with np.errstate(over="ignore"):
        hashes = mixed(np.add.reduceat(_LETTER[block[at]] * factors, lead) + sizes.astype(U64))
    return Words(starts + base, starts + sizes + base, hashes, np.searchsorted(starts + base, offsets))
