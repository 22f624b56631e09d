"""Words, word n-grams and their hashes for the operators that compare documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ascii_lower

MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column, gap: str, lower: bool) -> Column:
    """64-bit hashes of the words between gaps, as an array of longs."""
    words = F.array_remove(F.split(ascii_lower(text) if lower else text, gap), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each position, as if all texts were one."""
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for i in range(n):
        out = mixed(out * MIX + words[i : i + len(out)])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = w - have
    return np.minimum(out[:-rest], out[rest:]) if rest and len(out) > rest else out if not rest else out[:0]
