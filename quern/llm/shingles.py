"""Word-shingle sets of whole texts as sorted 64-bit hashes (Python side, vectorised)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

WIDTH = 5


def scramble(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Odd multipliers, one for each place of a shingle, so that the order of its words counts: scrambled steps of a Weyl
#: sequence. No sum of some of them with signs is 0 or a multiple of 2^6, so two shingles that differ collide for at most
#: one in 2^59 of the word hashes, also where words repeat.
_PLACES = scramble(np.array([k * 0x9E3779B97F4A7C15 % 2**64 for k in range(1, WIDTH + 1)], dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text; with fewer words the whole sequence as one; else empty.

    Words are runs of anything but 0x20 and 0x09 to 0x0D, with A-Z in lower case: exactly what bytes.split() and
    bytes.lower() do.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = len(hashes)
    if n < WIDTH:
        return scramble((hashes * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = hashes[: n - WIDTH + 1] * _PLACES[0]
    for k in range(1, WIDTH):
        total += hashes[k : n - WIDTH + 1 + k] * _PLACES[k]
    return np.unique(scramble(total))


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
