"""Multisets of word shingles of many texts at once (numpy)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import xxhash

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hashes of words; starts afresh when it holds ``limit`` words."""

    limit = 300_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h


_HASHES = WordHashes()


def shingles(texts: Sequence[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, element, count, key): the distinct shingles of each text, in order of doc, each with its count; and for each
    text 64 bits that stand for its sequence of words.

    Words are the lower-cased stretches between white space.  A text of fewer words than ``size``, but at least one, has
    one shingle of all its words; a text without words has none."""
    words = [(x or "").lower().split() for x in texts]
    if len(_HASHES) >= _HASHES.limit:
        _HASHES.clear()
    n = np.fromiter(map(len, words), np.int64, len(words))
    total = int(n.sum())
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), U, total)
    ends = np.cumsum(n)
    starts = ends - n
    factor = U(0x9E3779B97F4A7C15)
    # Sum over the words of hash * odd constant ** place, forward from each place.
    roll = h.copy()
    for k in range(1, size):
        roll = roll * factor
        roll[: total - k] += h[k:]
        # Places whose window reaches over the end of a text are left out below.
    short = np.flatnonzero((n > 0) & (n < size))
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(words)), count)
    at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    element = mix(roll[at])
    if len(short):
        place = (np.cumsum(count) - count)[short]
        element[place] = [xxhash.xxh3_64_intdigest(" ".join(words[i])) for i in short]
    index = np.arange(total, dtype=U) - np.repeat(starts, n).astype(U)
    key = np.zeros(len(words), U)
    filled = np.flatnonzero(n > 0)
    if len(filled):
        key[filled] = np.add.reduceat(mix(mix(h) ^ (index * factor + U(1))), starts[filled])
    key = mix(key ^ n.astype(U))
    # One sort brings equal shingles of a text together: the text's number is in the top bits.
    bits = U(max(1, int(len(words)).bit_length()))
    both = np.sort((doc.astype(U) << (U(64) - bits)) | (element >> bits))
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(both)]]))
    both = both[first]
    # A shingle's number must not depend on the batch, so it keeps the same bits in each.
    return (both >> (U(64) - bits)).astype(np.int64), (both << bits) >> U(16), counts, key
