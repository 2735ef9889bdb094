"""Hashes of word runs: one polynomial prefix sum over a batch's bytes gives the hash of any run of words."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers[0], _powers[1]


class Words:
    """The words of a batch of texts, joined by single blanks, texts one after another.

    joined: bytes of all; start, end: byte places of each word; text: which text a word is of; first: the
    place among words of each text's first word (one more entry closes the last).
    """

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]  # bytes split at [\x20\x09-\x0D] exactly
        self._measure(b" ".join([w for words in split for w in words]), np.array([len(w) for w in split], np.int64))

    @classmethod
    def of_joined(cls, joined: bytes, counts: np.ndarray) -> Words:
        """From texts that are joined already, and their numbers of words."""
        self = cls.__new__(cls)
        self._measure(joined, counts)
        return self

    def _measure(self, joined: bytes, counts: np.ndarray) -> None:
        self.joined = joined
        self.first = np.r_[0, np.cumsum(counts)]
        self.raw = np.frombuffer(self.joined, np.uint8)
        self.text = np.repeat(np.arange(len(counts)), counts)
        blanks = np.flatnonzero(self.raw == 32)
        self.start = np.r_[0, blanks + 1] if len(self.text) else np.zeros(0, np.int64)
        self.end = np.r_[blanks, len(self.raw)] if len(self.text) else np.zeros(0, np.int64)
        power, self._inverse = _power_tables(len(self.raw) + 1)
        with np.errstate(over="ignore"):
            self._prefix = np.r_[np.uint64(0), np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[: len(self.raw)])]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end; equal bytes, equal hashes."""
        with np.errstate(over="ignore"):
            return mix((self._prefix[end] - self._prefix[start]) * self._inverse[start])

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word's place, and hash, of all runs of so many consecutive words of one text."""
        last = len(self.text) - length + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[:last] == self.text[length - 1 :])
        return at, self.hashes(self.start[at], self.end[at + length - 1])


def shingle_sets(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; a text of fewer words is one shingle, none if empty."""
    words = Words(texts)
    at, found = words.runs(length)
    bounds = np.searchsorted(at, words.first)
    out = []
    for i in range(len(texts)):
        first, last = words.first[i], words.first[i + 1]
        if last - first >= length:
            out.append(np.unique(found[bounds[i] : bounds[i + 1]]))
        elif last > first:
            out.append(words.hashes(words.start[first : first + 1], words.end[last - 1 : last]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
