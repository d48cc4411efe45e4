"""Vectorised hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: An odd number and its inverse modulo 2**64: a run's hash doesn't depend on where it stands.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words that are hashed at once; longer texts go in pieces.
UNIT = 50_000

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            row = np.full(max(n, 1 << 19), b, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Text:
    """Words in a row, parted by one space (or line feed), with the places where each starts and ends."""

    def __init__(self, joined: bytes):
        self.joined = joined
        data = np.frombuffer(joined, np.uint8)
        up, self._down = _grown(len(data) + 1)
        self.ends = np.append(np.flatnonzero((data == 32) | (data == 10)), len(data))
        self.starts = np.append(0, self.ends[:-1] + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each run from word `first` to word `last`, spaces included: equal for equal runs."""
        a, b = self.starts[first], self.ends[last]
        return mix((self._sums[b] - self._sums[a]) * self._down[a])


def units(rows: Iterable[list[bytes]], overlap: int = 0) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Rows' words gathered to about UNIT words: (words, [(row, place of the first word in the row, words)]).

    A longer row is cut into pieces that overlap by so many words.
    """
    words: list[bytes] = []
    parts: list[tuple[int, int, int]] = []
    for k, own in enumerate(rows):
        for at in range(0, max(len(own) - overlap, 1), UNIT):
            piece = own if len(own) <= UNIT + overlap else own[at : at + UNIT + overlap]
            words += piece
            parts.append((k, at, len(piece)))
            if len(words) >= UNIT:
                yield words, parts
                words, parts = [], []
            if piece is own:
                break
    if parts:
        yield words, parts
