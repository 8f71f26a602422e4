"""Approximate matching of a constant region in many reads at a time, bit-parallel.

One machine word a read holds the differences of a whole column of the edit-distance table, so a character costs a dozen word
operations whatever the pattern's length (up to WORD_BITS characters; longer patterns keep the column itself).  numpy runs
each step over all reads of an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORD_BITS = 64
#: Error probability of each ASCII symbol.
_ERROR = np.power(10.0, -(np.arange(128) - 33) / 10.0)


class Reads:
    """Code points of a string column: ``points``, and where each read begins and how long it is (null: empty)."""

    def __init__(self, column: pa.Array) -> None:
        texts = ["" if t is None else t for t in column.to_pylist()]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)

    def at(self, place: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The code points at places (any value where ``inside`` is false)."""
        return self.points[np.where(inside, place, 0)] if len(self.points) else np.zeros(len(place), np.uint32)


class _Words:
    """Edit distances of a pattern of at most WORD_BITS characters to growing texts; ``free`` lets a match begin anywhere."""

    def __init__(self, pattern: str, n: int, free: bool) -> None:
        letters = sorted(set(pattern))
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.masks = np.array([sum(1 << k for k, x in enumerate(pattern) if x == c) for c in letters], np.uint64)
        self.top, self.first = np.uint64(len(pattern) - 1), np.uint64(0 if free else 1)
        self.plus, self.minus, self.score = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64), np.full(n, len(pattern), np.int64)

    def step(self, char: np.ndarray, on: np.ndarray) -> None:
        """One more character of each text that is ``on``."""
        one = np.uint64(1)
        place = np.minimum(np.searchsorted(self.letters, char), len(self.letters) - 1)
        equal = np.where(self.letters[place] == char, self.masks[place], np.uint64(0))
        x = equal | self.minus
        diagonal = (((x & self.plus) + self.plus) ^ self.plus) | x
        right_minus = self.plus & diagonal
        right_plus = self.minus | ~(self.plus | diagonal)
        change = ((right_plus >> self.top) & one).astype(np.int64) - ((right_minus >> self.top) & one).astype(np.int64)
        right_plus = (right_plus << one) | self.first
        plus = (right_minus << one) | ~(diagonal | right_plus)
        self.minus = np.where(on, diagonal & right_plus, self.minus)
        self.plus = np.where(on, plus, self.plus)
        self.score += np.where(on, change, 0)


class _Columns:
    """The same for patterns of any length, with the table's column itself."""

    def __init__(self, pattern: str, n: int, free: bool) -> None:
        self.pattern, self.free = np.array([ord(c) for c in pattern], np.uint32), free
        self.steps = np.arange(len(pattern) + 1)
        self.column = np.tile(self.steps, (n, 1))

    @property
    def score(self) -> np.ndarray:
        return self.column[:, -1]

    def step(self, char: np.ndarray, on: np.ndarray) -> None:
        new = np.empty_like(self.column)
        new[:, 0] = 0 if self.free else self.column[:, 0] + 1
        new[:, 1:] = np.minimum(self.column[:, :-1] + (self.pattern != char[:, None]), self.column[:, 1:] + 1)
        new = np.minimum.accumulate(new - self.steps, axis=1) + self.steps
        self.column = np.where(on[:, None], new, self.column)


def _table(pattern: str, n: int, free: bool = False) -> _Words | _Columns:
    return (_Words if len(pattern) <= WORD_BITS else _Columns)(pattern, n, free)


def anchored(reads: Reads, start: np.ndarray, length: np.ndarray, pattern: str, errors: int, least: int = 0, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(edits, length) of the stretch that is nearest to ``pattern`` among those that begin at ``start`` and have ``least`` and
    len(pattern) - errors to len(pattern) + errors characters; of equally near ones that whose length is nearest to the pattern's, then the shorter.

    ``length`` characters are there; longer stretches end with them.  With ``backwards`` stretches end before ``start`` and run to the left.
    """
    n = len(pattern)
    table = _table(pattern[::-1] if backwards else pattern, len(start))
    best, taken = np.full(len(start), np.iinfo(np.int64).max), np.zeros(len(start), np.int64)
    for k in range(n + errors + 1):
        if k:
            on = length >= k
            table.step(reads.at(start - k if backwards else start + k - 1, on), on)
        if k >= max(n - errors, least):
            rank = (table.score * (errors + 1) + abs(k - n)) * (2 * n + 2) + k
            better = rank < best
            best, taken = np.where(better, rank, best), np.where(better, k, taken)
    return best // ((errors + 1) * (2 * n + 2)), taken


def distances(reads: Reads, rows: np.ndarray, pattern: str) -> np.ndarray:
    """Edit distance of ``pattern`` to each of these reads as a whole."""
    length, start = reads.length[rows], reads.start[rows]
    if not pattern:
        return length
    table = _table(pattern, len(rows))
    for k in range(int(length.max(initial=0))):
        on = length > k
        table.step(reads.at(start + k, on), on)
    return table.score


def first_within(reads: Reads, patterns: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first pattern within ``most`` edits or -1, edits to it) of each read; a read that has one is not compared further."""
    found, edits, open_ = np.full(len(reads.length), -1, np.int64), np.zeros(len(reads.length), np.int64), np.arange(len(reads.length))
    for k, p in enumerate(patterns):
        near = open_[np.abs(reads.length[open_] - len(p)) <= most]
        d = distances(reads, near, p)
        hit = near[d <= most]
        found[hit], edits[hit] = k, d[d <= most]
        open_ = open_[found[open_] < 0]
    return found, edits


def greedy_seeds(reads: Reads, texts: list[str], most: int, room: int) -> list[str]:
    """Of reads in order, those farther than ``most`` edits from every one taken before, at most ``room``."""
    out, open_ = [], np.arange(len(texts))
    while len(open_) and len(out) < room:
        out.append(texts[open_[0]])
        open_ = open_[distances(reads, open_, out[-1]) > most]
    return out


def prefix_cuts(reads: Reads, pattern: str, errors: int) -> np.ndarray:
    """How many leading characters are ``pattern`` within ``errors`` edits (0 if none)."""
    edits, k = anchored(reads, reads.start, reads.length, pattern, errors)
    return np.where(edits <= errors, np.minimum(k, reads.length), 0)


def suffix_cuts(reads: Reads, pattern: str, errors: int, after: np.ndarray | int = 0) -> np.ndarray:
    """How many trailing characters are ``pattern``, in what is left without the first ``after`` characters."""
    left = reads.length - after
    edits, k = anchored(reads, reads.start + reads.length, left, pattern, errors, backwards=True)
    return np.where(edits <= errors, np.minimum(k, left), 0)


def interior(reads: Reads, pattern: str, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """(start from 0 or -1, length) of the first stretch within ``errors`` edits of ``pattern``; of those that begin there, the nearest.

    One scan from the right finds all places at which a stretch may begin, one more from the first of them its length.
    """
    n = len(reads.length)
    table, found = _table(pattern[::-1], n, free=True), np.full(n, -1, np.int64)
    for k in range(1, int(reads.length.max(initial=0)) + 1):
        on = reads.length >= k
        place = reads.length - k
        table.step(reads.at(reads.start + place, on), on)
        found = np.where(on & (table.score <= errors), place, found)
    at = np.maximum(found, 0)
    _, k = anchored(reads, reads.start + at, reads.length - at, pattern, errors, least=1)
    return found, k


def mean_errors(quality: Reads, skip: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Mean of 10^(-Q/10) of ``length`` Phred+33 symbols after the first ``skip``; NaN for none.  Added up from the left."""
    total = np.zeros(len(skip))
    for k in range(int(length.max(initial=0))):
        on = length > k
        symbol = quality.at(quality.start + skip + k, on)
        error = _ERROR[np.minimum(symbol, 127)] if symbol.max(initial=0) < 128 else np.power(10.0, -(symbol.astype(np.int64) - 33) / 10.0)
        total += np.where(on, error, 0.0)
    return np.divide(total, length, out=np.full(len(skip), np.nan), where=length > 0)
