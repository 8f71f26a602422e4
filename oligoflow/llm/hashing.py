"""Vectorised word, line and window hashes over UTF-8 buffers.

All hashes are polynomials modulo 2**64 whose symbols are random 64-bit values (one per byte, or the
finalised hash of a word).  With random symbols two different strings meet with a chance of about
2**-64, and prefix sums give every window of a text in a handful of numpy passes (Rabin-Karp).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240611))
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}

#: Word separators: space and the five control characters 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 12)
        base = BASES[kind]
        out = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = (out[0], out[1])
        if size <= 1 << 23:
            _POWERS[kind] = have
    return have


def powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    """At least the first ``n`` powers of a base or of its inverse."""
    return _powers(kind, n)[1 if inverse else 0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def prefix(symbols: np.ndarray, kind: str) -> np.ndarray:
    """Prefix sums whose differences give the hash of any range of ``symbols``."""
    n = len(symbols)
    out = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(symbols * _powers(kind, n + 1)[0][:n], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray, kind: str) -> np.ndarray:
    """Hashes of the ranges [start, end), equal for equal contents at any place."""
    inverse = _powers(kind, len(sums))[1]
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * inverse[start] + length * np.uint64(0xA0761D6478BD642F))


def words(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the index of each row's first word (with an end mark).

    A word is a maximal run of bytes that are no separators; rows never share a word.
    """
    letter = ~separator[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each word; ``lower`` folds A-Z."""
    table = BYTE_VALUE[LOWER_ASCII] if lower else BYTE_VALUE
    return ranges(prefix(table[raw], "byte"), start, end, "byte")


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``n`` words inside one row, and the windows' hashes."""
    at = np.arange(max(0, len(hashes) - n + 1))
    row_end = np.repeat(rows[1:], np.diff(rows))
    at = at[at + n <= row_end[: len(at)]]
    return at, ranges(prefix(hashes, "word"), at, at + n, "word")


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles: (row of each, hash).  A row of 1 to n-1 words is one shingle as a whole."""
    at, h = windows(hashes, rows, n)
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    owner = row_of[at]
    short = np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) < n))
    if len(short):
        whole = ranges(prefix(hashes, "word"), rows[short], rows[short + 1], "word")
        owner, h = np.concatenate([owner, short]), np.concatenate([h, whole])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the windows of ``n`` places that begin at ``at``."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def sums_by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's range (empty rows: 0)."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


#: Slice for work that makes many arrays of each text at a time.
SMALL_SLICE = 1 << 20


def pieces(batches, text_col: str = "text", size: int = 4 << 20):
    """Slices of Arrow batches with about ``size`` bytes of text each; one longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
