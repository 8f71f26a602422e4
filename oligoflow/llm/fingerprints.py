"""Document fingerprints by winnowing (operator 11).

Every k code points of a text are a gram with a 32-bit rolling hash.  Of each window of w neighbouring grams the
smallest hash is kept, of equal ones the rightmost.  So any k + w - 1 code points that two texts share leave a mark in
both (the match guarantee), and marks are at most w places apart.  A fingerprint is the list of marks in order, ten hexadecimal
digits each: eight of the hash, two of the distance from the mark before (the first: from the beginning), which give
the marks' positions back.  A text shorter than k is one gram as a whole; an empty text has no marks.

The likeness of two fingerprints is the share of their distinct hashes that both have (1 if both are empty).

:func:`fingerprint` works on each row alone.  :func:`compare_to_next` needs a text and its successor together: rows
are dealt to ranges of ids, the first row of each range goes to the range before as well, and a task reads its range
in order, so every text travels once and none is ever held with more than the slice it is in.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as hs
from .base import partitions, stored

#: Code points of a gram, grams of a window.
GRAM, WINDOW = 16, 32
#: Code points hashed at a time; text of a slice of rows; text of a range of ids, about.
CHUNK, SLICE_BYTES, RANGE_BYTES = 1 << 20, 1 << 20, 64 << 20
#: Ranges at most (then they hold more text each): their borders are part of the plan.
MOST_RANGES = 4096
#: Keys looked at for each range to choose its borders.
KEYS_PER_RANGE = 20

_SYMBOL = hs.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_HEX = np.frombuffer(b"".join(b"%02x" % x for x in range(256)), np.uint8).reshape(256, 2)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offset of each."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), offsets


def grams(texts: list[str], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of all texts in order, and where each text's grams begin."""
    points, offsets = _points(texts)
    n = np.diff(offsets)
    count = np.where(n == 0, 0, np.maximum(n - gram + 1, 1))
    rows = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(rows[-1], np.uint32)
    long = np.flatnonzero(n >= gram)
    # first code points of all whole grams, and their places in the result
    start = np.concatenate([np.arange(offsets[r], offsets[r + 1] - gram + 1) for r in long]) if len(long) else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(rows[r], rows[r + 1]) for r in long]) if len(long) else start
    for lo in range(0, len(start), CHUNK):
        at = start[lo : lo + CHUNK]
        sums = hs.prefix(_SYMBOL[points[at[0] : at[-1] + gram]], "word")
        out[place[lo : lo + CHUNK]] = hs.ranges(sums, at - at[0], at - at[0] + gram, "word") >> np.uint64(32)
    for r in np.flatnonzero((n > 0) & (n < gram)):
        sums = hs.prefix(_SYMBOL[points[offsets[r] : offsets[r + 1]]], "word")
        out[rows[r]] = hs.ranges(sums, np.array([0]), np.array([n[r]]), "word")[0] >> np.uint64(32)
    return out, rows


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, position) of the marks of all texts, by row and position."""
    if not 1 <= window <= 255:
        raise ValueError("a window has 1 to 255 grams")
    h, rows = grams(texts, gram)
    counts = np.diff(rows)
    chosen = []
    ends = np.repeat(rows[1:], counts)
    for lo in range(0, len(h), CHUNK):
        part = h[lo : lo + CHUNK + window - 1]
        # hash above, place below and reversed: the minimum is the smallest hash and of equal ones the rightmost
        key = (part.astype(np.uint64) << np.uint64(32)) | (np.uint64(2**32 - 1) - np.arange(len(part), dtype=np.uint64))
        width = 1
        while 2 * width <= window:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < window:
            key = np.minimum(key[: -(window - width)], key[window - width :])
        first = np.arange(min(len(key), CHUNK))
        whole = lo + first + window <= ends[lo + first]
        chosen.append(lo + np.uint64(2**32 - 1).astype(np.int64) - (key[first[whole]] & np.uint64(2**32 - 1)).astype(np.int64))
    for r in np.flatnonzero((counts > 0) & (counts < window)):  # one window that holds all of them
        part = h[rows[r] : rows[r + 1]]
        chosen.append(np.array([rows[r + 1] - 1 - np.argmin(part[::-1])]))
    at = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
    row = np.searchsorted(rows, at, side="right") - 1
    return row, h[at], at - rows[row]


def encode(row: np.ndarray, h: np.ndarray, position: np.ndarray, texts: int) -> pa.Array:
    """A fingerprint for each of so many texts."""
    gap = np.diff(position, prepend=0)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    gap[first] = position[first]
    packed = np.empty((len(row), 5), np.uint8)
    packed[:, :4] = h.astype(">u4").view(np.uint8).reshape(-1, 4)
    packed[:, 4] = gap
    data = _HEX[packed].tobytes()
    offsets = np.concatenate([[0], np.cumsum(10 * np.bincount(row, minlength=texts))])
    return pa.LargeStringArray.from_buffers(texts, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)).cast(pa.string())


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of a fingerprint's marks."""
    packed = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return np.ascontiguousarray(packed[:, :4]).view(">u4").ravel().astype(np.uint32), np.cumsum(packed[:, 4].astype(np.int64))


def shared_places(a: str, b: str) -> list[tuple[int, int]]:
    """(position in a, position in b) of equal marks of two fingerprints, each of a with the first of b; by position in a."""
    (ha, pa_), (hb, pb) = decode(a), decode(b)
    where = dict(zip(hb[::-1].tolist(), pb[::-1].tolist(), strict=True))
    return [(p, where[h]) for h, p in zip(ha.tolist(), pa_.tolist(), strict=True) if h in where]


def _sets(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Distinct (row, hash) as one sorted number each."""
    return np.unique((row.astype(np.uint64) << np.uint64(32)) | h)


def likeness(a: np.ndarray, b: np.ndarray, texts: int) -> np.ndarray:
    """Shared of all distinct hashes for each row, of two results of :func:`_sets`."""
    row = lambda x: np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=texts)
    common = row(np.intersect1d(a, b, assume_unique=True))
    total = row(a) + row(b) - common
    return np.where(total == 0, 1.0, common / np.maximum(total, 1))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as many first code points of ``following``, or all of those."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprint(docs: DataFrame, text_col: str = "text", into: str = "fingerprint", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with the fingerprint of each text in a new last column ``into`` (one of that name is replaced).

    Null counts as empty: no marks.  Rows are independent: repeated rows and null ids don't matter.  A text of any length is
    hashed in steps, by a task that holds it.
    """
    kept = docs.drop(into)
    marked = kept.withColumn(into, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, into, SLICE_BYTES):
            texts = piece.column(piece.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], encode(*winnow(texts, gram, window), len(texts))], piece.schema.names)

    return marked.mapInArrow(run, marked.schema)


def _ranges(keys: DataFrame, n: int) -> tuple[list, list]:
    """Lower borders of all ranges but the first, and the smallest key of each range that has rows, in order.

    ``keys`` has (id, h).  What reaches the driver is KEYS_PER_RANGE keys a range; they place borders and decide nothing else.
    """
    if n > 1:
        some = keys.orderBy(F.xxhash64("id", "h", F.lit(11))).limit(KEYS_PER_RANGE * n).orderBy("id", "h").collect()
        borders = [(some[k]["id"], some[k]["h"]) for k in sorted({len(some) * i // n for i in range(1, n)})] if some else []
        borders = [b for k, b in enumerate(borders) if not k or b != borders[k - 1]]
    else:
        borders = []
    found = keys.withColumn("range", _range_of(borders)).groupBy("range").agg(F.min(F.struct("id", "h")).alias("first")).orderBy("range").collect()
    return borders, [(r["range"], r["first"]["id"], r["first"]["h"]) for r in found]


def _long(x: int | None) -> str:
    """SQL of a LONG or null."""
    return "cast(null AS long)" if x is None else f"cast('{x}' AS long)"


def _range_of(borders: list) -> Column:
    """Number of borders that (id, h) isn't below, by binary search; a null id is below all others."""
    steps = max(len(borders), 1).bit_length()
    values = ", ".join(f"named_struct('id', {_long(i)}, 'h', {_long(h)})" for i, h in borders)
    if not borders:
        return F.lit(0)
    return F.expr(f"""aggregate(sequence(1, {steps}), 0, (lo, s) -> CASE WHEN lo + shiftleft(1, {steps} - s) <= {len(borders)}
        AND get(array({values}), lo + shiftleft(1, {steps} - s) - 1) <= named_struct('id', id, 'h', h) THEN lo + shiftleft(1, {steps} - s) ELSE lo END)""")


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_to_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of ``docs`` (doc_id, text).

    The next text is that of the next greater doc_id; after the last comes the first; of one text it is itself.  A null id comes before all;
    rows that repeat an id follow each other by a hash of their texts (equal rows in any order, with each other as next);
    null text is empty; other columns are not read; no rows give no rows.  All rows of one id and text meet in one range, read as a stream.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    keys = stored(rows.select("id", "h", F.octet_length("text").alias("size")), "keys")
    n_bytes = keys.agg(F.sum("size")).first()[0] or 0
    borders, firsts = _ranges(keys, min(MOST_RANGES, max(partitions(docs.sparkSession), math.ceil(n_bytes / RANGE_BYTES))))
    # the smallest key of each range is a guest at the end of the range before that has rows; that of the first, of the last
    before = {r: (i, h, firsts[k - 1][0]) for k, (r, i, h) in enumerate(firsts)}
    kind = "struct<id:bigint,h:bigint,to:int>"
    places = ", ".join(f"named_struct('id', {_long(before[r][0])}, 'h', {_long(before[r][1])}, 'to', {before[r][2]})" if r in before else f"cast(null AS {kind})" for r in range(len(borders) + 1))
    rows = rows.withColumn("range", _range_of(borders)).withColumn("first", F.expr(f"get(array({places}), range)"))
    own = F.struct(F.lit(False).alias("guest"), F.col("range").alias("range"))
    guest = F.when(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.h") == F.col("h")), F.array(F.struct(F.lit(True).alias("guest"), F.col("first.to").alias("range")))).otherwise(F.array().cast("array<struct<guest:boolean,range:int>>"))
    dealt = rows.select("id", "h", "text", F.explode(F.concat(F.array(own), guest)).alias("p")).select("p.range", "p.guest", "id", "h", "text")
    ordered = dealt.repartition(max(partitions(docs.sparkSession), len(borders) + 1), "range").sortWithinPartitions("range", "guest", "id", "h").select("guest", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])  # the last row so far, whose next is still to come
        for piece in hs.pieces(batches, "text", SLICE_BYTES):
            guests, ids, texts = (a + b.to_pylist() for a, b in zip(held, piece.columns, strict=True))
            held = guests[-1:], ids[-1:], texts[-1:]
            if len(texts) > 1:
                yield _compared(guests, ids, texts, gram, window)

    return ordered.mapInArrow(run, _COMPARED)


def _compared(guests: list[bool], ids: list, texts: list[str], gram: int, window: int) -> pa.RecordBatch:
    """Result rows of all texts but the last that are no guests."""
    n = len(texts) - 1
    own = np.flatnonzero(~np.array(guests[:-1], bool))
    changed = [edited(texts[k], texts[k + 1]) for k in own]
    row, h, position = winnow(texts, gram, window)
    row2, h2, position2 = winnow(changed, gram, window)
    mine, after = _sets(row[row < n], h[row < n]), _sets(row[row > 0] - 1, h[row > 0])
    # sets of edited texts by the row they belong to
    theirs = _sets(own[row2], h2)
    return pa.RecordBatch.from_arrays([
        pa.array([ids[k] for k in own], pa.int64()), pa.array([len(texts[k]) for k in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        encode(row, h, position, n + 1).take(pa.array(own)), encode(row2, h2, position2, len(own)), pa.array(likeness(mine, theirs, n)[own]), pa.array(likeness(mine, after, n)[own]),
    ], [c.split()[0] for c in _COMPARED.split(", ")])
