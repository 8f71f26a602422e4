"""Removal of repeated byte strings by a distributed difference-cover algorithm (operator 5).

Suffixes need to be told apart on their first ``width`` bytes only, so the suffix sort becomes three
steps over fingerprints, each of which Spark sorts in buckets:

1. Sample the positions whose remainder modulo v lies in a perfect difference cover D.  For any two places
   i, j there is one k < v with i + k and j + k both sampled, so strings of ``width`` bytes that are equal
   share the sampled tuple of width - v + 1 bytes at that k.  Tuples are sorted and those with an equal
   neighbour keep their name (the fingerprint; order among names is not needed, so neither is a recursion).
2. The remaining suffixes are merged: a suffix within v of a repeated tuple may be repeated itself, all
   others are not.
3. Those are sorted by their first ``width`` bytes (fingerprint) and adjacent ones compared; the equal
   ones' intervals are merged and removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as hs
from . import repeats, sieve
from .base import stored
from .windows import keyed

_SLICE = 1 << 20
_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@lru_cache
def difference_cover(width: int) -> tuple[int, tuple[int, ...]]:
    """(v, D) of the largest perfect cover with v = q*q + q + 1 (q prime) that leaves tuples of half of ``width``.

    D has q + 1 remainders and every difference modulo v comes up exactly once (Singer): the powers of a
    generator of GF(q**3) that lie in the plane spanned by 1 and x.  Widths under 10 take {0, 1} modulo 3.
    """
    best = 0
    for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47):
        if q * q + q + 1 <= width // 2:
            best = q
    if not best:
        return 3, (0, 1)
    q, v = best, best * best + best + 1
    for a, b, c in ((a, b, c) for a in range(q) for b in range(q) for c in range(1, q)):
        x, cover = (1, 0, 0), []
        for i in range(v):
            if i and not x[1] and not x[2]:  # x**i is a scalar too soon
                break
            if not x[2]:
                cover.append(i)
            x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
        else:
            if len(cover) == q + 1 and len({(s - t) % v for s in cover for t in cover if s != t}) == v - 1:
                return v, tuple(cover)
    raise AssertionError(f"no cover for {q}")


def _slices(raw: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, row offsets, byte at which they begin); a text longer than a slice comes in overlapping parts."""
    if len(raw) <= 2 * _SLICE or len(offsets) != 2:
        yield raw, offsets, 0
        return
    for at in range(0, len(raw) - width + 1, _SLICE):
        part = raw[at : at + _SLICE + width - 1]
        yield part, np.array([0, len(part)]), at


def _starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All places at which ``width`` bytes of one row begin, and the places in the row."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(offsets[:-1], counts) + inside, inside


def _tuple_entries(width: int):
    v, cover = difference_cover(width)
    size = width - v + 1
    sampled = np.zeros(v, bool)
    sampled[list(cover)] = True

    def entries(piece: pa.RecordBatch) -> Iterator[tuple]:
        raw, offsets = hs.utf8(piece.column(1))
        for part, rows, base in _slices(raw, offsets, size):
            at, inside = _starts(rows, size)
            at = at[sampled[(inside + base) % v]]
            keys = hs.ranges(hs.prefix(hs.BYTE_VALUE[part], "byte"), at, at + size, "byte")
            yield piece.column(0).to_pylist(), offsets[:-1], int(offsets[-1]), at + base, keys, None, len(part) // 2

    return entries


def _candidate_entries(width: int):
    def entries(piece: pa.RecordBatch) -> Iterator[tuple]:
        z = zstandard.ZstdDecompressor()
        for key, packed, spans, copies in zip(*(piece.column(k) for k in range(4)), strict=True):
            raw = np.frombuffer(z.decompress(packed.as_py()), np.uint8)
            places, keys, size = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
            parts = [(at, min(at + _SLICE, hi, len(raw) - width + 1)) for lo, hi in repeats.spans_of(spans.as_py()).tolist() for at in range(lo, min(hi, len(raw) - width + 1), _SLICE)]
            for at, stop in parts:
                here = np.arange(stop - at)
                keys.append(hs.ranges(hs.prefix(hs.BYTE_VALUE[raw[at : stop + width - 1]], "byte"), here, here + width, "byte"))
                places.append(here + at)
                size += len(here)
                if size > _SLICE or (at, stop) == parts[-1]:
                    found = np.concatenate(keys)
                    yield [key.as_py()], np.zeros(1, np.int64), len(raw), np.concatenate(places), found, np.full(len(found), copies.as_py() > 1), 8 * size
                    places, keys, size = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0

    return entries


def _sha(parts: list[bytes]) -> str:
    h = hashlib.sha256()
    for x in parts:
        h.update(x)
    return h.hexdigest()


def remove_repeats(docs: DataFrame, width: int = 400, texts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) without byte strings of ``width`` bytes that also start anywhere else.

    Gives (doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, with ``texts``, kept (binary: a cut may
    split a character).  Texts are UTF-8 bytes; matches never cross texts; everything is judged on the input.
    Null and empty texts have no bytes.  Rows that repeat an id or have a null one are rows of their own;
    equal texts of ``width`` bytes or more vanish all together.  Other columns are not read; an empty table
    gives an empty result.  A long text is hashed in slices; it is read, packed and cut whole, by a task that holds it.  Different strings are taken for equal with a chance of 2**-64 for each pair.
    """
    v, _ = difference_cover(width)
    rows = keyed(docs).withColumn("digest", F.unhex(F.md5("text")))
    row_key = F.unhex(F.md5(F.concat(F.hex("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = rows.withColumn("key", row_key)
    # of equal texts, the row (or rows) with the smallest id stands for all
    texts_ = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.sum(F.octet_length("text")).alias("bytes"))
    texts_ = stored(texts_.select(row_key.alias("first_key"), "copies", "bytes"), "texts")
    n_bytes = texts_.agg(F.sum("bytes")).first()[0] or 0

    tuples = repeats.matched(repeats.packed(rows.select("key", "text"), "text", _tuple_entries(width), n_bytes, 1 << 20), n_bytes)
    near = stored(repeats.intervals(tuples, v - 1, 1).withColumnRenamed("key", "near_key"), "near")
    known = sieve.sieve(near.select("near_key"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Done are texts that are surely without candidates; of the others the bytes go on."""
        z = zstandard.ZstdCompressor(level=3)
        for piece in hs.pieces(batches, "text"):
            maybe = sieve.passes(known.value, piece.column(3), piece.column(4))
            plain = [x.as_buffer() for x in piece.column(2)]
            packed = [z.compress(x) if texts or m else None for x, m in zip(plain, maybe, strict=True)]
            sha = [None if m else hashlib.sha256(x).hexdigest() for x, m in zip(plain, maybe, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([x.size for x in plain], pa.int64()), pa.array(sha, pa.string()), pa.array(packed, pa.binary())], ["doc_id", "key", "n_bytes", "sha", "z"])

    small = rows.select("doc_id", "key", "text", *sieve.places(F.col("key"))).mapInArrow(squeeze, "doc_id long, key binary, n_bytes long, sha string, z binary")
    small = small.join(near, small.key == near.near_key, "left").join(texts_, small.key == texts_.first_key, "left")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Done are texts without candidates and all copies but the first; first copies and texts with candidates keep their bytes."""
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc_id, key, size, sha, packed, spans, n in zip(*([x.as_py() for x in batch.column(k)] for k in range(7)), strict=True):
                row = [doc_id, key, size, None, None, None, None, None, n]
                if n is None and size >= width:  # a copy: all its windows start elsewhere
                    row[3:6] = size, _sha([]), z_empty if texts else None
                elif n is None or spans is None:
                    row[3:6] = 0, sha or hashlib.sha256(z.decompress(packed)).hexdigest(), packed if texts else None
                else:
                    row[6:8] = packed, spans
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "key", "n_bytes", "gone", "sha", "whole", "z", "near", "copies"])

    z_empty = zstandard.ZstdCompressor(level=3).compress(b"")
    settled = small.select("doc_id", "key", "n_bytes", "sha", "z", "spans", "copies").mapInArrow(settle, "doc_id long, key binary, n_bytes long, gone long, sha string, whole binary, z binary, near array<binary>, copies long")
    settled = stored(settled, "settled")
    open_ = settled.where("z IS NOT NULL").select("key", "z", "near", "copies")
    spans = repeats.intervals(repeats.matched(repeats.packed(open_, "z", _candidate_entries(width), n_bytes, 1 << 20), n_bytes), 0, width).withColumnRenamed("key", "span_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for key, packed, found in zip(*(batch.column(k) for k in range(3)), strict=True):
                raw, parts, at = z.decompress(packed.as_py()), [], 0
                found = repeats.spans_of(found.as_py())
                for lo, hi in found.tolist():
                    parts.append(raw[at:lo])
                    at = hi
                parts.append(raw[at:])
                for column, x in zip(out, (key.as_py(), int((found[:, 1] - found[:, 0]).sum()), len(found), _sha(parts), b"".join(parts) if texts else None), strict=True):
                    column.append(x)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["of", "removed", "spans", "kept_sha", "kept"])

    one = open_.select("key", "z").dropDuplicates(["key"])
    done = one.join(spans, one.key == spans.span_key, "left").select("key", "z", "spans").mapInArrow(cut, "of binary, removed long, spans long, kept_sha string, kept binary")
    out = settled.drop("z", "near", "copies").join(done, settled.key == done.of, "left")
    removed = F.coalesce("gone", "removed", F.lit(0).cast("long"))
    n_spans = F.coalesce("spans", F.when(removed > 0, 1).otherwise(0).cast("long"))
    out = out.select("doc_id", "n_bytes", removed.alias("n_removed"), n_spans.alias("n_spans"), F.coalesce("sha", "kept_sha").alias("kept_sha256"), "whole", "kept")
    if not texts:
        return out.drop("whole", "kept")

    def swell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            kept = [z.decompress(w.as_py()) if w.is_valid else k.as_py() for w, k in zip(batch.column(5), batch.column(6), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(kept, pa.binary())], [*batch.schema.names[:5], "kept"])

    return out.mapInArrow(swell, _DIGEST + ", kept binary")
