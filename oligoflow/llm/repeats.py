"""Counting fingerprints of many text places in Spark, packed.

A task turns a few MB of text into one sorted run of fingerprints, keeps one entry for each distinct one
and deals the entries to buckets by their leading bits, one row of packed bytes for each bucket: 7 bytes a
fingerprint instead of a row each.  A bucket's rows meet in one task, are sorted, and adjacent equal
fingerprints are reported back to the runs they came from.  A fingerprint that a third of all texts hold
is one entry for each run, so no bucket grows with its copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as hs
from .base import partitions

#: Text (or other input) that one run covers, in bytes; text behind one bucket; text behind one task.
RUN_BYTES, BUCKET_BYTES, TASK_BYTES = 8 << 20, 4 << 20, 256 << 20
_PACKED = "bucket int, run long, keys binary, places binary, known binary, docs binary"
_MATCHED = "run long, places binary, docs binary"


def bucket_bits(n_bytes: int) -> int:
    """Buckets for so much text as a power of two: one for each BUCKET_BYTES (8 bits are not stored), and enough to spread evenly over tasks."""
    return max(10, (max(n_bytes, 1) // BUCKET_BYTES).bit_length())


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def _pack_places(places: np.ndarray) -> bytes:
    """Ascending places as differences of as few bytes as they need, byte plane by byte plane for block compression."""
    steps = np.diff(places, prepend=0).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack_places(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return np.cumsum(wide.view("<u8").ravel()).astype(np.int64)


def pack_docs(keys: list[bytes], starts: np.ndarray) -> bytes:
    """16-byte keys of a run's texts and the place at which each begins."""
    return len(keys).to_bytes(8, "little") + b"".join(keys) + starts.astype("<i8").tobytes()


def unpack_docs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data[8 : 8 + 16 * n], "S16") if n else np.zeros(0, "S16"), np.frombuffer(data[8 + 16 * n :], "<i8")


class Run:
    """Entries of the texts that a task has read since it last wrote."""

    def __init__(self, number: int, bits: int) -> None:
        self.number, self.bits, self.keys, self.places, self.always, self.docs, self.starts, self.size, self.bytes = number, bits, [], [], [], [], [], 0, 0

    def add(self, doc_keys: list[bytes], starts: np.ndarray, size: int, places: np.ndarray, keys: np.ndarray, always: np.ndarray | None, n_bytes: int) -> None:
        """Texts that take up ``size`` places, with fingerprints at some; ``always`` marks those known to occur elsewhere."""
        self.docs += doc_keys
        self.starts.append(starts + self.size)
        self.places.append(places + self.size)
        self.keys.append(keys)
        self.always.append(np.zeros(len(keys), bool) if always is None else always)
        self.size += size
        self.bytes += n_bytes

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Packed rows: the run's directory with what is repeated inside it, and a row for each bucket."""
        if not self.docs:
            return
        keys, places, always = (np.concatenate(x) for x in (self.keys, self.places, self.always))
        self.keys = self.places = self.always = None
        order = np.argsort(keys, kind="stable")
        keys, places, always = keys[order], places[order], always[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(keys))) > 1
        known = many | (np.bincount(group[always], minlength=len(first)) > 0 if len(first) else many)
        local = np.sort(places[known[group]]) if len(first) else places
        keys, places = keys[first], places[first]
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(places, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        keys, places, known, bucket = keys[order], places[order], known[order], bucket[order]
        low = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])
        found, at = np.unique(bucket, return_index=True)
        ends = np.append(at[1:], len(bucket))[: len(at)]  # texts too short for a fingerprint fill no bucket
        home = self.number % (1 << self.bits)
        out = [(home, b"", _pack_places(local), b"", pack_docs(self.docs, np.concatenate(self.starts)))]
        held = len(out[0][2])
        for b, lo, hi in zip(found.tolist(), at.tolist(), ends.tolist(), strict=True):
            out.append((b, low[lo:hi].tobytes(), _pack_places(places[lo:hi]), np.packbits(known[lo:hi]).tobytes(), None))
            held += 16 * (hi - lo)
            if held > 4 << 20:
                yield self._batch(out)
                out, held = [], 0
        if out:
            yield self._batch(out)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        bucket, keys, places, known, docs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([self.number] * len(rows), pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.binary()), pa.array(known, pa.binary()), pa.array(docs, pa.binary())], ["bucket", "run", "keys", "places", "known", "docs"])


def packed(docs: DataFrame, text_col: str, entries: Callable[[pa.RecordBatch], Iterator[tuple]], n_bytes: int, piece_bytes: int = 4 << 20) -> DataFrame:
    """Packed rows of all texts of ``docs``, ``n_bytes`` in all; ``entries`` turns a slice of about ``piece_bytes`` of them into what :meth:`Run.add` takes."""
    bits = bucket_bits(n_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        now = Run(number, bits)
        for piece in hs.pieces(batches, text_col, piece_bytes):
            for entry in entries(piece):
                now.add(*entry)
                if now.bytes >= RUN_BYTES:
                    yield from now.rows()
                    number += 1
                    now = Run(number, bits)
        yield from now.rows()

    return docs.mapInArrow(run, _PACKED)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition that is sorted by its first column, one value at a time."""
    held, value = [], None
    for batch in batches:
        for row in batch.to_pylist():
            this = next(iter(row.values()))
            if held and this != value:
                yield value, held
                held = []
            value = this
            held.append(row)
    if held:
        yield value, held


def matched(rows: DataFrame, n_bytes: int) -> DataFrame:
    """For each run: its directory, and the places whose fingerprint is repeated (in other runs, or known before).

    Tasks and buckets both follow ``n_bytes``, the text behind ``rows``.  A task's rows are sorted by bucket (by Spark, which
    spills) and it holds one bucket at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches):
            out = [(r["run"], r["places"], r["docs"]) for r in group if r["docs"] is not None]
            group = [r for r in group if r["docs"] is None]
            sizes = np.array([len(r["keys"]) // 7 for r in group], np.int64)
            wide = np.zeros((sizes.sum(), 8), np.uint8)
            wide[:, :7] = np.frombuffer(b"".join(r["keys"] for r in group), np.uint8).reshape(-1, 7)
            keys = wide.view("<u8").ravel()
            order = np.argsort(keys, kind="stable")
            equal = keys[order[1:]] == keys[order[:-1]]
            twice = np.zeros(len(keys), bool)
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            at = 0
            for r, n in zip(group, sizes.tolist(), strict=True):
                mine = twice[at : at + n] & ~np.unpackbits(np.frombuffer(r["known"], np.uint8), count=n).astype(bool)
                if mine.any():
                    out.append((r["run"], _pack_places(_unpack_places(r["places"])[mine]), None))
                at += n
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["run", "places", "docs"])

    n = max(partitions(rows.sparkSession), n_bytes // TASK_BYTES)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _MATCHED)


def intervals(hits: DataFrame, before: int, after: int) -> DataFrame:
    """(key, spans) of each text with repeated places: lists of merged intervals [place - before, place + after).

    Intervals start at 0 or later.  A very long text may have several lists, one for each run that held a part
    of it.  :func:`spans_of` puts them together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches):
            keys, starts = unpack_docs(next(r["docs"] for r in group if r["docs"] is not None))
            at = np.unique(np.concatenate([_unpack_places(r["places"]) for r in group]))
            if not len(at):
                continue
            doc = np.searchsorted(starts, at, side="right") - 1
            lo, hi = np.maximum(at - before, starts[doc]), at + after
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at)) - 1
            spans = np.stack([lo[begin], hi[end]], axis=1) - starts[doc[begin]][:, None]
            owner = doc[begin]
            cut = np.flatnonzero(np.diff(owner, prepend=-1))
            stop = np.append(cut[1:], len(owner))
            for k in range(0, len(cut), 5000):
                part = range(k, min(k + 5000, len(cut)))
                yield pa.RecordBatch.from_arrays([pa.array([keys[owner[cut[j]]].ljust(16, b"\0") for j in part], pa.binary()), pa.array([spans[cut[j] : stop[j]].astype("<i8").tobytes() for j in part], pa.binary())], ["key", "spans"])

    n = partitions(hits.sparkSession)
    found = hits.repartition(n, "run").sortWithinPartitions("run").mapInArrow(run, "key binary, spans binary")
    return found.groupBy("key").agg(F.collect_set("spans").alias("spans"))


def spans_of(lists: list[bytes] | None) -> np.ndarray:
    """(n, 2) array of the maximal intervals of one text."""
    spans = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in lists or [b""]])
    if len(lists or ()) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    begin = np.flatnonzero(new)
    return np.stack([spans[begin, 0], reach[np.append(begin[1:], len(spans)) - 1]], axis=1)
