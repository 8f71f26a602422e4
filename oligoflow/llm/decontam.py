"""Benchmark decontamination by size-partitioned MinHash containment search (operator 6).

Jaccard similarity hides a short item in a long document, so the sketch belongs to the item: its smallest
shingle hashes, looked up among all shingles of a document.  Items are partitioned by size class, and each
class has its own sketch length: an item of q shingles that is contained to p % misses at most
q * (100 - p) / 100 of them, so with one minimum more than the class can miss, a contained item always
has a minimum in the document.  Candidates are then confirmed by exact containment of the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as hs
from . import sieve
from .base import stored

#: Items are broadcast up to this many bytes of text; beyond it their minima are joined, behind a Bloom filter of fixed size.
BROADCAST_BYTES = 16 << 20
_RESULT = "doc_id long, item_id long, shared long, item_shingles long, containment double"


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each row's set and the sorted shingle hashes."""
    raw, offsets = hs.utf8(texts)
    start, end, rows = hs.words(raw, offsets)
    owner, h = hs.shingles(hs.word_hashes(raw, start, end, lower=True), rows, n)
    return np.searchsorted(owner, np.arange(len(offsets))), h


def sketch_lengths(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Minima kept for items of these sizes: of the largest size of their class (a power of two), plus one."""
    largest = 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    return np.minimum(sizes, largest * (100 - percent) // 100 + 1)


class ItemIndex:
    """Sketches and full sets of a bounded number of items, as sorted arrays."""

    def __init__(self, ids: list[int | None], texts: list[str | None], n: int, percent: int) -> None:
        bounds, h = shingle_sets(pa.array(texts, pa.string()), n)
        sizes = np.diff(bounds)
        rank = np.arange(len(h)) - np.repeat(bounds[:-1], sizes)  # hashes are sorted within an item: the first are its minima
        item = np.repeat(np.arange(len(sizes)), sizes)
        minimum = rank < np.repeat(sketch_lengths(sizes, percent), sizes)
        order = np.argsort(h[minimum], kind="stable")
        self.keys, self.items = h[minimum][order], item[minimum][order]
        self.ids, self.bounds, self.sets, self.percent, self.n = np.array([-1 if i is None else i for i in ids], np.int64), bounds, h, percent, n
        self.no_id = np.array([i is None for i in ids], bool)

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared shingles) of all contained items."""
        bounds, h = shingle_sets(texts, self.n)
        lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        hit = np.flatnonzero(hi > lo)
        times = (hi - lo)[hit]
        row = np.repeat(np.searchsorted(bounds, hit, side="right") - 1, times)
        at = np.repeat(lo[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.unique(np.stack([row, self.items[at]], axis=1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
        shared = np.zeros(len(pairs), np.int64)
        for k, (r, i) in enumerate(pairs):
            shared[k] = len(np.intersect1d(h[bounds[r] : bounds[r + 1]], self.sets[self.bounds[i] : self.bounds[i + 1]], assume_unique=True))
        size = np.diff(self.bounds)[pairs[:, 1]]
        good = 100 * shared >= self.percent * size
        return pairs[good, 0], pairs[good, 1], shared[good]


def _index(items: DataFrame, n: int, percent: int):
    """A broadcast index if the items' text is within BROADCAST_BYTES, else None."""
    if (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > BROADCAST_BYTES:
        return None
    rows = items.select("item_id", "text").collect()
    return items.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], n, percent))


def _joined(docs: DataFrame, items: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, item_id, shared, item_shingles) for many items: shingles meet in a join, by a digest of the text.

    Only shingles that a Bloom filter of the items' minima lets pass are shuffled, and only texts that have a
    candidate travel to be confirmed.
    """

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text", hs.SMALL_SLICE):
            bounds, h = shingle_sets(piece.column(1), n)
            sizes = np.diff(bounds)
            rank, item = np.arange(len(h)) - np.repeat(bounds[:-1], sizes), np.repeat(np.arange(len(sizes)), sizes)
            keep = rank < np.repeat(sketch_lengths(sizes, percent), sizes)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(item[keep])), pa.array(h[keep].view(np.int64))], ["item", "h"])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text", hs.SMALL_SLICE):
            bounds, h = shingle_sets(piece.column(1), n)
            maybe = sieve.hash_passes(known.value, h)
            row = np.repeat(np.arange(piece.num_rows), np.diff(bounds))[maybe]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(h[maybe].view(np.int64))], ["key", "h"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text", hs.SMALL_SLICE):
            (b, h), (bi, hi) = shingle_sets(piece.column(3), n), shingle_sets(piece.column(4), n)
            shared = np.array([len(np.intersect1d(h[b[k] : b[k + 1]], hi[bi[k] : bi[k + 1]], assume_unique=True)) for k in range(piece.num_rows)], np.int64)
            keep = pa.array(100 * shared >= percent * np.diff(bi))
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (piece.column(0), piece.column(2), pa.array(shared), pa.array(np.diff(bi)))], ["key", "item_id", "shared", "item_shingles"])

    keyed = docs.select(F.sha2("text", 256).alias("key"), "text").where("text IS NOT NULL")
    held = items.select(F.sha2("text", 256).alias("item"), "item_id", F.col("text").alias("item_text")).where("item_text IS NOT NULL")
    small = stored(held.select("item", F.col("item_text").alias("text")).dropDuplicates(["item"]).mapInArrow(minima, "item string, h long"), "minima")
    known = sieve.sieve(small.select("h"), hashed=True)
    found = stored(keyed.mapInArrow(hits, "key string, h long").distinct().join(small, "h").select("key", "item").distinct(), "candidates")
    texts = sieve.sieved(keyed, F.col("key"), sieve.sieve(found.select("key"))).dropDuplicates(["key"])
    return found.join(texts, "key").join(held, "item").select("key", "item", "item_id", "text", "item_text").mapInArrow(verify, "key string, item_id long, shared long, item_shingles long")


def contamination(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): items of which ``percent`` % or more of the shingles are in a document.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are not read.  Words are runs
    without white space with A-Z lower-cased; an item of fewer than ``n`` words is one shingle.  Null, empty
    and blank texts contain nothing and are contained in nothing.  Rows that repeat an id, and null ids, give
    rows of their own.  No documents or no items: no rows.  A text of any length is searched whole, by a task that holds it.
    """
    docs, items = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text"), items.selectExpr("cast(item_id AS long) AS item_id", "text")
    index = _index(items, n, percent)
    if index is None:
        hits = _joined(docs, items, n, percent)
        named = docs.select("doc_id", F.sha2("text", 256).alias("key")).join(hits, "key")
        return named.select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for piece in hs.pieces(batches, "text", hs.SMALL_SLICE):
            row, item, shared = x.search(piece.column(1))
            size = np.diff(x.bounds)[item]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(x.ids[item], mask=x.no_id[item]), pa.array(shared), pa.array(size), pa.array(shared / np.maximum(size, 1))], ["doc_id", "item_id", "shared", "item_shingles", "containment"])

    return docs.mapInArrow(run, _RESULT)


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns (whatever their names), whose text contains no item."""
    index = _index(items.selectExpr("cast(item_id AS long) AS item_id", "text"), n, percent)
    if index is None:
        name = "_bad"
        while name in {x.lower() for x in docs.columns}:
            name += "_"
        bad = _joined(docs, items, n, percent).select(F.col("key").alias(name)).distinct()
        return docs.join(bad, F.sha2("text", 256) == F.col(name), "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text", hs.SMALL_SLICE):
            keep = np.ones(piece.num_rows, bool)
            keep[index.value.search(piece.column(piece.schema.get_field_index("text")))[0]] = False
            yield piece.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
