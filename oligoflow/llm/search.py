"""Ranked lexical search by pipelined term partitioning (operator 13).

The postings of the items' terms are dealt to owner stages, rarest terms first.  A bundle holds what an item has gathered so far
in one shard of the documents: a sparse accumulator of documents and scores.  Bundles pass through the stages one after the
other; in each a cogroup brings a shard's bundles and the owner's postings of that shard together, and integer contributions
are added.  Behind the last stage each bundle gives its best documents, and those of all shards are ranked.

Scores only grow, and a term adds less than a million times its weight to any document.  So between stages a document is put
off for an item if even with all terms to come it stays under the score that so many documents have reached already (in all
shards together).  That loses no result, and few documents are carried to the stages of common words, whose postings are most.

A shard has a bounded number of documents and postings, so a task's memory follows neither the corpus nor a term's documents.  Items are
taken in blocks of a bounded number of terms; what a block broadcasts is bounded by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as hs
from .base import stored

#: (item, term) pairs of a block of items; documents (at most 65,536) and postings of a shard, about.
BLOCK_PAIRS, SHARD_DOCS, SHARD_POSTINGS = 1_000_000, 16_384, 2_000_000
#: Share of all postings that the stages up to each one own.
STAGE_SHARES = (0.02, 0.1, 0.35, 1.0)
#: Numbers of the score (fixed values).
WEIGHT_SCALE, TF_SCALE, TF_PART, LENGTH_PART, PERCENT, LENGTH_PERCENT = 1000, 1_000_000_000, 1000, 20, 100, 50
MOST_OF_TERM = TF_SCALE // TF_PART

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_POSTINGS = "shard long, term int, n long, docs binary, counts binary, with_terms long, all_terms long"
_BUNDLE = "shard long, item int, docs binary, scores binary, top array<long>"
_HIT = "item int, shard long, doc_id long, score long"


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts, and where each text's terms begin; A-Z lower-cased, null has none."""
    raw, offsets = hs.utf8(texts)
    start, end, rows = hs.words(raw, offsets, _SEPARATOR)
    return hs.word_hashes(raw, start, end, lower=True), rows


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, h) of each distinct term of each item; rows that repeat an item_id are one item, a null one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches):
            h, rows = _terms(piece.column(1))
            owner = np.repeat(np.arange(piece.num_rows), np.diff(rows))
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(owner)), pa.array(h.view(np.int64))], ["item_id", "h"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, h long").distinct()


@dataclass
class Block:
    """Items and their terms: ids, sorted hashes of all terms, and each item's terms as places in them."""

    ids: list
    terms: np.ndarray
    of_item: list[np.ndarray]

    @classmethod
    def of(cls, pairs: pa.Table) -> Block:
        ids = pairs.column(0).to_pylist()
        terms, place = np.unique(pairs.column(1).to_numpy().view(np.uint64), return_inverse=True)
        found: dict = {}
        for i, t in zip(ids, place.tolist(), strict=True):
            found.setdefault(i, []).append(t)
        names = sorted(found, key=lambda x: (x is not None, x or 0))
        return cls(names, terms, [np.array(found[x], np.int64) for x in names])


def postings(docs: DataFrame, block: Block) -> DataFrame:
    """Packed postings of the block's terms: a row for each shard and term, and one of term -1 for each shard with its documents and their lengths.

    A shard is a run of documents of one task.  The row of term -1 also has the numbers of documents with terms and of all their terms.
    """
    held = docs.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        terms, shard = held.value, TaskContext.get().partitionId() << 24
        ids, lengths, found, n_docs, n_post, with_terms, all_terms = [], [], [], 0, 0, 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            size = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
            names = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
            out = [(shard, -1, len(size), _ids(names), size.astype("<i8").tobytes(), with_terms, all_terms)]
            if found:
                doc, term, count = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(term, kind="stable")  # documents come in order
                doc, term, count = doc[order].astype("<u2"), term[order], count[order]
                first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
                for lo, hi in zip(first.tolist(), np.append(first[1:], len(term)).tolist(), strict=True):
                    c = count[lo:hi]
                    width = "<u1" if c.max() < 256 else "<u8"
                    out.append((shard, int(term[lo]), hi - lo, doc[lo:hi].tobytes(), c.astype(width).tobytes(), 0, 0))
            for k in range(0, len(out), 2000):
                yield _batch(out[k : k + 2000], _POSTINGS)

        for piece in hs.pieces(batches):
            h, at = _terms(piece.column(1))
            n = np.diff(at)
            with_terms, all_terms = with_terms + int((n > 0).sum()), all_terms + int(n.sum())
            place = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            known = terms[place] == h
            key, count = np.unique(np.repeat(np.arange(len(n)), n)[known] * len(terms) + place[known], return_counts=True)
            row, term = np.divmod(key, len(terms))
            mine = np.unique(row)
            for lo in range(0, len(mine), SHARD_DOCS):
                part = mine[lo : lo + SHARD_DOCS]
                a, b = np.searchsorted(row, [part[0], part[-1] + 1])
                if n_docs and (n_docs + len(part) > SHARD_DOCS or n_post > SHARD_POSTINGS):
                    yield from rows()
                    shard += 1
                    ids, lengths, found, n_docs, n_post, with_terms, all_terms = [], [], [], 0, 0, 0, 0
                ids.append(piece.column(0).take(pa.array(part)))
                lengths.append(n[part])
                found.append((n_docs + np.searchsorted(part, row[a:b]), term[a:b], count[a:b]))
                n_docs, n_post = n_docs + len(part), n_post + b - a
        yield from rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _POSTINGS)


def _ids(names: pa.Array) -> bytes:
    """Ids of documents: a byte each that says if there is one, and the numbers."""
    return np.asarray(names.is_valid(), np.uint8).tobytes() + names.fill_null(0).to_numpy().astype("<i8").tobytes()


def _unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 9
    return np.frombuffer(data, np.uint8, n).astype(bool), np.frombuffer(data, "<i8", offset=n)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """Integer weight of each term by the number of its documents."""
    return np.floor(WEIGHT_SCALE * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def contributions(weight: int, counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to documents of length measure ``m`` in which it occurs ``counts`` times."""
    return weight * (TF_SCALE * counts // (TF_PART * counts + LENGTH_PART * m))


def _stage(bundles: DataFrame, owned: DataFrame, block: Block, weight: np.ndarray, to_come: np.ndarray, reached: np.ndarray, n_docs: int, n_terms: int, best: int, last: bool) -> DataFrame:
    """Bundles (at the last stage: best documents) after a stage's owner has added its terms' contributions.

    ``to_come`` is what later stages can add to each item at most, ``reached`` a score that ``best`` documents have.
    """
    held = bundles.sparkSession.sparkContext.broadcast((block.of_item, weight, to_come, reached))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of_item, weight, to_come, reached = held.value
        sums, directory, shard = {}, None, left.column("shard")[0].as_py()
        for item, docs, scores in zip(left.column("item").to_pylist(), left.column("docs").to_pylist(), left.column("scores").to_pylist(), strict=True):
            if item < 0:
                directory = (docs, scores)
            else:
                sums[item] = (np.frombuffer(docs, "<u2"), np.frombuffer(scores, "<i8"))
        size = np.frombuffer(directory[1], "<i8")
        m = PERCENT - LENGTH_PERCENT + LENGTH_PERCENT * size * n_docs // max(n_terms, 1)
        added = {}
        for term, n, docs, counts in zip(*(right.column(c).to_pylist() for c in ("term", "n", "docs", "counts")), strict=True):
            at = np.frombuffer(docs, "<u2")
            count = np.frombuffer(counts, "<u1" if len(counts) == n else "<u8").astype(np.int64)
            added[term] = (at, contributions(int(weight[term]), count, m[at]))
        valid, ids = _unpack_ids(directory[0])
        out = [] if last else [(shard, -1, *directory, None)]
        for item, terms in enumerate(of_item):
            mine = [added[t] for t in terms.tolist() if t in added]
            if not mine and item not in sums:
                continue
            acc = np.zeros(len(size), np.int64)
            if item in sums:
                acc[sums[item][0]] = sums[item][1]
            for at, x in mine:
                acc[at] += x
            top = np.partition(acc, len(acc) - best)[len(acc) - best :] if len(acc) > best else acc
            least = max(int(reached[item]), int(top.min()) if len(top) == best else 0)
            keep = np.flatnonzero((acc > 0) & (acc + to_come[item] >= least))
            if not len(keep):
                continue
            if last:
                order = np.lexsort((ids[keep], valid[keep], -acc[keep]))[:best]  # null before all ids
                out += [(item, shard, int(ids[k]) if valid[k] else None, int(acc[k])) for k in keep[order]]
            else:
                out.append((shard, item, keep.astype("<u2").tobytes(), acc[keep].astype("<i8").tobytes(), top[top > 0].tolist()))
        return pa.Table.from_batches([_batch(out, _HIT if last else _BUNDLE)])

    return bundles.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(run, _HIT if last else _BUNDLE)


def _reached(bundles: DataFrame, items: int, best: int) -> np.ndarray:
    """For each item a score that ``best`` documents of all shards have (0 if fewer have any); one row an item reaches the driver."""
    tops = bundles.select("item", "shard", F.explode("top").alias("score"))
    for keys in (["item", F.pmod("shard", F.lit(61))], ["item"]):
        tops = tops.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score")))).where(F.col("_place") <= best)
    out = np.zeros(items, np.int64)
    for r in tops.where(F.col("_place") == best).select("item", "score").collect():
        out[r["item"]] = r["score"]
    return out


def _ranked(hits: DataFrame, block: Block, best: int) -> DataFrame:
    """Best documents of each item over all shards; in two steps, so an item's rows of all shards never meet at once."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    for keys in (["item", F.pmod("shard", F.lit(61))], ["item"]):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    names = hits.sparkSession.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
    return hits.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a row for each item of the block


def search(items: DataFrame, docs: DataFrame, best: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item of ``items`` (item_id, text) among all ``docs`` (doc_id, text).

    Null and empty texts have no terms: such items give no rows, such documents are never found.  Rows that repeat a doc_id are
    documents of their own; a null doc_id comes before others of its score; rows that repeat an item_id are one item.  Other
    columns are not read.  No documents or no items, no rows.  A text must fit in a task's memory.
    """
    pairs = stored(item_terms(items), "items")
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    out = None
    for k in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id", F.lit(19)), F.lit(blocks)) == k).toArrow()
        if mine.num_rows:
            found = _searched(Block.of(mine), docs, best)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _searched(block: Block, docs: DataFrame, best: int) -> DataFrame:
    found = stored(postings(docs, block), "postings")
    n_docs, n_terms = found.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("all_terms"), F.lit(0))).first()
    df = np.zeros(len(block.terms), np.int64)
    for r in found.where("term >= 0").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
        df[r["term"]] = r["n"]
    weight = np.where(df > 0, weights(n_docs, df), 0)
    order = np.argsort(df, kind="stable")
    share = np.cumsum(df[order]) / max(df.sum(), 1)
    stage = np.empty(len(df), np.int64)
    stage[order] = np.minimum(np.searchsorted(STAGE_SHARES, share - 1e-12), len(STAGE_SHARES) - 1)
    owners = found.sparkSession.createDataFrame(list(enumerate(stage.tolist())), "term int, stage int")
    owned = found.where("term >= 0").join(F.broadcast(owners), "term")  # a row for each term of the block
    bundles = found.where("term = -1 AND n > 0").select("shard", F.lit(-1).alias("item"), "docs", F.col("counts").alias("scores"), F.lit(None).cast("array<long>").alias("top"))
    bundles = stored(bundles, "bundles")
    reached = np.zeros(len(block.ids), np.int64)
    stages = sorted(set(stage[df > 0].tolist())) or [0]
    for s in stages:
        to_come = np.array([int(weight[t[stage[t] > s]].sum()) * MOST_OF_TERM for t in block.of_item], np.int64)
        bundles = _stage(bundles, owned.where(F.col("stage") == s).select("shard", "term", "n", "docs", "counts"), block, weight, to_come, reached, n_docs, n_terms, best, s == stages[-1])
        bundles = stored(bundles, f"bundles-{s}")
        if s != stages[-1]:
            reached = _reached(bundles, len(block.ids), best)
    return _ranked(bundles, block, best)
