"""Near-duplicate documents by MinHash, odd sketches and exact confirmation (operator 2).

MinHash samples of a document's word shingles give band keys, which propose candidates, and are folded
into a parity bitmap (odd sketch).  The XOR population count of two bitmaps estimates a high similarity
precisely and drops candidates far below the threshold; the rest are confirmed on their full sets.

Large groups never become all pairs.  Documents with equal sets are one class.  First the
members of a band bucket are compared with one hub each (the member that shares most buckets with others),
which joins the most of every group.  Members of buckets that still hold several components form groups, but only over
the rare shingles that linked texts must share (so a template that many texts have makes no group); the members
outside a group's main component are its query set, compared with the whole group in blocks of bounded
size, each pair of blocks in a task of its own.  Odd sketches sieve, full sets decide, and a task returns
no more links than join its components, however alike a group is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as hs
from . import sieve
from .base import partitions, stored
from .graph import components

BANDS, ROWS, SAMPLES, BITS = 32, 4, 192, 512
#: Text of a block that a group's members are compared in; most shingles that are looked up in memory.
BLOCK_BYTES, COMMON = 2 << 20, 20_000
_MULTIPLIERS = np.random.Generator(np.random.PCG64(71)).integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = BITS // 64


def min_hashes(bounds: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(rows, SAMPLES) minima over each row's shingle hashes; rows without shingles are all ones."""
    out = np.full((len(bounds) - 1, SAMPLES), 2**64 - 1, dtype=np.uint64)
    for row in np.flatnonzero(np.diff(bounds)):
        for at in range(bounds[row], bounds[row + 1], 2048):
            part = h[at : min(at + 2048, bounds[row + 1])]
            np.minimum(out[row], (_MULTIPLIERS[:, None] * part[None, :]).min(axis=1), out=out[row])
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys."""
    m = hs.mix(minima[:, : BANDS * ROWS]).reshape(len(minima), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2]).copy()
    for k in range(ROWS):
        key = hs.mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, k])
    return key


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """(n, BITS / 64) parity bitmaps of the samples (place, minimum)."""
    n = len(minima)
    bit = hs.mix(minima ^ hs.mix(np.arange(1, SAMPLES + 1))[None, :]) % np.uint64(BITS)
    flat = (np.arange(n)[:, None] * BITS + bit.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def sketch_limit(similarity: float, deviations: float = 4.5) -> int:
    """Largest XOR population count that a pair of this similarity may have, so many deviations above its mean."""
    moved = 2 * SAMPLES * (1 - similarity)
    spread = 2 * math.sqrt(SAMPLES * similarity * (1 - similarity))
    mean = BITS / 2 * (1 - math.exp(-2 * moved / BITS))
    deviation = math.hypot(spread * math.exp(-2 * moved / BITS), math.sqrt(BITS / 4 * (1 - math.exp(-4 * moved / BITS))))
    return math.ceil(mean + deviations * deviation)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, id, bands, sketch) of each row; id: 64-bit digest of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text", hs.SMALL_SLICE):
            bounds, h, ids = _sets(piece.column(1), n)
            minima = min_hashes(bounds, h)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel())) for x in (band_keys(minima).view(np.int64), odd_sketches(minima))]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(bounds)), ids, *lists], ["doc_id", "n_shingles", "id", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, id long, bands array<long>, sketch array<long>")


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bounds of each row's set, all sets' sorted shingle hashes, and the sets' digests."""
    raw, offsets = hs.utf8(texts)
    start, end, rows = hs.words(raw, offsets)
    owner, h = hs.shingles(hs.word_hashes(raw, start, end, lower=True), rows, n)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hs.mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    digest = hs.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return bounds, h, pa.array(digest.view(np.int64), mask=np.diff(bounds) == 0)


def with_ids(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, id, text): the digest of each text's set beside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text", hs.SMALL_SLICE):
            yield pa.RecordBatch.from_arrays([piece.column(0), _sets(piece.column(1), n)[2], piece.column(1)], ["doc_id", "id", "text"])

    return texts.mapInArrow(run, "doc_id long, id long, text string")


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets meet 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text_a", hs.SMALL_SLICE):
            size, sets = piece.num_rows, []
            for k in (2, 3):
                raw, offsets = hs.utf8(piece.column(k))
                start, end, rows = hs.words(raw, offsets)
                sets.append(hs.shingles(hs.word_hashes(raw, start, end, lower=True), rows, n))
            owner, h = (np.concatenate(x) for x in zip(*sets, strict=True))
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            both = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (h[1:] == h[:-1])], minlength=size)
            union = np.bincount(owner, minlength=size) - both
            keep = pa.array((100 * both >= percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([piece.column(0).filter(keep), piece.column(1).filter(keep)], ["a", "b"])

    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _alike(percent: int) -> Column:
    """Candidates x, y that may be linked: by their sizes (exact) and by their odd sketches."""
    small, large = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
    apart = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(_WORDS)), F.lit(0))
    return (100 * small >= percent * large) & (apart <= sketch_limit(percent / 100))


def _hubs(bands: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, hub) of each bucket with several components: its member that shares most buckets with others."""
    b = bands.select("key", "id").join(nodes.select("id", "component", "score"), "id")
    found = b.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct("score", "id")).alias("hub"))
    return stored(found.where("lo <> hi").select("key", F.col("hub.id").alias("hub")), "hubs")


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` in the components of ``labels`` (id, component)."""
    found = labels.select(F.col("id").alias("v"), F.col("component").alias("label"))
    moved = nodes.join(found, nodes.id == found.v, "left").withColumn("component", F.coalesce("label", "component"))
    return stored(moved.select(nodes.columns), "nodes")


def _hub_pairs(bands: DataFrame, nodes: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of split buckets and the hubs of these, where they may be linked and aren't yet."""
    pairs = bands.join(hubs, "key").where("id <> hub").select("id", "hub").distinct().alias("p")
    x, y = nodes.alias("x"), nodes.alias("y")
    found = pairs.join(x, F.col("p.id") == F.col("x.id")).join(y, F.col("p.hub") == F.col("y.id"))
    return found.where((F.col("x.component") != F.col("y.component")) & _alike(percent)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _block_links(block: pa.Table, n: int, percent: int) -> list[tuple[int, int]]:
    """Links between the queries and the other rows of a block, as many as join its components: a spanning forest."""
    query = block.column("query").to_numpy()
    ids, component, size = (block.column(c).to_numpy() for c in ("id", "component", "n_shingles"))
    sketch = np.stack([block.column(f"s{k}").to_numpy() for k in range(_WORDS)], axis=1).view(np.uint64)
    bounds, h, _ = _sets(block.column("text"), n)
    mine, other = np.flatnonzero(query), np.flatnonzero(~query)
    owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
    theirs = ~query[owner]
    place = np.cumsum(~query) - 1  # among the others
    order = np.argsort(h[theirs], kind="stable")
    keys, owners = h[theirs][order], place[owner[theirs]][order]
    sizes, components_, sketches, limit, out = size[other], component[other], sketch[other], sketch_limit(percent / 100), []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for q in mine:
        maybe = (components_ != component[q]) & (100 * np.minimum(sizes, size[q]) >= percent * np.maximum(sizes, size[q]))
        maybe &= np.bitwise_count(sketches ^ sketch[q]).sum(axis=1) <= limit
        if not maybe.any():
            continue
        own = h[bounds[q] : bounds[q + 1]]
        lo = np.searchsorted(keys, own, "left")
        times = np.searchsorted(keys, own, "right") - lo
        at = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
        both = np.bincount(owners[at], minlength=len(other))
        linked = np.flatnonzero(maybe & (100 * both >= percent * (sizes + size[q] - both)))
        _, first = np.unique(components_[linked], return_index=True)
        for k in linked[first].tolist():
            a, b = root(int(component[q])), root(int(components_[k]))
            if a != b:
                parent[a] = b
                out.append((int(ids[q]), int(ids[other[k]])))
    return out


def _rare_edges(members: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): edges that connect all ``members`` (id, component, n_shingles, text) which may be linked across components.

    Shingles are put in one order for all texts: first those that a single component has, then the rest from rare to
    common.  Two texts of which ``percent`` % of the shingles are common share one of the first (100 - percent) % of each, plus one.  So
    texts that have something in common, but not nearly enough, and be it the template of a whole site, fall out here: what is first
    in each is its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text", hs.SMALL_SLICE):
            bounds, h, _ = _sets(piece.column(3), n)
            row = pa.array(np.repeat(np.arange(piece.num_rows), np.diff(bounds)))
            yield pa.RecordBatch.from_arrays([*[piece.column(k).take(row) for k in range(3)], pa.array(h.view(np.int64))], ["id", "component", "n_shingles", "h"])

    rows = stored(members.select("id", "component", "n_shingles", "text").mapInArrow(run, "id long, component long, n_shingles long, h long"), "shingles")
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    counts = stored(counts.where("lo <> hi").select("h", "n"), "counts")
    # the commonest are looked up where they are, COMMON of them at most; they would be hot keys of the join
    common = counts.where(F.col("n") > rows.count() // COMMON)
    shared = rows.join(F.broadcast(common), "h").unionByName(rows.join(F.broadcast(common), "h", "left_anti").join(counts.hint("merge"), "h"))
    own = shared.groupBy("id", "component", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("keys"))
    first = F.floor(F.col("n_shingles") * (100 - percent) / 100) + 1 - (F.col("n_shingles") - F.size("keys"))
    keys = stored(own.where(first > 0).select("id", "component", F.explode(F.slice("keys", F.lit(1), first.cast("int"))["h"]).alias("h")), "keys")
    hubs = keys.groupBy("h").agg(F.min("id").alias("b"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h", "b")
    return keys.join(hubs, "h").select(F.col("id").alias("a"), "b").where("a <> b").distinct()


def _group_links(bands: DataFrame, nodes: DataFrame, hubs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between the components of groups among the members of split buckets (the queries of a group against all of it)."""
    split = bands.join(hubs, "key").select("id").distinct()
    split = stored(split.join(nodes.drop("score", "rep"), "id").join(texts, "id"), "split")
    groups = components(_rare_edges(split, n, percent)).withColumnRenamed("component", "group")
    members = stored(groups.join(split, "id"), "members")
    size = F.octet_length("text")
    parts = members.groupBy("group", "component").agg(F.count(F.lit(1)).alias("m"), F.sum(size).alias("bytes"))
    plan = parts.groupBy("group").agg(F.max(F.struct("m", "component", "bytes")).alias("main"), F.sum("bytes").alias("bytes"))
    blocks = lambda x: F.ceil(x / BLOCK_BYTES).cast("int")
    plan = stored(plan.select("group", F.col("main.component").alias("main"), blocks(F.col("bytes") + 1).alias("n_other"), blocks(F.col("bytes") - F.col("main.bytes") + 1).alias("n_query")), "plan")
    all_ = members.join(plan, "group").withColumn("h", F.xxhash64("id"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    other = all_.select("*", F.lit(False).alias("query"), F.pmod("h", "n_other").cast("int").alias("y")).withColumn("x", every("n_query"))
    query = all_.where("component <> main").select("*", F.lit(True).alias("query"), F.pmod("h", "n_query").cast("int").alias("x")).withColumn("y", every("n_other"))
    names = ["group", "x", "y", "query", "id", "component", "n_shingles", *[f"s{k}" for k in range(_WORDS)], "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def links() -> pa.RecordBatch:
            found = _block_links(pa.Table.from_batches(held).combine_chunks(), n, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and tuple(unit[lo]) != last:
                    yield links()
                    held = []
                last = tuple(unit[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield links()

    dealt = other.select(names).union(query.select(names)).repartition(partitions(bands.sparkSession), "group", "x", "y")
    return dealt.sortWithinPartitions("group", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, set_component, kept) for each row of ``docs``.

    Words are runs without white space, A-Z lower-cased; a text's set holds its distinct shingles of ``n``
    words (with fewer words: the whole sequence).  component_id is the smallest id reachable through links;
    kept marks rows that have it.  set_id is a digest of the set (null for an empty one) and set_component
    one of those in the component.  Null, empty and blank texts have no set and stand alone.  Rows that
    repeat an id are rows of their own, each in the component of its text.  Rows with a null id are linked
    like others but never name a component that has an id; a null component means there is none.
    Other columns are not read; an empty table gives an empty result.  A text of any length is hashed whole, by a task that
    holds it.

    A pair at the threshold shares a band with chance 1 - (1 - 0.8**4)**32 > 1 - 5e-8, above it more.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sig = stored(signatures(rows, n), "signatures")
    first = stored(sig.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("rep")), "classes")
    s, f = sig.alias("s"), first.alias("f")
    sketch = [F.col("s.sketch")[k].alias(f"s{k}") for k in range(_WORDS)]
    classes = s.join(f, (F.col("s.id") == F.col("f.id")) & F.col("s.doc_id").eqNullSafe(F.col("f.rep"))).select("s.id", "rep", "n_shingles", "bands", *sketch)
    classes = stored(classes.dropDuplicates(["id"]), "classes")

    # the buckets of two classes or more, and the classes in them
    bands = classes.select("id", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bands = stored(bands.join(shared, "key"), "bands")
    nodes = bands.groupBy("id").agg(F.sum("n").alias("score")).join(classes.drop("bands"), "id")
    nodes = stored(nodes.withColumn("component", F.col("id")), "nodes")
    # by sorting at every size: the members grow with the documents
    rows = sieve.sieved(rows, F.col("doc_id"), sieve.sieve(nodes.select("rep")))
    named = rows.alias("r").join(nodes.select("rep").distinct().hint("merge").alias("w"), F.col("r.doc_id").eqNullSafe(F.col("w.rep"))).select("doc_id", "text")
    texts = with_ids(named, n).join(nodes.select("id"), "id", "left_semi").select("id", "text")
    texts = stored(texts.dropDuplicates(["id"]), "texts")

    links = stored(confirm(_hub_pairs(bands, nodes, _hubs(bands, nodes), percent), texts, n, percent), "links")
    nodes = _labelled(nodes, components(links, passes=2))
    links = links.union(stored(_group_links(bands, nodes, _hubs(bands, nodes), texts, n, percent), "links"))
    labels = components(links).select(F.col("id").alias("v"), F.col("component").alias("label"))
    named = labels.join(first, labels.v == first.id).select("v", "label", "rep")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = named.select("v", "label").join(least, "label").select("v", "label", "component_id").alias("c")
    alone = F.when(F.col("s.id").isNull(), F.col("s.doc_id")).otherwise(F.col("f.rep"))
    out = s.join(f, F.col("s.id") == F.col("f.id"), "left").join(final, F.col("s.id") == F.col("c.v"), "left")
    out = out.select("s.doc_id", "s.n_shingles", F.coalesce("c.component_id", alone).alias("component_id"), F.col("s.id").alias("set_id"), F.coalesce("c.label", "s.id").alias("set_component"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when each component keeps one row.

    That is a row with the component's smallest id (a null id is the largest); of several such rows, one
    with the smallest set_id, and of rows that repeat id and set, any one.  Texts without words all stay.
    """
    report = stored(near_duplicates(docs, n, percent, id_col, text_col), "report")
    mine = report.where("kept AND set_id IS NOT NULL").groupBy("set_component", "doc_id", "set_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = stored(mine.groupBy("set_component").agg(F.min(F.struct("set_id", "doc_id", "n")).alias("x")).select("x.*"), "chosen")
    name = "_set"
    while name in docs.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, text_col, hs.SMALL_SLICE):
            at = piece.schema.get_field_index(text_col)
            yield pa.RecordBatch.from_arrays([*piece.columns, _sets(piece.column(at), n)[2]], [*piece.schema.names, name])

    held = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    c = chosen.alias("c")
    held = held.alias("d").join(c, (F.col(f"d.{name}") == F.col("c.set_id")) & F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("c.doc_id")), "left")
    columns = [F.col(f"d.`{x}`") for x in docs.columns]
    out = held.where(F.col(f"d.{name}").isNull() | (F.col("c.n") == 1)).select(columns)
    if chosen.where("n > 1").isEmpty():
        return out
    return out.union(held.where("c.n > 1").dropDuplicates([name]).select(columns))
