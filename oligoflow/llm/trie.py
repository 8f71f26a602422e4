"""The prefix trie of conversations (operator 12).

A node is a distinct sequence of first turns, named by two polynomial hashes modulo 2**64 of its turns (each turn has a 128-bit
digest), so two different sequences meet with a chance of about 2**-128.  Prefix sums give the names of all prefixes of a
conversation; conversations are cut into ranges of rows, and a conversation that spans several gets its sums shifted
by what the ranges before hold, so one of any length never meets in one task.  Nodes are then an aggregate, and all subtree
totals come from :mod:`.contraction`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as hs
from .base import partitions, stored
from .contraction import subtree_totals

#: Bytes of ids put together in one row before they are hashed.
ID_BYTES = 1 << 20
_KINDS = ("word", "byte")
_U = np.uint64


def _turn_hashes(roles: list[str], texts: list[str]) -> np.ndarray:
    """(n, 2) halves of a digest of each (role, text)."""
    digest = lambda r, t: hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16).digest()
    return np.frombuffer(b"".join(digest(r.encode(), t.encode()) for r, t in zip(roles, texts, strict=True)), "<u8").reshape(-1, 2)


_LOCAL = "part int, conv_id long, pos long, i0 long, i1 long, e0 long, e1 long, words long, last boolean"


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, i0, i1, e0, e1, words) of each turn: its place from 0, the names of the sequence up to it with and without it, its words.

    Turns are ordered by turn (null first), then role and text; null role or text is empty.  Rows without a conv_id belong to no
    conversation and are left out; other columns are not read; no rows give no rows.  A turn must fit in a task's memory, a
    conversation needn't; turns of one conversation, number and role meet in one task, which reads them as a stream.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(conversations.sparkSession)
    ranged = rows.repartitionByRange(n, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 32)).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, conv, count, sums = TaskContext.get().partitionId(), None, 0, [_U(0), _U(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            turns = _turn_hashes(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            words = np.diff(hs.words(*hs.utf8(batch.column(3)))[2])
            first = np.append(True, ids[1:] != ids[:-1])
            begin = np.flatnonzero(first)[np.cumsum(first) - 1]
            goes_on = begin == 0 if ids[0] == conv else np.zeros(len(ids), bool)  # the conversation of the batch before
            pos = np.arange(len(ids)) - begin + np.where(goes_on, count, 0)
            out = []
            for k, kind in enumerate(_KINDS):
                part_of = turns[:, k] * hs.powers(kind, int(pos.max()) + 1)[pos]
                total = np.cumsum(part_of)
                whole = total - (total - part_of)[begin] + np.where(goes_on, sums[k], _U(0))
                out.append((whole, whole - part_of))
                sums[k] = whole[-1]
            conv, count = ids[-1], int(pos[-1]) + 1
            (i0, e0), (i1, e1) = out
            yield _local(part, ids, pos, (i0, i1, e0, e1), words, False)
        if count:
            yield _local(part, np.array([conv]), np.array([count]), tuple(np.array([x]) for x in (*sums, *sums)), np.array([0]), True)

    local = stored(ranged.mapInArrow(run, _LOCAL), "turns")
    shifts = _shifts(local)
    held = conversations.sparkSession.sparkContext.broadcast(shifts)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos = batch.column(1).to_numpy(), batch.column(2).to_numpy().copy()
            names = [batch.column(k).to_numpy().view(_U).copy() for k in range(3, 7)]
            parts = batch.column(0).to_numpy()
            for p in np.unique(parts):
                if p not in held.value:
                    continue
                conv, count, sums = held.value[p]
                mine = (parts == p) & (ids == conv)
                for k in range(4):
                    names[k][mine] = _U(sums[k % 2]) + names[k][mine] * _U(pow(hs.BASES[_KINDS[k % 2]], count, 2**64))
                pos[mine] += count
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pos), *[pa.array(x.view(np.int64)) for x in names], batch.column(7)], ["conv_id", "pos", "i0", "i1", "e0", "e1", "words"])

    return local.where("NOT last").mapInArrow(shift, "conv_id long, pos long, i0 long, i1 long, e0 long, e1 long, words long")


def _local(part: int, ids: np.ndarray, pos: np.ndarray, names: tuple, words: np.ndarray, last: bool) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(np.full(n, part, np.int32)), pa.array(ids), pa.array(pos.astype(np.int64)), *[pa.array(np.asarray(x, _U).view(np.int64)) for x in names], pa.array(words.astype(np.int64)), pa.array(np.full(n, last))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _LOCAL.split(", ")])


def _shifts(local: DataFrame) -> dict[int, tuple]:
    """For each range of rows that begins inside a conversation: (conversation, its turns before, their sums).  One row for each range reaches the driver."""
    out, now = {}, None
    for r in sorted(local.where("last").collect(), key=lambda r: r["part"]):
        conv, count, sums = r["conv_id"], r["pos"], [r["i0"] % 2**64, r["i1"] % 2**64]
        if now:
            out[r["part"]] = now
            if now[0] == conv:
                sums = [(now[2][k] + pow(hs.BASES[_KINDS[k]], now[1], 2**64) * sums[k]) % 2**64 for k in (0, 1)]
                count += now[1]
        now = (conv, count, sums)
    return out


#: A conversation's way through the trie: a row for each node on it; ``end`` marks its last one.
_MEMBER = "conv_id long, depth long, a long, b long, pa long, pb long, words long, end boolean"


def _roots(convs: DataFrame, end: str) -> DataFrame:
    none = F.lit(None).cast("long")
    return convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), none.alias("pa"), none.alias("pb"), F.lit(0).cast("long").alias("words"), F.expr(end).alias("end"))


def paths(turns: DataFrame) -> DataFrame:
    """The ways of conversations as they are, of :func:`turn_prefixes`."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    steps = turns.join(convs, "conv_id").select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("i0").alias("a"), F.col("i1").alias("b"), F.col("e0").alias("pa"), F.col("e1").alias("pb"), "words", (F.col("pos") == F.col("n") - 1).alias("end"))
    return steps.unionByName(_roots(convs, "false"))


def grafted_paths(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The ways of rebuilt conversations: conversation c starts with the first h turns of c - c % every instead of its own, h = crc32(c) % most.

    Names of grafted sequences follow from those of both parts, so no text is moved.
    """
    at = F.when(F.col("pos") < most - 1, F.struct("pos", "i0", "i1", "e0", "e1", "words"))
    convs = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(at)).alias("heads")), "conversations")
    sources = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("src"), F.col("heads").alias("src_heads"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    convs = convs.withColumns({"src": F.col("conv_id") - F.col("conv_id") % every, "h": h.cast("int")}).join(sources, "src", "left").withColumn("s", F.least("h", F.coalesce(F.size("src_heads"), F.lit(0))))
    convs = convs.withColumn("s", F.greatest("s", F.lit(0)))
    of = lambda heads, k, x: F.coalesce(F.get(F.col(heads), F.col(k) - 1)[x], F.lit(0)).cast("long")
    convs = stored(convs.select("conv_id", "n", "h", "s", F.slice("src_heads", F.lit(1), F.col("s")).alias("start"), *[of("src_heads", "s", f"i{k}").alias(f"s{k}") for k in (0, 1)], *[of("heads", "h", f"i{k}").alias(f"o{k}") for k in (0, 1)]), "grafts")
    starts = convs.select("conv_id", "n", "h", "s", F.explode("start").alias("x"))
    starts = starts.select("conv_id", (F.col("x.pos") + 1).alias("depth"), F.col("x.i0").alias("a"), F.col("x.i1").alias("b"), F.col("x.e0").alias("pa"), F.col("x.e1").alias("pb"), F.col("x.words").alias("words"), F.expr("n <= h AND x.pos = s - 1").alias("end"))
    rest = turns.where(F.col("pos") >= h).join(convs.drop("start"), "conv_id").select("conv_id", "pos", "i0", "i1", "e0", "e1", "words", "n", "h", "s", "s0", "s1", "o0", "o1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {x: batch.column(k).to_numpy() for k, x in enumerate(batch.schema.names)}
            back = column["h"] - column["s"]
            names = []
            for x in ("i", "e"):
                for k, kind in enumerate(_KINDS):
                    v = {y: column[f"{y}{k}"].view(_U) for y in (x, "s", "o")}
                    names.append((v["s"] + (v[x] - v["o"]) * hs.powers(kind, most, inverse=True)[back]).view(np.int64))
            depth = column["pos"] - back + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depth.astype(np.int64)), *[pa.array(x) for x in names], batch.column(6), pa.array(column["pos"] == column["n"] - 1)], [c.split()[0] for c in _MEMBER.split(", ")])

    return starts.unionByName(rest.mapInArrow(run, _MEMBER)).unionByName(_roots(convs, "n <= h AND s = 0"))


def trie(ways: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``n_leaves`` and ``saved_tokens`` are sums over the node's subtree: childless nodes, and for each node the words of
    its last turn times its members but one.  ``ends_sha256`` is the SHA-256 of the ids of the members that end here.  No conversations, no rows.
    """
    ways = stored(ways, "ways")
    nodes = ways.groupBy("a", "b").agg(*[F.min(x).alias(x) for x in ("conv_id", "depth", "pa", "pb", "words")], F.count(F.lit(1)).alias("n_convs"))
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    inner = nodes.where("pa IS NOT NULL").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct().withColumn("inner", F.lit(True))
    marked = nodes.join(inner, ["a", "b"], "left").withColumn("leaf", F.when(F.col("inner"), 0).otherwise(1))
    totals = subtree_totals(marked, ["leaf", "saved"]).select("a", "b", "kids", F.col("leaf").alias("leaves"), F.col("saved").alias("total_saved"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, ["a", "b"]).join(_ends(ways), ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("total_saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _ends(ways: DataFrame) -> DataFrame:
    """(a, b, sha) of the nodes at which conversations end.

    Ids are sorted over all tasks and put together to strings of up to ID_BYTES, so the task that hashes a node where a third of all
    conversations end reads few rows, one at a time.
    """
    n = partitions(ways.sparkSession)
    ranged = ways.where("end").select("a", "b", "conv_id").repartitionByRange(n, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, node, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([",".join(held)], pa.string())], ["a", "b", "part", "number", "ids"])

        for batch in batches:
            for a, b, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if node is not None and ((a, b) != node or size > ID_BYTES):
                    yield row()
                    number, held, size = number + 1, [], 0
                node = (a, b)
                held.append(str(conv))
                size += len(held[-1])
        if held:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in batches:
            for a, b, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (a, b) != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (a, b), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) > 10_000:
                yield _named(out)
                out = []
        if node is not None:
            out.append((*node, sha.hexdigest()))
        if out:
            yield _named(out)

    joined = ranged.mapInArrow(join, "a long, b long, part int, number long, ids string")
    met = joined.repartition(n, "a", "b").sortWithinPartitions("a", "b", "part", "number").select("a", "b", "ids")
    return met.mapInArrow(digest, "a long, b long, sha string")


def _named(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["a", "b", "sha"])


def conversation_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of the rebuilt conversations (see :func:`turn_prefixes`, :func:`grafted_paths`, :func:`trie`)."""
    return trie(grafted_paths(turn_prefixes(conversations), every, most))
