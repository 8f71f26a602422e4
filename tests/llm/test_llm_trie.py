"""Operator 12: subtree totals by tree contraction and the prefix trie, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from oligoflow.llm import contraction, trie


def brute_totals(parents: dict[int, int | None], value: dict[int, int]) -> dict[int, int]:
    total = collections.Counter(value)
    children = collections.Counter(p for p in parents.values() if p is not None)
    ready = [v for v in parents if not children[v]]
    while ready:
        v = ready.pop()
        p = parents[v]
        if p is not None:
            total[p] += total[v]
            children[p] -= 1
            if not children[p]:
                ready.append(p)
    return dict(total)


def shapes() -> dict[str, dict[int, int | None]]:
    rng = random.Random(3)
    return {
        "path": {k: k - 1 if k else None for k in range(60)},
        "star": {k: 0 if k else None for k in range(200)},
        "random": {k: rng.randrange(k) if k else None for k in range(300)},
        "comb": {k: None if k == 0 else (k - 1 if k % 2 else max(k - 2, 0)) for k in range(60)},
        "forest": {k: None if k % 50 == 0 else k - 1 - rng.randrange(min(3, k % 50)) for k in range(200)},
        "one": {0: None},
    }


@pytest.mark.parametrize("shape", list(shapes()))
def test_subtree_totals(spark, shape):
    parents = shapes()[shape]
    value = {k: (k * 7919) % 31 - 5 for k in parents}
    rows = [(k, -k, p, None if p is None else -p, None if k == 4 else value[k]) for k, p in parents.items()]
    df = spark.createDataFrame(rows, "a long, b long, pa long, pb long, v long").withColumns({"kids": F.lit("x"), "child": F.lit(1)})
    got = contraction.subtree_totals(df, ["v"]).collect()
    value[4] = 0
    assert {r.a: r.v for r in got} == {k: v for k, v in brute_totals(parents, value).items() if k in parents}
    kids = collections.Counter(p for p in parents.values() if p is not None)
    assert {r.a: r.kids for r in got} == {k: kids[k] for k in parents}


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(contraction, "_compress", lambda rest, values, n, f=contraction._compress: calls.append(n) or f(rest, values, n))
    df = spark.range(1000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.expr("nullif(id, 0) - 1").alias("pa"), F.expr("CASE WHEN id > 0 THEN 0L END").alias("pb"), F.lit(1).alias("v"))
    got = contraction.subtree_totals(df, ["v"])
    assert got.where("v <> 1000 - a").count() == 0 and len(calls) <= 22


def brute_trie(rows: list[tuple]) -> list[tuple]:
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out, children = [], collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words
    for k, m in members.items():
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_BYTES", 6)
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "a  b", "", "d e f\n"])) for c in rng.sample(range(400), 120) for t in range(rng.randrange(1, 7))]
    rows += [(20, t, "user", "loop") for t in range(60)] + [(c, 0, "user", "same start") for c in range(1000, 1200)]  # a long chain, and a node with many ends
    rows += [(5, None, None, None), (7, None, "x", "y"), (None, 1, "a", "b"), (9, 2, "a", "b"), (9, 2, "a", "b"), (9, 2, "a", "a"), (-41, 0, "neg", "id")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("x"), "a": F.lit(1), "words": F.lit(2)}).repartition(5)
    got = sorted(map(tuple, trie.conversation_trie(df).collect()), key=str)
    assert got == brute_trie(rows)


def test_plain_trie_and_empty_tables(spark):
    rows = [(1, 0, "u", "hello there"), (1, 1, "a", "hi"), (2, 0, "u", "hello there"), (2, 1, "a", "no " * 100_000), (3, 0, "u", "hello there")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.depth): r for r in trie.trie(trie.paths(trie.turn_prefixes(df))).collect()}
    assert {k: (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for k, r in got.items()} == {(1, 0): (3, 1, 2, 4), (1, 1): (3, 2, 2, 4), (1, 2): (1, 0, 1, 0), (2, 2): (1, 0, 1, 0)}
    assert got[1, 1].ends_sha256 == hashlib.sha256(b"3").hexdigest()
    assert trie.conversation_trie(df.limit(0)).collect() == []
