"""Operator 13: ranked search over stages and shards against brute force."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from oligoflow.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {x: x + 32 for x in range(65, 91)}


def brute(items: list[tuple], docs: list[tuple], best: int) -> list[tuple]:
    of = lambda t: TERM.findall((t or "").translate(FOLD))
    bags = [(i, collections.Counter(of(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    sought = collections.defaultdict(set)
    for i, t in items:
        sought[i] |= set(of(t))
    out = []
    for i, terms in sought.items():
        scores = []
        for doc, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(i, k + 1, doc if has else None, -s) for k, (s, has, doc) in enumerate(sorted(scores)[:best])]
    return out


def ranked(spark, items, docs, best):
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "shard": F.lit("y")}).repartition(3)
    return [tuple(r) for r in search.search(q, d, best).collect()]


def made(seed: int, n: int) -> tuple[list, list]:
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(60)] + ["Éa", "ß9", "the"]
    text = lambda size: " ".join(words[min(int(rng.expovariate(0.08)), 62)] + rng.choice(["", ".", "-x", "\n"]) for _ in range(size))
    docs = [(k, text(rng.randrange(40))) for k in range(n)]
    docs += [(None, "w1 w2 w3"), (n + 1, None), (n + 2, ""), (n + 3, "... !!"), (n + 4, "w50 " * 400)] + [(n + 5 + k, "same old words w7") for k in range(40)]
    items = [(k, text(rng.randrange(1, 15))) for k in range(12)] + [(40, None), (41, ""), (None, "w1 the"), (42, "same w7"), (42, "old"), (43, "absent words only here")]
    return items, docs


@pytest.mark.parametrize("best", [1, 5, 500])
def test_all_scores_are_those_of_brute_force(spark, monkeypatch, best):
    monkeypatch.setattr(search, "SHARD_DOCS", 30)
    items, docs = made(best, 160)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(ranked(spark, items, docs, best), key=key) == sorted(brute(items, docs, best), key=key)


def test_blocks_of_items_and_documents_put_off(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_PAIRS", 30)
    monkeypatch.setattr(search, "SHARD_POSTINGS", 200)
    items, docs = made(7, 200)
    carried = []
    real = search._reached
    monkeypatch.setattr(search, "_reached", lambda bundles, *a: carried.append(bundles.where("item >= 0").agg(F.sum(F.octet_length("docs"))).first()[0] or 0) or real(bundles, *a))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(ranked(spark, items, docs, 3), key=key) == sorted(brute(items, docs, 3), key=key)
    assert len(carried) > 3  # several blocks of several stages


def test_empty_tables_and_long_texts(spark):
    items, docs = [(1, "needle " * 3)], [(1, "hay " * 200_000 + "needle"), (2, "needle"), (3, "hay")]
    assert ranked(spark, items, docs, 50) == brute(items, docs, 50)
    assert ranked(spark, items, [], 50) == ranked(spark, [], docs, 50) == ranked(spark, [(1, None)], docs, 50) == []
    assert ranked(spark, items, [(1, None), (2, "")], 50) == []
