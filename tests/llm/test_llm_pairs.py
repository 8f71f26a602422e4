"""Near-duplicates, decontamination and the pipeline against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from oligoflow.llm import decontam, graph, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    return [(d, len(sets[i]), best.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(seed, groups=4, copies=25, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, doc = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 4, 8))):
                w[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((doc, " ".join(w)))
            doc += 1
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "One  TWO"), (1005, "one two three"), (None, "one two"), (1006, "É é"), (1007, "é é"), (1003, "one two")]


def report(spark, rows, n, percent=80):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int").repartition(3)
    return df, near_dedup.near_duplicates(df, n, percent)


def test_components_against_brute_force(spark):
    rows = near_copies(3) + EDGES
    random.Random(1).shuffle(rows)
    _, got = report(spark, rows, 4)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == sorted(brute_components(rows, 4, 80), key=str)


def test_chains_of_links(spark):
    base = [f"x{k}" for k in range(200)]
    rows = []
    for step in range(12):  # each text is close to the one before only
        base = base[:]
        for k in range(4):
            base[step * 16 + k] = f"y{step}_{k}"
        rows.append((step, " ".join(base)))
    _, got = report(spark, rows, 4)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(d, c) for d, _, c in brute_components(rows, 4, 80)}


def test_empty_table(spark):
    _, got = report(spark, [(1, "a b c d e")], 4)
    assert [(r.component_id, r.kept) for r in got.collect()] == [(1, True)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def test_drop_keeps_one_of_each(spark):
    rows = near_copies(5, groups=2, copies=10) + EDGES
    df, got = report(spark, rows, 5)
    left = near_dedup.drop_near_duplicates(df, 5)
    assert left.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    want = {c for _, n, c in brute_components(rows, 5, 80) if n}
    assert sorted(d for d, t in kept if shingles(t, 5)) == sorted(want)
    assert sum(not shingles(t, 5) for _, t in kept) == 3


@pytest.mark.parametrize("shingles_", [5, 20, 60, 400])
def test_sketches_sieve_no_links(shingles_):
    """Pairs at or just above 0.8, 10,000 for each size: the sieve drops none, and all but a few in a million share a band."""
    import numpy as np

    from oligoflow.llm import hashing as hs

    rng = np.random.default_rng(shingles_)
    pairs = 10_000
    union = shingles_ if shingles_ > 5 else 5
    common = -(-4 * union // 5)
    h = hs.mix(rng.integers(0, 2**62, (pairs, union)).astype(np.uint64))
    half = common + (union - common) // 2
    a, b = h[:, :half], np.concatenate([h[:, :common], h[:, half:]], axis=1)
    found = []
    for x in (a, b):
        m = near_dedup.min_hashes(np.arange(0, x.size + 1, x.shape[1]), np.ascontiguousarray(x).ravel())
        found.append((near_dedup.odd_sketches(m).view(np.uint64), near_dedup.band_keys(m)))
    apart = np.bitwise_count(found[0][0] ^ found[1][0]).sum(axis=1)
    assert (apart <= near_dedup.sketch_limit(0.8)).all()
    assert (found[0][1] == found[1][1]).any(axis=1).all()


def test_templates_make_no_groups(spark, monkeypatch):
    """2,000 texts that share a third of their shingles, none linked: no pair of blocks is compared."""
    rng = random.Random(6)
    template = [f"t{k}" for k in range(40)]
    rows = [(d, " ".join(template + [f"u{d}x{k}" for k in range(80)])) for d in range(2000)]
    rows += [(5000 + d, t) for d, t in near_copies(8, groups=3, copies=8)]
    rng.shuffle(rows)
    seen = []
    plain = near_dedup._rare_edges
    monkeypatch.setattr(near_dedup, "_rare_edges", lambda *x: seen.append(near_dedup.stored(plain(*x), "edges")) or seen[-1])
    _, got = report(spark, rows, 5)
    got = got.collect()
    assert all(r.component_id == r.doc_id for r in got if r.doc_id < 2000)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id >= 5000} == {(d, c) for d, _, c in brute_components([x for x in rows if x[0] >= 5000], 5, 80)}
    assert seen[0].count() < 30


def test_very_long_texts(spark):
    long = [f"w{k}" for k in range(150_000)]
    near = long[:70_000] + ["other"] * 3000 + long[73_000:]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long)), (4, "x" * 1_000_000), (5, "")]
    _, got = report(spark, rows, 5)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(long[-30:]))], "item_id long, text string")
    assert {r.doc_id for r in decontam.contamination(df, items).collect()} == {1, 2, 3}


@pytest.mark.parametrize("edges", [[], [(5, 3), (3, 9), (9, 1), (20, 21)], [(k, k + 1) for k in range(40)], [(100, k) for k in range(60)]])
def test_components(spark, edges):
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        merged = {a, b} | want.get(a, set()) | want.get(b, set())
        for x in merged:
            want[x] = merged
    assert got == {x: min(s) for x, s in want.items()}


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "tiny item"), (3, None), (4, ""), (5, "one two three four five six seven"), (None, "p q r s t u v w x y z")]


def brute_hits(docs, items, n=5, percent=80):
    out = []
    for d, t in docs:
        for i, u in items:
            a, b = shingles(t, n), shingles(u, n)
            if b and 100 * len(a & b) >= percent * len(b):
                out.append((d, i, len(a & b), len(b)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_containment(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    filler = " ".join(f"f{k}" for k in range(3000))
    docs = [(1, f"{filler} {ITEMS[0][1].upper()} {filler}"), (2, "tiny item"), (3, "a tiny item"), (4, None), (5, ""), (None, "one two three four five six seven"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (6, "p q r s t u v w x y z"), (7, filler)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("_bad", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontam.contamination(df, items).collect()), key=str)
    assert got == brute_hits(docs, ITEMS)
    bad = {t for d, t in docs for i, u in ITEMS if brute_hits([(d, t)], [(i, u)])}
    left = decontam.drop_contaminated(df, items)
    assert left.columns == df.columns
    assert sorted((r.text for r in left.collect()), key=str) == sorted((t for _, t in docs if t not in bad), key=str)
    assert decontam.contamination(df.limit(0), items).count() == 0
    assert decontam.drop_contaminated(df, items.limit(0)).count() == len(docs)
