"""The two-dimensional map: weights against brute force, and how many exact neighbours it keeps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oligoflow.operators import kmer, layout


def kept(rows, want, neighbors):
    """Share of each row's exact neighbours that are among its nearest on a map of (name, x, y)."""
    names, xy = [r[0] for r in rows], np.array([r[1:3] for r in rows])
    d = np.square(xy[:, None] - xy[None]).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :neighbors]
    return np.mean([len(want[n] & {names[j] for j in near[i]}) / neighbors for i, n in enumerate(names)])


def test_weights(spark):
    rng = random.Random(1)
    rows = [(f"q{q}", f"n{k}", d) for q in range(20) for k, d in enumerate(sorted(rng.uniform(1, 9) for _ in range(12)))] + [("one", "n0", 3.0), ("same", "n0", 2.0), ("same", "n1", 2.0), ("same", "n2", 2.0)]
    df = spark.createDataFrame(rows, "query string, neighbor string, distance double").repartition(3)
    got = {(r.query, r.neighbor): r.weight for r in layout.neighbor_weights(df).collect()}
    assert set(got) == {r[:2] for r in rows}
    for q in range(20):
        assert sum(got[f"q{q}", f"n{k}"] for k in range(12)) == pytest.approx(math.log2(12), rel=1e-6) and max(got[f"q{q}", f"n{k}"] for k in range(12)) == 1.0
    assert got["one", "n0"] == got["same", "n2"] == 1.0


def test_graph_is_the_union_of_both_directions(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "a", 1.0), ("b", "c", 1.5), ("c", "b", 1.5)], "query string, neighbor string, distance double")
    w = {(r.query, r.neighbor): r.weight for r in layout.neighbor_weights(df).collect()}
    got = {(r.i, r.j): r.weight for r in layout.neighbor_graph(df).collect()}
    for x, y in ("ab", "ac", "bc"):
        p, q = w.get((x, y), 0.0), w.get((y, x), 0.0)
        assert got[x, y] == got[y, x] == pytest.approx(p + q - p * q)
    assert len(got) == 6


def test_map_keeps_neighbours(spark):
    rng, made = random.Random(2), []
    for _ in range(4):  # each a walk of single changes
        t = [rng.choice("ACGT") for _ in range(30)]
        for _ in range(45):
            t[rng.randrange(30)] = rng.choice("ACGT")
            made.append("".join(t))
    names = set(made)
    df = spark.createDataFrame([(n, 1) for n in names] + [(next(iter(names)), 2), (None, 3)], "sequences string, n int").withColumn("x", F.lit("clash"))
    found = kmer.kmer_neighbors(df.where("sequences IS NOT NULL").select("sequences").distinct(), df.where("sequences IS NOT NULL").select("sequences").distinct(), 3, 10, exact=True).collect()
    want = {n: {r.neighbor for r in found if r.query == n} for n in names}
    flat = [tuple(r) for r in kmer.kmer_pca(df.where("sequences IS NOT NULL").select("sequences").distinct(), 3).select("sequences", "PC1", "PC2").collect()]
    got = [tuple(r) for r in layout.kmer_layout(df, 3, 10, epochs=15, exact=True).collect()]
    assert {r[0] for r in got} == names and len(got) == len(names) and np.isfinite([r[1:] for r in got]).all()
    assert kept(got, want, 10) >= 0.7 > kept(flat, want, 10)


def test_small_maps(spark):
    start = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 5.0, 1.0)], "name string, x double, y double")
    graph = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "i string, j string, weight double")
    one, two = (sorted(map(tuple, layout.layout(graph, start, epochs=8, seed=3).collect())) for _ in range(2))
    assert np.allclose([r[1:] for r in one], [r[1:] for r in two]) and [r[0] for r in one] == ["a", "b", "c"]
    far = lambda p, q: math.dist(one[p][1:], one[q][1:])
    assert far(0, 1) < far(0, 2)
    assert len(layout.layout(graph, start.limit(1), epochs=3).collect()) == 1 and layout.layout(graph, start.limit(0), epochs=3).collect() == []


def test_nearest_of_blocks_are_those_of_brute_force():
    """Products of matrices only choose the rows; ties, copies, near ties and far larger vectors change nothing."""
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 3, (700, 20)) * 0.37
    rows[50:150], rows[600:] = rows[50], rows[600:] * 1e4
    rows[150:160] += rng.uniform(-1e-7, 1e-7, (10, 20))
    names = np.array([f"r{k % 690}" for k in rng.permutation(700)], object)
    queries = list(names[:300])
    got = {}
    for i, j, far in kmer._block_nearest(queries, rows[:300], names, rows, 7):
        assert len(i) > 300  # many queries at a time
        for x in zip(i.tolist(), far.tolist(), names[j], strict=True):
            got.setdefault(x[0], []).append(x[1:])
        break
    for i in range(kmer.QUERY_ROWS):
        far = np.rint(np.sqrt(np.square(rows - rows[i]).sum(axis=1)) * 1e6) / 1e6
        assert got[i] == sorted((d, n) for d, n in zip(far.tolist(), names, strict=True) if n != queries[i])[:7]
