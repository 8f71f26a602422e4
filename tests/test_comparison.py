"""Similarity join, nearest clusters and exact order statistics against brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_matching import distance

from oligoflow.functions import matching
from oligoflow.operators import cluster, compare, selection, similarity


def changed(rng: random.Random, text: str, edits: int) -> str:
    t = list(text)
    for _ in range(edits):
        k = rng.randrange(len(t) + 1)
        t[k : k + rng.randrange(2)] = rng.choice(["", "A", "C", "G", "T"])
    return "".join(t)


@pytest.mark.parametrize(("most", "length"), [(0, 10), (1, 6), (2, 20), (3, 9), (6, 32), (2, 3)])
def test_pairs_are_those_of_the_matrix(spark, most, length):
    rng = random.Random(most)
    base = ["".join(rng.choice("ACGT") for _ in range(max(0, length + rng.randrange(-3, 4)))) for _ in range(30)]
    left, right = ([(k, changed(rng, rng.choice(base), rng.randrange(most + 2))) for k in range(120)] + [(999, ""), (998, None)] for _ in range(2))
    a, b = spark.createDataFrame(left, "i long, s string"), spark.createDataFrame(right, "j long, t string")
    got = {tuple(r) for r in similarity.similar_pairs(a, b, most).collect()}
    assert got == {tuple(r) for r in a.crossJoin(b).withColumn("led", F.levenshtein("s", "t", most)).where("led >= 0").select("i", "j", "led").collect()}
    assert similarity.similar_pairs(a, b.limit(0), most).collect() == similarity.similar_pairs(a.limit(0), b, most).collect() == []


def test_nearest_clusters_of_many_seeds_without_a_cross_join(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ACGT") for _ in range(32)) for _ in range(1500)]
    tables = [spark.createDataFrame([(k + 1, 1, changed(rng, t, rng.randrange(9))) for k, t in enumerate(base[s:])], "Cluster int, RankInCluster int, sequences string") for s in (0, 300)]
    got = compare.nearest_clusters(*tables, 7)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, compare.merge_candidates(compare.led_matrix(*tables), 7).collect()))


def test_order_statistics_are_exact(spark, monkeypatch):
    rng = random.Random(6)
    one = [rng.choice([1, -1]) * 10 ** rng.uniform(-200, 200) for _ in range(500)] + [0.0, -0.0, 999.999] * 50
    two = [round(rng.gauss(0, 3), 3) for _ in range(650)]
    rows = [(a, b if k % 7 else None, None, 7 if k == 3 else None) for k, (a, b) in enumerate(zip(one, two, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int")
    fractions = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    for bits in (16, 4):
        monkeypatch.setattr(selection, "DIGIT_BITS", bits)
        got = selection.order_statistics(df, dict.fromkeys("abcd", fractions))
        assert got["c"] == [None] * 6 and got["d"] == [7.0] * 6
        assert got["a"] == pytest.approx(np.quantile(one, fractions).tolist(), rel=1e-12)
        assert got["b"] == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], fractions).tolist(), rel=1e-12)
    assert selection.medians(df, ["a"])["a"] == statistics.median(one)
    assert selection.medians(df.limit(0), ["a", "b"]) == {"a": None, "b": None}


def test_matrix_statistics_by_counts(spark):
    m = spark.createDataFrame([(1, k, x) for k, x in enumerate([3, 9, 7, 7, 12, 0])], "c1 int, c2 int, led int")
    r = compare.led_matrix_stats(m, 7).first()
    x = [3, 9, 7, 7, 12, 0]
    assert (r.min, r.max, r.below_count) == (0, 12, 4) and r.median == statistics.median(x)
    assert r["mean"] == pytest.approx(statistics.mean(x)) and r["std"] == pytest.approx(statistics.pstdev(x)) and r.below_percent == pytest.approx(400 / 6)


def test_clusters_in_few_passes_are_those_of_the_loop(spark, monkeypatch):
    rng = random.Random(9)
    base = ["".join(rng.choice("ACGT") for _ in range(24)) for _ in range(60)]
    texts = list(dict.fromkeys(changed(rng, rng.choice(base), rng.randrange(6)) for _ in range(700)))
    rows = [(f"id{k}", k + 1, 1000 - k, 1000 - k, len(t), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "ID string, Rank long, Reads long, RPU long, length int, sequences string")

    def loop(total: int) -> dict[str, tuple[int, int]]:
        rest, out = list(texts), {}
        for c in range(1, total + 1):
            if not rest:
                break
            seed = rest[0]
            near = {t: distance(t, seed) for t in rest}
            out |= {t: (c, d) for t, d in near.items() if d <= 4}
            rest = [t for t in rest if near[t] > 4]
        return out | {t: (0, distance(t, rest[0])) for t in rest}

    real, passes = matching.greedy_seeds, []
    monkeypatch.setattr(matching, "greedy_seeds", lambda *a: passes.append(1) or real(*a))
    for head, total in ((2048, 3), (2048, 500), (64, 500)):
        monkeypatch.setattr(cluster, "HEAD_ROWS", head)
        passes.clear()
        got = cluster.cluster_led(df, min_reads=1, max_led=4, total_clusters=total).collect()
        assert {r.sequences: (r.Cluster, r.LED) for r in got} == loop(total)
        assert len(passes) == 1 if head == 2048 else len(passes) > 2
        for c in {r.Cluster for r in got}:
            mine = sorted((r.RankInCluster, r.Rank) for r in got if r.Cluster == c)
            assert [a for a, _ in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda x: x[1])
