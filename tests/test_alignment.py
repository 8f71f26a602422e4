"""Multiple alignment: optimal pairs, scores against center-star, clusters of several levels, gaps and metadata."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oligoflow.functions import progressive as pg
from oligoflow.operators import align


def pair_score(a: str, b: str) -> float:
    """Score of two aligned rows."""
    return sum(0 if x == y == "-" else pg.GAP if "-" in (x, y) else pg.MATCH if x == y else pg.MISMATCH for x, y in zip(a, b, strict=True))


def sum_of_pairs(rows: list[str]) -> float:
    return sum(pair_score(a, b) for a, b in itertools.combinations(rows, 2))


def best_pair(a: str, b: str) -> float:
    """Needleman-Wunsch score."""
    row = [pg.GAP * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], pg.GAP * i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j] + pg.GAP, row[j - 1] + pg.GAP, last + (pg.MATCH if x == y else pg.MISMATCH))
    return row[-1]


def rows_of(texts: list[str], at: list[np.ndarray]) -> list[str]:
    wide = max((int(x.max(initial=-1)) for x in at), default=-1) + 1
    out = []
    for t, x in zip(texts, at, strict=True):
        row = ["-"] * wide
        for c, k in zip(t, x.tolist(), strict=True):
            row[k] = c
        out.append("".join(row))
    return out


def profiles(texts: list[str], letters: str = "ACGT") -> list[np.ndarray]:
    return [pg.one_hot(np.array([letters.index(c) for c in t], int), len(letters) + 1) for t in texts]


def star(texts: list[str]) -> list[str]:
    """Center-star on the first sequence: each row aligned to it alone, gaps put together."""
    kept, inserted = [], []
    for t in texts:
        at_p, at_q, _ = pg.path(*profiles([texts[0], t]), pg.score_matrix(5))
        row = {int(k): c for c, k in zip(t, at_q, strict=True)}
        slots, line, now = [""] * (len(texts[0]) + 1), [], 0
        for k in range(max([*at_p.tolist(), *at_q.tolist()], default=-1) + 1):
            if k in at_p:
                line.append(row.get(k, "-"))
                now += 1
            else:
                slots[now] += row[k]
        kept.append(line)
        inserted.append(slots)
    wide = [max(len(x[s]) for x in inserted) for s in range(len(texts[0]) + 1)]
    return ["".join(x[s].ljust(wide[s], "-") + (line[s] if s < len(line) else "") for s in range(len(wide))) for line, x in zip(kept, inserted, strict=True)]


def family(rng: random.Random, size: int, length: int, edits: int) -> list[str]:
    base = [rng.choice("ACGT") for _ in range(length)]
    out = ["".join(base)]
    while len(out) < size:
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = rng.choice(["", "A", "C", "G", "T", "GT"])
        out.append("".join(t))
    return out


def test_pairs_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        at = pg.path(*profiles([a, b]), pg.score_matrix(5))
        x, y = rows_of([a, b], list(at[:2]))
        assert pair_score(x, y) == at[2] == best_pair(a, b) and not any(p == q == "-" for p, q in zip(x, y, strict=True))


@pytest.mark.parametrize(("size", "length", "edits"), [(3, 8, 3), (8, 20, 4), (20, 32, 3), (30, 32, 8), (12, 40, 14)])
def test_scores_are_at_least_those_of_center_star(size, length, edits):
    for seed in range(4):
        texts = family(random.Random(seed * 100 + size), size, length, edits)
        rows = rows_of(texts, pg.align(profiles(texts)))
        assert [r.replace("-", "") for r in rows] == texts and len({len(r) for r in rows}) == 1
        assert not any(set(c) == {"-"} for c in zip(*rows, strict=True))
        assert sum_of_pairs(rows) >= sum_of_pairs(star(texts))


def test_profiles_keep_their_own_alignment():
    rng = random.Random(4)
    groups = [family(rng, 6, 16, 3) for _ in range(3)]
    made = []
    for texts in groups:
        rows = rows_of(texts, pg.align(profiles(texts)))
        made.append((rows, sum(pg.one_hot(np.array(["ACGT-".index(c) for c in r]), 5) for r in rows)))
    at = pg.align([p for _, p in made])
    whole = [r for (rows, _), x in zip(made, at, strict=True) for r in rows_of(rows, [x] * len(rows))]
    wide = max(map(len, whole))
    whole = [r.ljust(wide, "-") for r in whole]
    assert [r.replace("-", "") for r in whole] == [t for g in groups for t in g]


def clusters(spark, rows):
    """(Cluster, Rank, sequences) as a clustered table; clashing names come along."""
    df = spark.createDataFrame(rows, "Cluster int, Rank long, sequences string")
    return df.withColumns({"RankInCluster": F.lit(1), "group": F.lit("x"), "seq": F.lit(1), "n": F.lit(2)})


@pytest.mark.parametrize("fan", [2, 48])
def test_clusters_of_several_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(align, "GROUP_ROWS", 8)
    monkeypatch.setattr(align, "FAN", fan)
    rng = random.Random(fan)
    rows = [(c, k, t) for c, size in ((1, 70), (2, 5), (3, 1), (None, 9)) for k, t in enumerate(family(rng, size, 24, 4))]
    rows += [(1, 500, rows[0][2]), (2, 501, None), (2, 502, ""), (4, 0, "AC-GT"), (4, 1, "ACGT")]
    out = align.cluster_align(clusters(spark, rows)).collect()
    assert sorted(((r.Cluster, r.Rank, r.sequences and r.sequences.replace("-", "")) for r in out), key=str) == sorted(((c, k, t and t.replace("-", "")) for c, k, t in rows), key=str)
    for c in (1, 2, 3, 4, None):
        mine = [r.sequences for r in out if r.Cluster == c and r.sequences is not None]
        assert len({len(x) for x in mine}) == 1 and not any(set(x) == {"-"} for x in zip(*mine, strict=True))
        texts = [t for k, _, t in rows if k == c and t]
        if c not in (2, 4):
            assert sum_of_pairs(mine) >= 0.98 * sum_of_pairs(star(texts))
    scores = {r.Cluster: r.score for r in align.alignment_score(spark.createDataFrame([r for r in out if r.sequences is not None])).collect()}
    assert scores == {c: sum_of_pairs([r.sequences for r in out if r.Cluster == c and r.sequences is not None]) for c in scores}
    assert align.cluster_align(clusters(spark, rows).limit(0)).collect() == []
