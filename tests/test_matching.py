"""Bit-parallel matching of constant regions against plain edit distances; reports observed while reads are written."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oligoflow.functions import matching as m
from oligoflow.operators import preprocess


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(text: str, const: str, errors: int, least: int = 0) -> tuple[int, int]:
    n = len(const)
    d, _, k = min((distance(text[:k], const), abs(k - n), k) for k in range(max(n - errors, least), n + errors + 1))
    return d, k


def brute(text: str, const: str, errors: int) -> tuple[int, int, tuple | None]:
    d, k = nearest(text, const, errors)
    r, q = nearest(text[::-1], const[::-1], errors)
    inside = next(((s, x[1]) for s in range(len(text)) if (x := nearest(text[s:], const, errors, 1))[0] <= errors), None)
    return min(k, len(text)) if d <= errors else 0, min(q, len(text)) if r <= errors else 0, inside


@pytest.mark.parametrize(("const", "errors"), [("ACGACG", 0), ("ACGACGAC", 2), ("A", 1), ("ACé🙂G", 1), ("ACG" * 23, 4)])
def test_stretches_are_those_of_brute_force(const, errors):
    rng = random.Random(errors)
    texts = ["", "A", const, const[1:], const + const, "x" + const[::-1]] + ["".join(rng.choice("ACGé") for _ in range(rng.randrange(25))) for _ in range(120)]
    for _ in range(60):  # edited copies
        t = list(const)
        for _ in range(rng.randrange(errors + 2)):
            t[rng.randrange(len(t)) : rng.randrange(len(t) + 1)] = rng.choice(["", "A", "CG"])
            t = t or ["A"]
        texts.append("".join(rng.choice("ACG") for _ in range(rng.randrange(4))) + "".join(t) + "".join(rng.choice("ACG") for _ in range(rng.randrange(9))))
    reads = m.Reads(pa.array(texts))
    left, right, (start, length) = m.prefix_cuts(reads, const, errors), m.suffix_cuts(reads, const, errors), m.interior(reads, const, errors)
    for k, t in enumerate(texts):
        assert (left[k], right[k], None if start[k] < 0 else (start[k], length[k])) == brute(t, const, errors), t


def test_words_and_columns_agree(monkeypatch):
    rng = random.Random(2)
    reads = m.Reads(pa.array(["".join(rng.choice("ACGT") for _ in range(rng.randrange(60))) for _ in range(300)]))
    const = "ACGTTACGTAGGATCC"
    found = [m.prefix_cuts(reads, const, 5), m.suffix_cuts(reads, const, 5), *m.interior(reads, const, 5)]
    monkeypatch.setattr(m, "WORD_BITS", 4)
    for a, b in zip(found, [m.prefix_cuts(reads, const, 5), m.suffix_cuts(reads, const, 5), *m.interior(reads, const, 5)], strict=True):
        assert a.tolist() == b.tolist()


def test_trimming_of_both_ends_nulls_and_clashing_columns(spark):
    rows = [("AACCGGTTAACCGGTTACGTACGTTTGGCCAA", "I" * 32), ("ACGT", "++++"), ("", ""), (None, None), ("AACCGGTTTTGGCCAA", "I" * 16)]
    df = spark.createDataFrame(rows, "sequences string, quality string").withColumns({"left": F.lit(1), "_hit2": F.lit("x")})
    got = preprocess.trim_3p(preprocess.trim_5p(df, "AACCGGTT"), "TTGGCCAA").collect()
    assert [(r.sequences, r.quality) for r in got] == [("AACCGGTTACGTACGT", "I" * 16), ("ACGT", "++++"), ("", ""), (None, None), ("", "")]
    assert got[0].left == 1 and got[0]["_hit2"] == "x"
    best = preprocess.preprocess(df, "AACCGGTT", "TTGGCCAA", least=0, ends="best").collect()
    assert [r.sequences for r in best] == ["AACCGGTTACGTACGTTTGGCCAA", "TTGGCCAA"]
    s, k = brute(rows[0][0], "GGTTAACC", 1)[2]
    assert preprocess.excise_region(df, "GGTTAACC").first().sequences == rows[0][0][:s] + rows[0][0][s + k :]
    assert preprocess.preprocess(df.limit(0), "AACC", "GG").collect() == []


def test_report_of_the_job_that_writes(spark, tmp_path):
    rows = [("A" * n, "I" * n if n % 2 else "+" * n) for n in range(20)]
    df = spark.createDataFrame(rows, "sequences string, quality string")
    reads, seen = preprocess.preprocess_observed(df, least=5, most=15)
    reads.write.parquet(str(tmp_path / "r"))
    (row,) = preprocess.report_of(spark, seen).collect()
    assert tuple(row) == tuple(preprocess.preprocess_report(df, least=5, most=15).first()) == (20, 11, 6, 30.0)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 6
