"""Operator 11: winnowing against brute force, its match guarantee, and comparison with the next text."""

import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from oligoflow.llm import fingerprints as fp
from oligoflow.llm import queries

SF = "/root/testdata/sf0.001"


def brute_marks(text: str, gram: int, window: int, alone: bool = True) -> list[tuple[int, int]]:
    """(hash, position) of the marks, window by window; with ``alone`` each gram is hashed on its own."""
    pieces = [text[k : k + gram] for k in range(max(len(text) - gram + 1, 1))] if text and alone else []
    hashes = [int(fp.grams([p], max(len(p), 1))[0][0]) for p in pieces] if alone else fp.grams([text], gram)[0].tolist()
    chosen = set()
    for k in range(max(len(hashes) - window + 1, min(len(hashes), 1))):
        part = hashes[k : k + window]
        chosen.add(k + len(part) - 1 - part[::-1].index(min(part)))
    return [(hashes[k], k) for k in sorted(chosen)]


def marks_of(fingerprint: str) -> list[tuple[int, int]]:
    return [tuple(map(int, x)) for x in zip(*fp.decode(fingerprint), strict=True)]


TEXTS = ["", "a", "abc", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabcabcabc", "Die Straße, größer 🙂 als gedacht – 例え。" * 3, "x" * 17 + "yz" * 40]


@pytest.mark.parametrize(("gram", "window"), [(3, 4), (5, 1), (4, 7), (16, 32)])
def test_marks_are_those_of_brute_force(gram, window):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abé🙂") for _ in range(rng.randrange(90))) for _ in range(60)]
    got = fp.encode(*fp.winnow(texts, gram, window), len(texts)).to_pylist()
    assert [marks_of(x) for x in got] == [brute_marks(t, gram, window) for t in texts]


def test_slices_give_the_same_marks(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (0, 3, 700, 40, 1500)]
    whole = fp.encode(*fp.winnow(texts, 6, 9), len(texts)).to_pylist()
    monkeypatch.setattr(fp, "CHUNK", 64)
    assert fp.encode(*fp.winnow(texts, 6, 9), len(texts)).to_pylist() == whole


def test_shared_passages_leave_a_mark():
    rng = random.Random(7)
    for _ in range(50):
        shared = "".join(rng.choice("abcdefgh ") for _ in range(fp.GRAM + fp.WINDOW - 1))
        a, b = ("".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(200))) + shared + "".join(rng.choice("qrstuv ") for _ in range(rng.randrange(200))) for _ in range(2))
        x, y = fp.encode(*fp.winnow([a, b]), 2).to_pylist()
        assert any(a[p : p + fp.GRAM] == b[q : q + fp.GRAM] for p, q in fp.shared_places(x, y))


def brute_next(rows: list[tuple], gram: int = fp.GRAM, window: int = fp.WINDOW) -> list[tuple]:
    """Result rows for (doc_id, text) in their order."""
    print_of = lambda t: fp.encode(*fp.winnow([t], gram, window), 1)[0].as_py()
    sets = functools.cache(lambda t: frozenset(h for h, _ in brute_marks(t, gram, window, alone=False)))
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        like = [len(sets(t) & sets(x)) / len(sets(t) | sets(x)) if sets(t) | sets(x) else 1.0 for x in (e, n)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), print_of(t), print_of(e), *like))
    return out


def test_query_of_all_documents(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(map(tuple, queries.QUERIES["op11_fingerprints"](spark, SF).collect()))
    assert got == brute_next(rows)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_ranges_and_borders(spark, monkeypatch, n):
    monkeypatch.setattr(fp, "RANGE_BYTES", 200)
    rng = random.Random(n)
    rows = [(None if k == 0 else k * 7 - 20, None if k == 3 else "".join(rng.choice("abcdef") for _ in range(rng.randrange(120)))) for k in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").withColumns({"guest": F.lit(1), "range": F.lit("x"), "h": F.lit(0)}).repartition(3)
    got = sorted(map(tuple, fp.compare_to_next(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == brute_next(rows)


def test_repeated_rows_empty_tables_and_long_texts(spark):
    rows = [(1, "same text, same id, same text")] * 5 + [(2, ""), (2, None), (3, "w" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.compare_to_next(df).collect()
    assert len(got) == 8 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert sorted(r.near_next for r in got if r.doc_id == 1) == [0.0, 1.0, 1.0, 1.0, 1.0]
    assert {(r.n_chars, r.fingerprint) for r in got if r.doc_id == 2} == {(0, "")}
    assert fp.compare_to_next(df.limit(0)).collect() == []
    clashing = df.select("doc_id", F.lit(1).alias("fingerprint"), F.lit(2).alias("_text"), "text")
    assert sorted((r.fingerprint for r in fp.fingerprint(clashing).collect())) == sorted(r.fingerprint for r in got)
    assert fp.fingerprint(df.limit(0)).collect() == []
