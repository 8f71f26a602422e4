"""The registered llm queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import collections
import hashlib
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_pairs import brute_components, brute_hits
from test_llm_rows import brute_bytes, brute_quality, brute_secrets

import corpus_pipeline
from oligoflow.llm import quality, queries, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, tmp_path, name):
    queries.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "r"))
    duck.execute(f"CREATE OR REPLACE TEMP TABLE o AS {queries.ORACLES[name]}")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE r AS SELECT * FROM '{tmp_path}/r/*.parquet'")
    columns = sorted(x[0] for x in duck.sql("DESCRIBE r").fetchall())
    assert columns == sorted(x[0] for x in duck.sql("DESCRIBE o").fetchall())
    c = ", ".join(f'"{x}"' for x in columns)
    for a, b in (("o", "r"), ("r", "o")):
        assert duck.sql(f"SELECT {c} FROM {a} EXCEPT ALL SELECT {c} FROM {b} LIMIT 3").fetchall() == []


def test_bytes_of_documents(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = queries.QUERIES["op5_suffix_dedup"](spark, SF).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_bytes(rows, 400)


def test_secrets_of_documents(spark, duck):
    rows = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    got = queries.QUERIES["op7_secret_scan"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        n, spans = brute_secrets(rows[r.doc_id])
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (n, hashlib.sha256(spans.encode()).hexdigest())


def test_token_counts_of_documents(spark, duck):
    with open(token_counts.VOCABULARY, "rb") as f:
        e = token_counts.encoder(f.read(), token_counts.PATTERN)
    lengths = [len(e.encode_ordinary(t or "")) for (t,) in duck.sql("SELECT text FROM documents").fetchall()]
    got = queries.QUERIES["op3_token_counts"](spark, SF).collect()
    assert {r.n_tokens: r.n_docs for r in got} == dict(collections.Counter(lengths))
    for r in got:
        n = r.n_tokens
        over = [x for x in lengths if x > n]
        assert (r.docs_over, r.tokens_over, r.docs_within, r.tokens_within) == (len(over), sum(over), len(lengths) - len(over), sum(lengths) - sum(over))
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.share_within == r.docs_within / len(lengths)


def passes(text):
    m = brute_quality(text)
    chars, limits = max(m[1], 1), (quality.LINE_PERCENT, *quality.NGRAM_PERCENT.values())
    return not m[5] and 100 * m[2] <= quality.SYMBOL_PERCENT * chars and all(100 * x * m[0] <= (long * m[0] + (short - long) * 50) * chars for x, (short, long) in zip(m[6:], limits, strict=True))


def copies_of(doc_id, rate):
    u = int(hashlib.md5(f"17|{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    n, term, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        n += 1
        term *= rate / n
        total += term
    return n


def test_pipeline_stages_against_brute_force(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    rows, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
    for (name, stage), want in zip(
        corpus_pipeline.STAGES,
        (
            lambda rs: {d for d, r in rs.items() if passes(r.text)},
            lambda rs: {c for _, _, c in brute_components([(d, r.text) for d, r in rs.items()], 5, 80)},
            lambda rs: {d for d, r in rs.items() if not brute_hits([(d, r.text)], items)},
            set,
            None,
        ),
        strict=True,
    ):
        out = stage(spark, docs, SF)
        if want is None:
            got = collections.Counter(r.doc_id for r in out.collect())
            n = collections.Counter(r.source for r in rows.values())
            assert got == collections.Counter({d: k for d, r in rows.items() if (k := copies_of(d, len(rows) / len(n) / n[r.source]))})
            break
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        now = {r.doc_id: r for r in docs.collect()}
        assert set(now) == want(rows) and docs.count() == len(now), name
        if name == "redact_secrets":
            assert all(brute_secrets(r.text)[1] == "" and r.n_chars == len(r.text) for r in now.values())
            assert all(r.text == rows[d].text for d, r in now.items() if "[SECRET]" not in r.text)
        rows = now
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_runs_on_empty_and_odd_documents(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    good = " ".join(f"word{k}" for k in range(80))
    for k, rows in enumerate(([], [(None, None, None, None, None), (1, "", "en", "a", 0), (None, good, None, None, None), (2, good, "en", None, 5), (2, good, "en", None, 5)])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{k}" / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / f"{k}" / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / f"{k}")).collect()
        assert {r.doc_id for r in got} <= {2} and all(r.text == good for r in got)


def test_pipeline_keeps_a_callers_columns(spark):
    """Columns with names that the operators use, ties and a very long text, in each stage but the last two names of mixing."""
    names = ["_bad", "_set", "_base", "_spans", "_rate", "base", "spans", "kept", "component", "set_id", "group", "id", "key", "h", "n", "x", "label", "item_id", "n_words"]
    good = " ".join(f"word{k}" for k in range(80))
    long = " ".join(f"long{k}" for k in range(150_000))
    rows = [(7, good, "a"), (7, good, "a"), (3, good, None), (None, good, "b"), (4, long, "b"), (5, long + " password=abcdefghijklmnop", "b"), (6, None, "c"), (8, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(f"own {x}").alias(x) for x in names]).repartition(2)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        kept = docs.collect()
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == ([3, 4, 5, 7, 7] if name == "quality_rules" else [3, 4]), name
        assert all(r[x] == f"own {x}" for r in kept for x in names), name
        docs = spark.createDataFrame(kept, docs.schema)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.columns == [*columns, "copy_no", "shuffle_key"]
    assert all(r.text in (good, long) and r[x] == f"own {x}" for r in mixed.collect() for x in names)
