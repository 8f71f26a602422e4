"""Reads derived from the test tables: the same as their SQL, and made once."""

import pytest
from pyspark.sql import functions as F

from oligoflow.operators import counts
from oligoflow.plans import fixtures, registry


def test_reads_are_those_of_the_sql_and_made_once(spark, tmp_path):
    rows = [(o, p, s, n) for o in (0, 7, 13, 164, None) for p in (-81, -39, 0, 39, 19999, None) for s, n in ((0, 1), (5, 4), (998, 7), (None, 2), (3, None))]
    lineitem = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    lineitem.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fixtures.reads(spark, str(tmp_path))
    want = spark.sql(fixtures.READS, lineitem=lineitem)
    assert got.schema.names == want.schema.names and got.count() == len(rows)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = registry.length_filter(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("% 40") == 1 and "md5" not in plan  # the filter had copies of both


def test_reads_of_a_population_are_made_once(spark):
    unique = counts.count_unique(fixtures.reads(spark, "/root/testdata/sf0.001").where("population = 0").select("sequences"))
    plan = unique._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("% 40") == 1 and "md5" not in plan


@pytest.mark.parametrize("name", ["recluster", "enrich_full", "recount"])
def test_both_populations_are_counted_in_one_pass(spark, monkeypatch, name):
    real, passes = fixtures.reads, []
    monkeypatch.setattr(fixtures, "reads", lambda *a: passes.append(1) or real(*a))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert len(passes) == 1


def test_populations_counted_together_are_those_counted_alone(spark, monkeypatch):
    rows = [(p, t) for p in (0, 1, -1, None) for t in ("ACGT", "AC\rGT", "AAAA", "", None) for _ in range(1 + abs(p or 0) * len(t or ""))]
    reads = spark.createDataFrame(rows, "population long, sequences string")
    monkeypatch.setattr(fixtures, "reads", lambda *a: reads)
    for k, got in enumerate(fixtures.populations(spark, "")):
        want = counts.count(reads.where(F.col("population") == k).select("sequences"))
        assert got.schema.names == want.schema.names and got.count() == 3
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
