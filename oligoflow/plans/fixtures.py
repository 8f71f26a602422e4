"""Sequencing reads derived from the ``lineitem`` table: families of 32 nucleotides with substitutions.

The SQL runs unchanged in Spark and in DuckDB, so queries and oracles begin with the same rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, counts
from ..storage import stored

#: Constant regions of the raw reads.
CONST_5P, CONST_3P = "ACGTTACGTA", "GGATCCTTAA"

READS = """
SELECT l_orderkey, l_linenumber, l_orderkey % 2 AS population, sequences, quality,
       concat(pre, sequences, suf) AS raw, concat(repeat('I', length(pre)), quality, repeat('I', length(suf))) AS raw_quality,
       CASE WHEN l_suppkey % 5 = 0 THEN concat(substring(sequences, 1, 9), substring(sequences, 11, 22)) ELSE sequences END AS ragged,
       CASE WHEN l_orderkey % 3 = 0 THEN concat(substring(sequences, 1, gap - 1), '-', substring(sequences, gap + 1, 32)) ELSE sequences END AS aligned
FROM (
  SELECT l_orderkey, l_linenumber, l_suppkey, cast(1 + l_suppkey % 32 AS INT) AS gap,
         concat(substring(b, 1, p1 - 1), n1, substring(b, p1 + 1, p2 - p1 - 1), n2, substring(b, p2 + 1, 32)) AS sequences,
         translate(md5(concat(cast(l_orderkey AS STRING), '-', cast(l_linenumber AS STRING))), '0123456789abcdef', 'IIIIIIIIIIIIIII+') AS quality,
         CASE WHEN l_orderkey % 13 = 0 THEN '' WHEN l_orderkey % 11 = 0 THEN 'ACGTTCGTA' WHEN l_orderkey % 7 = 0 THEN 'ACGATACGTA' ELSE 'ACGTTACGTA' END AS pre,
         CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE 'GGATCCTTAA' END AS suf
  FROM (
    SELECT l_orderkey, l_linenumber, l_suppkey,
           translate(md5(cast(l_partkey % 40 AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b,
           cast(1 + l_orderkey % 15 AS INT) AS p1, cast(17 + l_suppkey % 16 AS INT) AS p2,
           substring('ACGT', cast(1 + l_linenumber % 4 AS INT), 1) AS n1, substring('ACGT', cast(1 + l_suppkey % 4 AS INT), 1) AS n2
    FROM {lineitem}) t) u
"""


#: The part of READS that gives one of 40 sequences, and what makes a read of it.
_FAMILY = "translate(md5(cast(l_partkey % 40 AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_READ = "concat(substring(b, 1, p1 - 1), n1, substring(b, p1 + 1, p2 - p1 - 1), n2, substring(b, p2 + 1, 32))"


def _once() -> str:
    """READS for Spark, which else copies these expressions into filters, and to every place where a read is used (dozens of times for ``ragged``).

    The sequences of all remainders (-39 to 39) are looked up; a read comes out of a generator, which the optimizer doesn't copy.
    """
    families = [hashlib.md5(str(k).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4)) for k in range(-39, 40)]
    return READS.replace(_FAMILY, f"get(array({', '.join(map(repr, families))}), cast(l_partkey % 40 AS INT) + 39)").replace(_READ, f"explode(array({_READ}))")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads."""
    return spark.sql(_once(), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts table of all reads."""
    return counts.count(reads(spark, sf_dir).select("sequences"))


def populations(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Counts tables of populations 0 and 1, whose copies are counted in one pass over all reads."""
    both = stored(counts.count_unique(reads(spark, sf_dir), "population"), "populations")
    return [counts.finished(both.where(F.col("population") == k).drop("population")) for k in (0, 1)]


def clustered(counted: DataFrame) -> DataFrame:
    """A counts table in 16 clusters by the third and fifth base (a quick stand-in for clustering), ranked, with distances to the seeds."""
    base = lambda k: F.expr(f"instr('ACGT', substring(sequences, {k}, 1))")
    ranked = cluster.rank_in_cluster(counted.withColumn("Cluster", (4 * (base(3) - 1) + base(5)).cast("int")))
    seeds = ranked.where("RankInCluster = 1").select(F.col("Cluster").alias("_c"), F.col("sequences").alias("_s"))
    return cluster.with_ids(ranked.join(seeds, F.col("Cluster") == F.col("_c")).withColumn("LED", F.levenshtein("sequences", "_s")))


def prelude(recursive: bool = False) -> str:
    """The same tables as DuckDB CTEs: reads, count0/count1/counta (populations, all reads), cluster0/cluster1/clustera."""
    out = [f"WITH {'RECURSIVE ' if recursive else ''}reads AS ({READS.format(lineitem='lineitem')})"]
    for p in (0, 1, "a"):
        out.append(f"u{p} AS (SELECT sequences, count(*) AS Reads FROM reads WHERE {'true' if p == 'a' else f'population = {p}'} GROUP BY sequences)")
        out.append(finished_sql(f"u{p}", f"count{p}"))
        out.append(
            f"r{p} AS (SELECT *, CAST(row_number() OVER (PARTITION BY Cluster ORDER BY RPU DESC, Rank, sequences) AS INT) AS RankInCluster FROM ("
            f"SELECT *, CAST(4 * (instr('ACGT', substring(sequences, 3, 1)) - 1) + instr('ACGT', substring(sequences, 5, 1)) AS INT) AS Cluster FROM count{p}))"
        )
        out.append(
            f"cluster{p} AS (SELECT concat('Rank=', Rank, ';Reads=', Reads, ';RPU=', RPU, ';Cluster=', Cluster, ';RankInCluster=', RankInCluster, ';LED=', LED) AS ID, Rank, Reads, RPU, Cluster, RankInCluster, LED, sequences FROM ("
            f"SELECT r.* EXCLUDE (ID, length), CAST(levenshtein(r.sequences, s.sequences) AS INT) AS LED FROM r{p} r JOIN r{p} s ON s.Cluster = r.Cluster AND s.RankInCluster = 1))"
        )
    return ",\n".join(out) + "\n"


def finished_sql(source: str, name: str) -> str:
    """A CTE that makes a counts table of (sequences, Reads)."""
    return (
        f"{name} AS (SELECT concat('Rank=', Rank, ';Reads=', Reads, ';RPU=', RPU) AS ID, Rank, Reads, RPU, CAST(length(sequences) AS INT) AS length, sequences FROM ("
        f"SELECT sequences, CAST(Reads AS BIGINT) AS Reads, row_number() OVER (ORDER BY Reads DESC, sequences) AS Rank, CAST(round_even(Reads / ((SELECT CAST(sum(Reads) AS DOUBLE) FROM {source}) / 1e6), 0) AS BIGINT) AS RPU FROM {source}))"
    )
