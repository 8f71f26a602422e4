"""Diversity of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import rint_to


def simpson_index(reads: Column) -> Column:
    """Aggregate: 1 - sum r(r-1) / (N(N-1)) to two decimals; 0 if there is at most one read."""
    r = reads.cast("double")
    n = F.sum(r)
    return F.when(n <= 1, F.lit(0.0)).otherwise(rint_to(1 - F.sum(r * (r - 1)) / (n * (n - 1)), 2))


def cluster_diversity(clustered: DataFrame) -> DataFrame:
    """One row for each cluster: sizes, mean edit distance, Simpson index, seed; in one aggregate, by Cluster."""
    seed = F.max(F.when(F.col("RankInCluster") == 1, F.struct("ID", "sequences")))
    out = clustered.groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("TotalSequences"), F.sum("Reads").alias("TotalReads"), F.sum("RPU").alias("TotalRPU"),
        rint_to(F.avg("LED"), 2).alias("AverageLED"), simpson_index(F.col("Reads")).alias("SID"), seed.alias("_seed"),
    )
    return out.select("Cluster", "TotalSequences", "TotalReads", "TotalRPU", "AverageLED", "SID", F.col("_seed.ID").alias("ID"), F.col("_seed.sequences").alias("sequences")).orderBy("Cluster")


def cluster_metaplot(clustered: DataFrame) -> DataFrame:
    """The series that a plot over clusters needs."""
    return cluster_diversity(clustered).select("Cluster", "TotalSequences", "TotalReads", "AverageLED")
