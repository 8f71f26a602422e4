"""Greedy clustering by edit distance, ranks in clusters, seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching as m
from ..functions import sequences as sq
from ..storage import numbered, numbered_within, stored

#: Rows without a cluster that are looked at for seeds at a time.
HEAD_ROWS = 2048


def cluster_input(counts: DataFrame, min_reads: int = 10) -> DataFrame:
    """Sequences with enough reads and their place ``_pos`` in seed order (RPU desc, Rank, sequence)."""
    return numbered(counts.where(F.col("Reads") >= min_reads), [F.col("RPU").desc(), F.col("Rank").asc(), F.col("sequences").asc()], "_pos")


def find_seeds(rows: DataFrame, max_led: int, total_clusters: int) -> list[str]:
    """The first seeds in order of ``_pos`` (dense from 1): rows farther than ``max_led`` edits from every seed before them.

    Whether a row is a seed depends on earlier rows only, so the first HEAD_ROWS rows that no seed so far reaches decide about
    themselves.  These and the seeds are what the driver holds.  A further look is needed only if they had too few seeds and left rows
    without one, so the number of passes doesn't follow the number of clusters.
    """
    seeds: list[str] = []
    rest = rows.where(F.col("_pos") <= HEAD_ROWS)
    while len(seeds) < total_clusters:
        head = rest.select("_pos", "sequences").orderBy("_pos").limit(HEAD_ROWS).collect()
        texts = [r["sequences"] for r in head]
        seeds += m.greedy_seeds(m.Reads(pa.array(texts, pa.string())), texts, max_led, total_clusters - len(seeds))
        if len(head) < HEAD_ROWS:
            break
        rest = rows.where(F.col("_pos") > head[-1]["_pos"]).where(_reach(seeds, max_led)["Cluster"].isNull())
    return seeds


def _reach(seeds: list[str], max_led: int) -> Column:
    """struct(Cluster, LED) of the first seed within ``max_led`` edits of ``sequences``, numbered from 1; both null if there is none."""

    def run(sequences: pa.Array) -> pa.Array:
        found, edits = m.first_within(m.Reads(sequences), seeds, max_led)
        none = found < 0
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int32), mask=none) for x in (found + 1, edits)], ["Cluster", "LED"])

    return F.arrow_udf(run, "struct<Cluster:int,LED:int>").asNondeterministic()(F.col("sequences"))  # so that the optimizer doesn't copy it


def cluster_led(counts: DataFrame, min_reads: int = 10, max_led: int = 7, total_clusters: int = 30, keep_nc: bool = True) -> DataFrame:
    """Clustered table: greedily, the first unassigned sequence is a seed and takes all unassigned ones within ``max_led`` edits.

    All seeds are found first; then every row takes the lowest-numbered seed in its reach, which is what one seed after the other
    gives, in a single pass.  After ``total_clusters`` the rest is cluster 0 (with ``keep_nc``), else dropped.
    """
    rows = stored(cluster_input(counts, min_reads), "cluster")
    seeds = find_seeds(rows, max_led, total_clusters)
    found = stored(rows.withColumn("_c", _reach(seeds, max_led)), "cluster")
    out = found.where("_c.Cluster IS NOT NULL")
    if keep_nc:
        rest = found.where("_c.Cluster IS NULL")
        first = rest.orderBy("_pos").limit(1).select(F.col("sequences").alias("_first"))
        left = rest.crossJoin(F.broadcast(first))  # one row
        out = out.unionByName(left.withColumn("_c", F.struct(F.lit(0).alias("Cluster"), F.levenshtein("sequences", "_first").alias("LED"))).drop("_first"))
    return rank_in_cluster(out.select("Rank", "Reads", "RPU", F.col("_c.Cluster").alias("Cluster"), F.col("_c.LED").alias("LED"), "sequences", "_pos"), [F.col("_pos").asc()]).drop("_pos").transform(with_ids)


def rank_in_cluster(df: DataFrame, order: list | None = None) -> DataFrame:
    """With ``RankInCluster`` by seed order."""
    return numbered_within(df, "Cluster", order or [F.col("RPU").desc(), F.col("Rank").asc(), F.col("sequences").asc()], "RankInCluster")


def with_ids(df: DataFrame) -> DataFrame:
    """The clustered table's columns in their order, with composed IDs."""
    columns = ["Rank", "Reads", "RPU", "Cluster", "RankInCluster", "LED"]
    return df.select(sq.compose_id(*columns).alias("ID"), *columns, "sequences")


def cluster_seeds(clustered: DataFrame) -> DataFrame:
    """(Cluster, ID, sequences) of each cluster's first sequence."""
    return clustered.where("RankInCluster = 1").select("Cluster", "ID", "sequences")
