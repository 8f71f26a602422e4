"""Comparing two populations: enrichment, merging clusters, ranking by enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import rint_to
from ..storage import numbered_within, stored
from . import selection
from .similarity import similar_pairs

#: What infinite values become (fixed values).
MOST_ENRICHED, MOST_LOG2 = 999.999, 20.0


def _suffixed(df: DataFrame, suffix: str, drop: tuple[str, ...] = ("length",)) -> DataFrame:
    return df.select("sequences", *[F.col(c).alias(f"{c}_{suffix}") for c in df.columns if c != "sequences" and c not in drop])


def enrich(a: DataFrame, b: DataFrame, keep_na: bool = False) -> DataFrame:
    """Sequences of both populations (all, with ``keep_na``) with Enrichment = RPU_b / RPU_a and its log2, to 3 decimals, by Rank_a.

    Only in b: the largest values; both 0: Enrichment 0 and the smallest log2.  Missing numbers are 0.
    """
    x = _suffixed(a, "a").join(_suffixed(b, "b"), "sequences", "full_outer" if keep_na else "inner")
    x = x.select("sequences", *[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) if t != "string" else F.col(c) for c, t in x.dtypes if c != "sequences"])
    ra, rb = F.col("RPU_a"), F.col("RPU_b")
    e = F.when(ra > 0, rb / ra)
    enrichment = F.when(ra > 0, rint_to(e, 3)).when(rb > 0, F.lit(MOST_ENRICHED)).otherwise(F.lit(0.0))
    log2e = F.when((ra > 0) & (rb > 0), rint_to(F.log2(e), 3)).when((ra <= 0) & (rb > 0), F.lit(MOST_LOG2)).otherwise(F.lit(-MOST_LOG2))
    return x.withColumns({"Enrichment": enrichment, "log2E": log2e}).orderBy("Rank_a", "sequences")


def enrich_stats(enriched: DataFrame) -> DataFrame:
    """One row of statistics of an enriched table; standard deviations are of a sample, values of no rows are 0.

    Medians are exact and found by selection (:mod:`.selection`), so no task holds a column's values.
    """
    enriched = stored(enriched.select("RPU_a", "RPU_b", "Enrichment", "log2E"), "enriched")
    middle = selection.medians(enriched, ["Enrichment", "log2E"])
    out = []
    for c, name in (("Enrichment", "enrichment"), ("log2E", "log2e")):
        for f, kind in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (lambda c: selection.literal(middle[c]), "median"), (F.stddev_samp, "std")):
            out.append(F.coalesce(f(c), F.lit(0.0)).alias(f"{name}_{kind}"))
    out += [F.count_if(F.col("RPU_b") == 0).alias("only_a"), F.count_if(F.col("RPU_a") == 0).alias("only_b"), F.count_if((F.col("RPU_a") > 0) & (F.col("RPU_b") > 0)).alias("in_both")]
    return enriched.agg(*out, F.count_if(F.col("Enrichment") > 10).alias("highly_enriched"), F.count_if(F.col("Enrichment") < 0.1).alias("highly_depleted"))


def led_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """(c1, c2, led): edit distance of every pair of seeds of two clustered populations.

    Seeds are one for each cluster; every pair is what is asked for.  Spark broadcasts the second seeds only if it finds them small.
    """
    seeds = [x.where("RankInCluster = 1").select(F.col("Cluster").alias(f"c{k}"), F.col("sequences").alias(f"s{k}")) for k, x in ((1, a), (2, b))]
    return seeds[0].crossJoin(seeds[1]).select("c1", "c2", F.levenshtein("s1", "s2").alias("led"))


def led_matrix_stats(matrix: DataFrame, threshold: int) -> DataFrame:
    """One row: min, max, mean, median, population deviation, and cells of at most ``threshold``.

    The matrix becomes a count of cells for each distance first, which holds all that is asked for.
    """
    led, n = F.col("led"), F.col("n")
    counted = matrix.where("led IS NOT NULL").groupBy("led").agg(F.count(F.lit(1)).alias("n"))  # a row for each distance
    few = F.coalesce(F.sum(F.when(led <= threshold, n)), F.lit(0))
    mean = F.sum(led * n) / F.sum(n)
    return counted.agg(F.min(led).alias("min"), F.max(led).alias("max"), mean.alias("mean"), F.expr("percentile(led, 0.5D, n)").alias("median"), F.sqrt(F.greatest(F.sum(led * led * n) / F.sum(n) - mean * mean, F.lit(0.0))).alias("std"), few.alias("below_count"), F.try_divide(few * 100.0, F.sum(n)).alias("below_percent"))


def merge_candidates(matrix: DataFrame, threshold: int = 7) -> DataFrame:
    """(c1, c2, led): the nearest second cluster of each first one, under ``threshold`` edits; ties take the lower id."""
    best = matrix.where(F.col("led") < threshold).groupBy("c1").agg(F.min(F.struct("led", "c2")).alias("_b"))
    return best.select("c1", F.col("_b.c2").alias("c2"), F.col("_b.led").alias("led"))


def nearest_clusters(a: DataFrame, b: DataFrame, threshold: int = 7) -> DataFrame:
    """What :func:`merge_candidates` gives for the seeds of two clustered populations, by a similarity join instead of their matrix."""
    if threshold <= 0:
        return merge_candidates(led_matrix(a, b), threshold)
    seeds = [x.where("RankInCluster = 1").select(F.col("Cluster").alias(i), F.col("sequences").alias(t)) for x, i, t in ((a, "i", "s"), (b, "j", "t"))]
    best = similar_pairs(*seeds, threshold - 1).groupBy("i").agg(F.min(F.struct("led", "j")).alias("_b"))
    return best.select(F.col("i").alias("c1"), F.col("_b.j").alias("c2"), F.col("_b.led").alias("led"))


def merge_clusters(a: DataFrame, b: DataFrame, candidates: DataFrame) -> DataFrame:
    """Both populations with common cluster ids and ``Population`` 1 or 2.

    A second cluster takes the id of the first one that claims it (of several the highest id); the others get
    the ids after the first population's largest, in their order.
    """
    top = a.agg(F.coalesce(F.max("Cluster"), F.lit(0)).alias("_top"))
    claimed = candidates.groupBy("c2").agg(F.max("c1").alias("_new"))
    free = b.select(F.col("Cluster").alias("c2")).distinct().join(claimed, "c2", "left_anti")
    # one row for each cluster without a partner: bounded by the number of clusters asked for
    fresh = free.crossJoin(F.broadcast(top)).select("c2", (F.col("_top") + F.row_number().over(Window.orderBy("c2"))).cast("int").alias("_new"))
    ids = claimed.select("c2", F.col("_new").cast("int").alias("_new")).unionByName(fresh)
    moved = b.join(ids, b["Cluster"] == ids["c2"]).withColumn("Cluster", F.col("_new")).drop("c2", "_new")
    return a.withColumn("Population", F.lit(1)).unionByName(moved.withColumn("Population", F.lit(2)))


def recluster_enrich(merged: DataFrame) -> DataFrame:
    """Full outer join of the populations on the sequence, with Cluster, Enrichment and log2E (null where not finite)."""
    drop = ("length", "RankInCluster", "LED", "Population")
    x = _suffixed(merged.where("Population = 1"), "a", drop).join(_suffixed(merged.where("Population = 2"), "b", drop), "sequences", "full_outer")
    e = F.try_divide(F.col("RPU_b").cast("double"), F.col("RPU_a").cast("double"))
    x = x.withColumns({"Cluster": F.coalesce("Cluster_a", "Cluster_b"), "Enrichment": rint_to(e, 3), "log2E": rint_to(F.log2(e), 3)})
    return x.drop("Cluster_a", "Cluster_b")


def recluster_rank(df: DataFrame) -> DataFrame:
    """With ``RankInCluster`` by Enrichment, largest first, nulls last, ties by sequence."""
    return numbered_within(df, "Cluster", [F.col("Enrichment").desc_nulls_last(), F.col("sequences").asc()], "RankInCluster")


def recluster_led(ranked: DataFrame) -> DataFrame:
    """With ``LED`` to the cluster's new first sequence, by Cluster and Enrichment."""
    seeds = ranked.where("RankInCluster = 1").select(F.col("Cluster").alias("_c"), F.col("sequences").alias("_s"))
    out = ranked.join(seeds, F.col("Cluster") == F.col("_c"), "left").withColumn("LED", F.levenshtein("sequences", "_s")).drop("_c", "_s")
    first = ["sequences", "Cluster", "RankInCluster", "LED"]
    return out.select(*first, *[c for c in out.columns if c not in first]).orderBy("Cluster", F.col("Enrichment").desc_nulls_last(), "sequences")


def recluster(a: DataFrame, b: DataFrame, threshold: int = 7) -> DataFrame:
    """Merge the clusters of two populations by their seeds and rank sequences by enrichment."""
    candidates = nearest_clusters(a, b, threshold)
    return recluster_led(stored(recluster_rank(recluster_enrich(merge_clusters(a, b, candidates))), "recluster"))
