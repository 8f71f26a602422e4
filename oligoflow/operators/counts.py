"""Counting reads: unique sequences, ranks, abundances, merged populations, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..storage import numbered

#: Upper bounds of the abundance bins (fixed defaults).
BREAKS = (10, 100, 1000)


def count_unique(reads: DataFrame, *by: str) -> DataFrame:
    """(sequences, Reads): copies of each sequence, carriage returns removed; null sequences are left out.  With columns ``by``, for each of their values."""
    return reads.select(*by, sq.strip_cr(F.col("sequences")).alias("sequences")).where("sequences IS NOT NULL").groupBy(*by, "sequences").agg(F.count(F.lit(1)).alias("Reads"))


def count_rank(counts: DataFrame) -> DataFrame:
    """With ``Rank`` 1..n by Reads, largest first; ties by sequence."""
    return numbered(counts, [F.col("Reads").desc(), F.col("sequences").asc()], "Rank")


def count_rpu(counts: DataFrame, scaling: float = 1e6) -> DataFrame:
    """With ``RPU``: reads per ``scaling`` reads, rounded half to even."""
    total = counts.agg(F.sum("Reads").cast("double").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("RPU", F.rint(F.col("Reads") / (F.col("_total") / scaling)).cast("long")).drop("_total")  # one row


def finished(counts: DataFrame, scaling: float = 1e6) -> DataFrame:
    """The counts table (ID, Rank, Reads, RPU, length, sequences) of (sequences, Reads)."""
    out = count_rpu(count_rank(counts), scaling)
    return out.select(sq.compose_id("Rank", "Reads", "RPU").alias("ID"), "Rank", "Reads", "RPU", F.length("sequences").alias("length"), "sequences")


def count(reads: DataFrame, scaling: float = 1e6, reverse_complement: bool = False) -> DataFrame:
    """The counts table of a population of reads."""
    out = finished(count_unique(reads), scaling)
    return out.withColumn("sequences", sq.reverse_complement(F.col("sequences"))) if reverse_complement else out


def recount(*populations: DataFrame, scaling: float = 1e6) -> DataFrame:
    """The counts table of several counted populations together: one union and one aggregate for any number of them."""
    both = reduce(DataFrame.unionByName, [p.select("sequences", "Reads") for p in populations])
    return finished(both.groupBy("sequences").agg(F.sum("Reads").alias("Reads")), scaling)


def population_totals(counts: DataFrame) -> DataFrame:
    """One row: unique sequences and reads."""
    return counts.agg(F.count(F.lit(1)).alias("unique_sequences"), F.coalesce(F.sum("Reads"), F.lit(0)).alias("total_reads"))


def reads_per_rank(counts: DataFrame, min_reads: int = 10, max_rank: int = 1000) -> DataFrame:
    """(Rank, Reads) of the first ranks with enough reads, by rank."""
    return counts.where((F.col("Reads") >= min_reads) & (F.col("Rank") <= max_rank)).select("Rank", "Reads").orderBy("Rank")


def length_histogram(counts: DataFrame) -> DataFrame:
    """(length, unique_count, total_reads)."""
    return counts.groupBy(F.length("sequences").alias("length")).agg(F.count(F.lit(1)).alias("unique_count"), F.sum("Reads").alias("total_reads"))


def abundance_bins(counts: DataFrame, breaks: tuple[int, ...] = BREAKS, singleton: bool = True) -> DataFrame:
    """(bin, fraction, unique_count): share of reads and unique sequences by abundance; empty bins are left out."""
    breaks = tuple(sorted(breaks))
    label = F.when(F.col("Reads") == 1, F.lit("Singleton")) if singleton else F.when(F.lit(False), F.lit(""))
    for lo, hi in zip((None, *breaks), breaks, strict=False):
        label = label.when(F.col("Reads") < hi, F.lit(f"1 < Reads < {hi}" if lo is None else f"{lo} ≤ Reads < {hi}"))
    label = label.otherwise(F.lit(f"{breaks[-1]} ≤ Reads"))
    bins = counts.groupBy(label.alias("bin")).agg(F.sum("Reads").alias("reads"), F.count(F.lit(1)).alias("unique_count"))
    return bins.select("bin", (F.col("reads") / F.sum("reads").over(Window.partitionBy(F.lit(0)))).alias("fraction"), "unique_count")
