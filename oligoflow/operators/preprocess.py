"""Row operators on reads (sequences, quality): trimming, filters, report.

Constant regions are matched bit-parallel over Arrow batches (:mod:`..functions.matching`); only sequences and qualities go there,
the other columns stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import matching as m
from ..functions import sequences as sq


def _errors(const: str, error_rate: float) -> int:
    return int(len(const) * error_rate)


def _udf(f: Callable[..., pa.Array], kind: str):
    """A vectorised function that the optimizer neither copies nor moves (a copy would match every read again)."""
    return F.arrow_udf(f, kind).asNondeterministic()


def _ends(const5p: str, const3p: str, error_rate: float, ends: str) -> Callable[[m.Reads], tuple[np.ndarray, np.ndarray]]:
    """How many characters are cut at either end of reads: the 3' end is sought in what the 5' cut leaves, or, of the best end only, in the whole read."""

    def cuts(reads: m.Reads) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(len(reads.length), np.int64)
        left = m.prefix_cuts(reads, const5p, _errors(const5p, error_rate)) if const5p else none
        right = m.suffix_cuts(reads, const3p, _errors(const3p, error_rate), left if ends == "both" else 0) if const3p else none
        return (left, right) if ends == "both" else (np.where(left >= right, left, 0), np.where(left >= right, 0, right))

    return cuts


def _trimmed(df: DataFrame, const5p: str, const3p: str, error_rate: float, ends: str = "both") -> DataFrame:
    """``df`` without the constant regions; the quality, if there is one, goes with the sequence and ``_error`` is the mean error of what is left."""
    cuts, rated = _ends(const5p, const3p, error_rate, ends), "quality" in df.columns

    def run(sequences: pa.Array, quality: pa.Array) -> pa.Array:
        reads = m.Reads(sequences)
        left, right = cuts(reads)
        error = None
        if rated:
            marks = m.Reads(quality)
            have = np.clip(np.minimum(marks.length, reads.length - right) - left, 0, None)
            error = pa.array(m.mean_errors(marks, np.minimum(left, marks.length), have), from_pandas=True)
        return pa.StructArray.from_arrays([pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), error if rated else pa.nulls(len(left), pa.float64())], ["left", "right", "error"])

    found = _udf(run, "struct<left:int,right:int,error:double>")(F.col("sequences"), F.col("quality") if rated else F.lit(""))
    df = df.withColumn("_ends", found)
    keep = F.greatest(F.length("sequences") - F.col("_ends.left") - F.col("_ends.right"), F.lit(0))
    out = {c: F.substring(F.col(c), F.col("_ends.left") + 1, keep) for c in ("sequences", "quality") if c in df.columns}
    return df.withColumns(out | {"_error": F.col("_ends.error")}).drop("_ends")


def trim_5p(df: DataFrame, const5p: str, error_rate: float = 0.1) -> DataFrame:
    """Cut an anchored 5' constant region, with up to floor(error_rate * length) edits; other reads stay as they are, null ones null."""
    return _trimmed(df, const5p, "", error_rate).drop("_error")


def trim_3p(df: DataFrame, const3p: str, error_rate: float = 0.1) -> DataFrame:
    """Cut an anchored 3' constant region."""
    return _trimmed(df, "", const3p, error_rate).drop("_error")


def length_filter(df: DataFrame, least: int = 10, most: int = 100) -> DataFrame:
    """Reads whose length is within [least, most]."""
    return df.where(F.length("sequences").between(least, most))


def quality_filter(df: DataFrame, max_error: float = 0.005) -> DataFrame:
    """Reads whose mean error probability is at most ``max_error``; reads without quality symbols fail."""
    return df.where(sq.mean_error(F.col("quality")) <= max_error)


def excise_region(df: DataFrame, region: str, error_rate: float = 0.1) -> DataFrame:
    """Cut the first interior match of ``region`` (up to floor(error_rate * length) + 1 edits) and join the flanks; the quality goes with the sequence."""
    if not region:
        return df
    errors = _errors(region, error_rate) + 1

    def run(sequences: pa.Array) -> pa.Array:
        start, length = m.interior(m.Reads(sequences), region, errors)
        return pa.StructArray.from_arrays([pa.array(start.astype(np.int32) + 1), pa.array(length.astype(np.int32))], ["s", "k"])

    df = df.withColumn("_hit", _udf(run, "struct<s:int,k:int>")(F.col("sequences")))
    start, end = F.col("_hit.s"), F.col("_hit.s") + F.col("_hit.k")
    out = {c: F.when(start == 0, F.col(c)).otherwise(F.concat(F.substring(F.col(c), F.lit(1), start - 1), F.substring(F.col(c), end, F.length(c)))) for c in ("sequences", "quality") if c in df.columns}
    return df.withColumns(out).drop("_hit")


def _judged(df: DataFrame, const5p: str, const3p: str, least: int, most: int, max_error: float, error_rate: float, ends: str) -> DataFrame:
    """Trimmed reads with ``_fits`` (the length) and ``_good`` (the length and the quality)."""
    cut = _trimmed(df, const5p, const3p, error_rate, ends)
    fits = F.coalesce(F.length("sequences").between(least, most), F.lit(False))
    return cut.withColumns({"_fits": fits, "_good": fits & F.coalesce(F.col("_error") <= max_error, F.lit(False))}).drop("_error")


def preprocess(df: DataFrame, const5p: str = "", const3p: str = "", least: int = 10, most: int = 100, max_error: float = 0.005, error_rate: float = 0.1, ends: str = "both") -> DataFrame:
    """Trim both ends, then filter by length and quality.  ``ends='best'`` trims only the end that matches better (5' on a tie).

    Both ends and the quality of what is left are found in one pass over Arrow batches.
    """
    return _judged(df, const5p, const3p, least, most, max_error, error_rate, ends).where("_good").drop("_fits", "_good")


def _counted() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_reads"), F.count_if("_fits").alias("length_passed"), F.count_if("_good").alias("passed")]


def _rated(counts: DataFrame) -> DataFrame:
    return counts.withColumn("pass_rate", F.coalesce(sq.rint_to(F.try_divide(F.col("passed") * 100.0, F.col("total_reads")), 2), F.lit(0.0)))


def preprocess_report(df: DataFrame, const5p: str = "", const3p: str = "", least: int = 10, most: int = 100, max_error: float = 0.005, error_rate: float = 0.1) -> DataFrame:
    """One row: reads before, after the length and after the quality filter, and the share that passes in percent."""
    return _rated(_judged(df, const5p, const3p, least, most, max_error, error_rate, "both").agg(*_counted()))


def preprocess_observed(df: DataFrame, const5p: str = "", const3p: str = "", least: int = 10, most: int = 100, max_error: float = 0.005, error_rate: float = 0.1, ends: str = "both") -> tuple[DataFrame, Observation]:
    """What :func:`preprocess` gives, and the counts of :func:`preprocess_report`, gathered by the job that computes it.

    Write the DataFrame once; then ``report_of`` makes the report's row of the observation.
    """
    seen = Observation()
    judged = _judged(df, const5p, const3p, least, most, max_error, error_rate, ends).observe(seen, *_counted())
    return judged.where("_good").drop("_fits", "_good"), seen


def report_of(spark: SparkSession, seen: Observation) -> DataFrame:
    """The report of a finished job; waits for it."""
    found = seen.get
    return _rated(spark.createDataFrame([(found["total_reads"], found["length_passed"], found["passed"])], "total_reads long, length_passed long, passed long"))
