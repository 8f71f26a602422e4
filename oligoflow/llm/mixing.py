"""Mixing sources to target weights by Poisson replication (operator 9).

A source with target share w of the mixture and share s of the documents repeats each document w/s
times on average.  Each document draws its count from a Poisson distribution with that mean by
inverting the distribution function at a uniform number hashed from (seed, document), is exploded by
the count, and all copies are put in one global random order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored

#: Sources with at least this part (one of so many) of all documents are broadcast.
LARGE_SOURCES = 10_000
#: Copies of a document are made in runs of so many, since a run is an array in memory.
RUN = 1 << 12


def hashed_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 random bits, the same for the same parts on every engine with md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def poisson_start(rate: float) -> int:
    """The count at which the thresholds of :func:`poisson_steps` begin: 0 up to a rate of 1600, and beyond it one that
    is undershot with a chance below 1e-300."""
    return max(0, math.floor(rate - 40 * math.sqrt(rate)))


def poisson_steps(rate: float) -> list[float]:
    """P(count <= k) for k = start, start + 1, ... as far as a 52-bit uniform number can tell apart from 1.

    Terms are taken relative to the largest one, so any rate needs O(sqrt(rate)) of them and none overflows.
    """
    if rate <= 0:
        return [1.0]
    top = math.floor(rate)
    below, above, term = [], [1.0], 1.0
    for k in range(top, poisson_start(rate), -1):
        term *= k / rate
        below.append(term)
    term, k = 1.0, top
    while term > 2.0**-80:
        k += 1
        term *= rate / k
        above.append(term)
    terms = below[::-1] + above
    whole, total, out = math.fsum(terms), 0.0, []
    for k, term in enumerate(terms, poisson_start(rate)):
        total += term
        if k >= rate and 1.0 - total / whole < 2.0**-53:
            break
        out.append(min(total / whole, 1.0))
    return [*out, 1.0]


def repetition_rates(docs: DataFrame, weights: Mapping[str | None, float], default_weight: float, source_col: str) -> DataFrame:
    """(source, n, rate, start, steps) of each source: its documents, mean repetitions, and the thresholds of :func:`poisson_steps`.

    The expected total is the number of documents.  One aggregate over ``docs``; nothing of it comes to the driver.
    """
    if any(w < 0 for w in (default_weight, *weights.values())):
        raise ValueError("weights must not be negative")

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [float(weights.get(s, default_weight)) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.float64())], ["source", "n", "weight"])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, n, weight, whole, of_weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rate = weight / of_weights * whole / n if of_weights else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([n]), pa.array([rate]), pa.array([poisson_start(rate)], pa.int64()), pa.array([poisson_steps(rate)])], ["source", "n", "rate", "start", "steps"])

    counts = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.mapInArrow(weighted, "source string, n long, weight double"), "sources")
    total = counts.agg(F.sum("n").alias("whole"), F.sum("weight").alias("of_weights"))
    return stored(counts.crossJoin(F.broadcast(total)).mapInArrow(stepped, "source string, n long, rate double, start long, steps array<double>"), "rates")  # one row


def mix_sources(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, default_weight: float = 1.0, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy_no", key_col: str = "shuffle_key",
) -> DataFrame:
    """``docs`` replicated to the target ``weights`` and globally shuffled.

    ``weights`` maps a source to its relative weight; a source that is missing there has
    ``default_weight`` (so without weights all sources get equal shares).  Null is a source of its own.
    Adds ``copy_no`` (0, 1, ...) and ``shuffle_key`` and orders by the latter; columns of ``docs`` with
    these names are replaced.  Rows that repeat an id draw the same count; rows with a null id draw one
    count together.  Texts are never looked at, so null, empty and long ones are alike.  An empty table
    stays empty.  A source may be as rare as one row of any number; its documents then repeat that often
    (``copy_no`` is an int).  Sources may be any number: those with 1 / LARGE_SOURCES of the documents or more, so
    LARGE_SOURCES at most, are broadcast with their thresholds; only documents of the others are joined with theirs by
    source.  So no source fills a task: counts are drawn row by row and the order is by a hash.
    """
    rates = repetition_rates(docs, weights or {}, default_weight, source_col)
    source, u = F.col(f"`{source_col}`").cast("string"), hashed_uniform(str(seed), F.col(f"`{id_col}`"))
    names, name = docs.drop(copy_col, key_col).columns, "_rate"
    while name in docs.columns:
        name += "_"
    total = rates.agg(F.sum("n").alias("_total"))
    rates = rates.crossJoin(F.broadcast(total)).select(F.struct("source", "start", "steps").alias(name), (F.col("n") * LARGE_SOURCES >= F.col("_total")).alias("_large"))
    large, small = rates.where("_large").select(name), rates.where("NOT _large").select(name)
    same = source.eqNullSafe(F.col(f"{name}.source"))
    drawn = docs.drop(copy_col, key_col).join(F.broadcast(large), same, "left")  # LARGE_SOURCES rows at most
    if not small.isEmpty():
        rest = drawn.where(F.col(name).isNull()).select(names).join(small.hint("merge"), same)
        drawn = drawn.where(F.col(name).isNotNull()).unionByName(rest)
    copies = (F.size(F.filter(F.col(f"{name}.steps"), lambda x: x <= u)) + F.col(f"{name}.start")).cast("int")
    out = drawn.withColumn(copy_col, copies).drop(name)
    last, none = F.col(copy_col) - 1, F.array().cast("array<int>")
    out = out.withColumn(key_col, F.explode(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(RUN))).otherwise(none)))  # first copy of each run
    out = out.withColumn(copy_col, F.explode(F.sequence(F.col(key_col), F.least(last, F.col(key_col) + (RUN - 1)))))
    return out.withColumn(key_col, hashed_uniform(str(seed), "order", F.col(f"`{id_col}`"), F.col(copy_col))).orderBy(key_col, id_col, copy_col)
