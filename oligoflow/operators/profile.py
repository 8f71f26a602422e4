"""Profile models of alignments: match columns, emissions, transitions."""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .align import require_aligned, residue_positions

#: Emission alphabet, and pseudo-counts: added to a count, added to the total (fixed values).
ALPHABET = "acgtn"
PSEUDOCOUNTS = {"laplace": (1.0, 5.0), "background": (0.25, 1.0), "none": (0.0, 0.0)}
GAP_SHARE = 0.5


def _counted(df: DataFrame) -> DataFrame:
    """(sequences, n): distinct sequences and their copies, so that a copy is not split into residues again."""
    return df.groupBy("sequences").agg(F.count(F.lit(1)).alias("n"))


def _columns(counted: DataFrame) -> DataFrame:
    """One row for each alignment column of (sequences, n): symbols, gaps, and counts of the alphabet."""
    c = F.lower("Residue")
    of = lambda x: F.coalesce(F.sum(F.when(c == x, F.col("n"))), F.lit(0))
    return residue_positions(counted).groupBy("Position").agg(F.sum("n").alias("all"), of("-").alias("gaps"), *[of(x).alias(x) for x in ALPHABET])


def _match(columns: DataFrame) -> list[int]:
    return sorted(r["Position"] for r in columns.where(F.col("gaps") / F.col("all") < GAP_SHARE).select("Position").collect())


def match_columns(df: DataFrame) -> list[int]:
    """Positions (from 1) where gaps are under half; bounded by the alignment's length."""
    return _match(_columns(_counted(df)))


def profile_emissions(df: DataFrame, method: str = "laplace") -> DataFrame:
    """(match_state, col, residue, p, p_normalized): emissions of each match column; states and columns count from 1.

    Characters outside the alphabet stay in the total, so p need not add up to 1; p_normalized does.
    """
    return _emissions(_columns(_counted(df)), method)


def _emissions(columns: DataFrame, method: str) -> DataFrame:
    if method not in PSEUDOCOUNTS:
        raise ValueError(f"unknown pseudocount method {method!r}")
    one, total = PSEUDOCOUNTS[method]
    match = columns.where(F.col("gaps") / F.col("all") < GAP_SHARE)
    match = match.withColumn("match_state", F.row_number().over(Window.orderBy("Position")))  # a row for each column
    pairs = ", ".join(f"'{x}', {x}" for x in ALPHABET)
    long = match.selectExpr("match_state", "Position AS col", "all - gaps AS present", f"stack({len(ALPHABET)}, {pairs}) AS (residue, n)")
    p = F.coalesce(F.try_divide(F.col("n") + one, F.col("present") + total), F.lit(1.0 / len(ALPHABET)))
    long = long.withColumn("p", p)
    return long.select("match_state", "col", "residue", "p", F.try_divide(F.col("p"), F.sum("p").over(Window.partitionBy("match_state"))).alias("p_normalized"))


def profile_transitions(df: DataFrame) -> DataFrame:
    """One row (mm, md, mi): shares of match to match, to delete and to insert steps; .9, .05, .05 without any."""
    counted = stored(_counted(df), "counted")
    return _transitions(counted, _match(_columns(counted)))


def _transitions(counted: DataFrame, cols: list[int]) -> DataFrame:
    steps = [(a, b) for a, b in zip(cols, cols[1:], strict=False)]
    if not steps:
        return counted.sparkSession.range(1).select(F.lit(0.9).alias("mm"), F.lit(0.05).alias("md"), F.lit(0.05).alias("mi"))
    here = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])
    at = lambda k: F.substring("sequences", k, F.lit(1)) != "-"
    n = lambda test: F.sum(F.size(F.filter(here, test)) * F.col("n"))
    inner = lambda s: F.length(F.replace(F.substring("sequences", s["a"] + 1, s["b"] - s["a"] - 1), F.lit("-"), F.lit(""))) > 0
    counts = counted.agg(n(lambda s: at(s["a"]) & at(s["b"])).alias("x"), n(lambda s: at(s["a"]) & ~at(s["b"])).alias("y"), n(lambda s: at(s["a"]) & (s["b"] - s["a"] > 1) & inner(s)).alias("z"))
    total = F.coalesce(F.col("x") + F.col("y") + F.col("z"), F.lit(0))
    share = lambda c, default: F.when(total == 0, F.lit(default)).otherwise(F.try_divide(F.col(c).cast("double"), total))
    return counts.select(share("x", 0.9).alias("mm"), share("y", 0.05).alias("md"), share("z", 0.05).alias("mi"))


def profile_stats(df: DataFrame) -> DataFrame:
    """One row: sequences, alignment length, match states."""
    return _stats(_columns(_counted(df)))


def _stats(columns: DataFrame) -> DataFrame:
    states = columns.agg(F.max("all").alias("num_sequences"), F.count(F.lit(1)).alias("alignment_length"), F.count_if(F.col("gaps") / F.col("all") < GAP_SHARE).alias("num_match_states"))
    return states.select(F.coalesce("num_sequences", F.lit(0)).alias("num_sequences"), "alignment_length", "num_match_states")


class _HasMethod(Params):
    """How pseudo-counts are added: laplace, background or none."""

    method = Param(Params._dummy(), "method", "laplace, background or none", TypeConverters.toString)


class Profile(Estimator, _HasMethod, DefaultParamsReadable, DefaultParamsWritable):
    """Estimates a profile of aligned ``sequences``; null ones don't count, and those of several lengths are refused."""

    def __init__(self, method: str = "laplace") -> None:
        super().__init__()
        self._setDefault(method="laplace")
        self._set(method=method)

    def _fit(self, dataset: DataFrame) -> ProfileModel:
        counted = require_aligned(stored(_counted(dataset.where("sequences IS NOT NULL")), "counted"))  # the only pass over all rows
        columns = stored(_columns(counted), "columns")
        tables = (_emissions(columns, self.getOrDefault("method")), _transitions(counted, _match(columns)), _stats(columns))
        return self._copyValues(ProfileModel(*[stored(t, "profile") for t in tables]))


class ProfileModel(Model, _HasMethod, MLReadable, MLWritable):
    """A fitted profile: the tables ``emissions``, ``transitions`` and ``stats``.

    ``transform`` adds ``log_likelihood`` to aligned sequences: the sum of ln p (of 0: minus infinity) over match columns with a residue of the alphabet;
    null for null sequences and for those without such a residue.
    """

    def __init__(self, emissions: DataFrame | None = None, transitions: DataFrame | None = None, stats: DataFrame | None = None) -> None:
        super().__init__()
        self._setDefault(method="laplace")
        self.emissions, self.transitions, self.stats = emissions, transitions, stats

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # a number for each match column and residue: bounded by the alignment's length
        logs = {(r["col"], r["residue"]): math.log(r["p"]) if r["p"] > 0 else -math.inf for r in self.emissions.select("col", "residue", "p").collect()}
        columns = sorted({c for c, _ in logs})
        if not columns:
            return dataset.withColumn("log_likelihood", F.lit(None).cast("double"))
        table = F.array(*[F.struct(F.lit(c).alias("col"), *[F.lit(logs.get((c, x))).cast("double").alias(x) for x in ALPHABET]) for c in columns])

        def at(e):
            residue = F.lower(F.substring("sequences", e["col"], F.lit(1)))
            return F.coalesce(*[F.when(residue == x, e[x]) for x in ALPHABET])

        seen = F.filter(F.transform(table, at), lambda x: x.isNotNull())
        return dataset.withColumn("log_likelihood", F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, x: a + x)))

    def write(self) -> MLWriter:
        return _ProfileWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ProfileReader(cls)


class _ProfileWriter(MLWriter):
    """A folder with the parameters and a Parquet table for each of the model's."""

    def __init__(self, model: ProfileModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for name in ("emissions", "transitions", "stats"):
            getattr(self.model, name).write.parquet(f"{path}/{name}")


class _ProfileReader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ProfileModel:
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = ProfileModel(*[spark.read.parquet(f"{path}/{name}") for name in ("emissions", "transitions", "stats")])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
