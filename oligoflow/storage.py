"""The cluster's shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_JOBS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  If it is unset, a new one on a local master (tests), ValueError on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="oligoflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has; inside :func:`job`, in the job's folder."""
    return f"{_JOBS[-1] if _JOBS else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def job(spark: SparkSession) -> Iterator[str]:
    """A scope whose intermediate tables are deleted at its end; write results elsewhere before it ends.

    Outside of one they stay, since a DataFrame that is still to be computed may read them.
    """
    folder = f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"
    _JOBS.append(folder)
    try:
        yield folder
    finally:
        _JOBS.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with a dense number 1..n by ``order`` as a BIGINT column, without a window over all rows.

    Rows are range-partitioned and sorted, each partition numbers its own (the low bits of
    monotonically_increasing_id), and the partitions' sizes, one row for each, shift the numbers.
    """
    n = partitions(df.sparkSession)
    mark = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.select("*", F.shiftright(mark, 33).alias("_part"), mark.bitwiseAND(2**33 - 1).alias("_row")), "numbered")
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for part, size in sizes:
        offsets.append((part, before))
        before += size
    offsets = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")  # a row for each partition


def numbered_within(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """``df`` with a dense INT number 1..n by ``order`` within each ``group``; a huge group never meets in one task."""
    out = numbered(df, [F.col(group).asc_nulls_first(), *order], "_n")  # reads a stored table
    first = out.groupBy(F.col(group).alias("_g")).agg(F.min("_n").alias("_first"))
    return out.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, (F.col("_n") - F.col("_first") + 1).cast("int")).drop("_n", "_first", "_g")
