"""Looking at tables: search, column filters, pages, cluster lists, top rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequences as sq
from ..storage import new_path, partitions


def search_any(df: DataFrame, text: str) -> DataFrame:
    """Rows with ``text`` in any column, whatever its case."""
    return df.where(sq.any_of([sq.contains_text(F.col(f"`{c}`"), text) for c in df.columns])) if text else df


def search_columns(df: DataFrame, contains: Mapping[str, str] | None = None, exact: Mapping[str, object] | None = None) -> DataFrame:
    """Rows that match every column filter."""
    tests = [sq.contains_text(F.col(f"`{c}`"), t) for c, t in (contains or {}).items()]
    tests += [F.col(f"`{c}`").cast("string") == F.lit(str(v)) for c, v in (exact or {}).items()]
    return df.where(sq.all_of(tests))


def page(df: DataFrame, order: list, number: int = 1, size: int = 10) -> DataFrame:
    """Rows of page ``number`` (from 1) by ``order``, with ``total_pages`` of the whole table."""
    pages = df.agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("long").alias("total_pages"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(pages))  # one row


class Pages:
    """A table sorted once for many pages: ranges of rows in folders of their own, and the number of rows of each, so any page reads the few ranges it lies in.

    Rows that tie in ``order`` may stand in any order, but in the same for all pages.  The table stays in the shared folder (see :mod:`..storage`).
    """

    def __init__(self, df: DataFrame, order: list) -> None:
        spark, path = df.sparkSession, new_path(df.sparkSession, "pages")
        n = partitions(spark)
        mark = F.monotonically_increasing_id()
        ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        ranged.select("*", F.shiftright(mark, 33).alias("_part"), mark.bitwiseAND(2**33 - 1).alias("_row")).write.partitionBy("_part").parquet(path)
        self.columns = df.columns
        self.ranges: list[tuple[int, int, int]] = []  # number, rows before, rows
        schema = T.StructType([*df.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_part", T.LongType())])
        self.rows = spark.read.schema(schema).parquet(path)
        before = 0
        for part, size in sorted((r["_part"], r["n"]) for r in self.rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each range
            self.ranges.append((part, before, size))
            before += size
        self.total = before

    def page(self, number: int, size: int = 10) -> DataFrame:
        """Rows of page ``number`` (from 1) in order, with ``total_pages``; none beyond the last."""
        low, high = (number - 1) * size, number * size
        pages = F.lit(-(-self.total // size)).cast("long").alias("total_pages")
        inside = [(p, b) for p, b, n in self.ranges if b < high and b + n > low]
        at = F.coalesce(*[F.when(F.col("_part") == p, F.col("_row") + b) for p, b in inside], F.lit(-1).cast("long"))
        found = self.rows.where(F.col("_part").isin([p for p, _ in inside]) if inside else F.lit(False)).withColumn("_at", at)
        return found.where((F.col("_at") >= low) & (F.col("_at") < high)).orderBy("_at").select(*[F.col(f"`{c}`") for c in self.columns], pages)


def cluster_list(clustered: DataFrame) -> DataFrame:
    """Distinct clusters in order; rows without one don't count."""
    return clustered.where("Cluster IS NOT NULL").select("Cluster").distinct().orderBy("Cluster")


def cluster_filter(clustered: DataFrame, clusters: list[int]) -> DataFrame:
    """Rows of these clusters."""
    return clustered.where(F.col("Cluster").isin(clusters))


def top_enriched(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of largest Enrichment, nulls last, ties by sequence."""
    return df.orderBy(F.col("Enrichment").desc_nulls_last(), "sequences").limit(n)
