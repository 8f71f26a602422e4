"""Small shared helpers: tables, the cluster's shared folder, partition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oligoflow.storage import partitions, shared_dir, stored

__all__ = ["partitions", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
