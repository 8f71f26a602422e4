"""FASTA, FASTQ and CSV files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import strip_cr
from ..storage import numbered, stored
from .bgzf import read_text
from .fastq import read_fastq

__all__ = ["read_counts_csv", "read_fasta", "read_fastq", "read_sequences", "write_csv", "write_fasta", "write_fastq", "write_profile"]

#: Header keys and their types; other keys are ignored.
KEYS = {"Rank": "long", "Reads": "long", "RPU": "double", "Cluster": "int", "RankInCluster": "int", "LED": "int"}


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files (a .gz is read by one task unless it is block-compressed): ID, the typed ``key=value`` pairs of the header (keys in any case), length, sequences.

    Missing keys: Rank is the place in file order, Reads and RPU are 0, the others null.  Lines of a record
    are joined and white space is removed.  Records without a header are left out.
    """
    raw = read_text(spark, path, "\n>").select(F.regexp_replace("value", "^>", "").alias("r"), F.col("path").alias("_f"), F.col("start").alias("_b"))
    head = F.trim(strip_cr(F.substring_index("r", "\n", 1)))
    body = F.regexp_replace(F.substring(F.col("r"), F.length(F.substring_index("r", "\n", 1)) + 1, F.length("r")), r"\s", "")
    keyed = raw.withColumns({"ID": head, "sequences": body}).where("ID <> '' OR sequences <> ''").drop("r").withColumn("_m", F.monotonically_increasing_id())
    value = lambda k: F.nullif(F.regexp_extract("ID", f"(?i)(?:^|;){k}=([^;]*)", 1), F.lit(""))
    keys = {k: value(k).try_cast(t) for k, t in KEYS.items()}
    out = keyed.withColumns(keys)
    if out.where("Rank IS NULL").limit(1).count():
        out = _in_file_order(stored(keyed, "records")).withColumns(keys).withColumn("Rank", F.coalesce("Rank", "_n"))
    out = out.withColumns({"Reads": F.coalesce("Reads", F.lit(0).cast("long")), "RPU": F.coalesce("RPU", F.lit(0.0)), "length": F.length("sequences")})
    return out.select("ID", *KEYS, "length", "sequences")


def _in_file_order(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` (_f, _b, _m) with their number ``_n`` from 1 in order of file, block and mark, without sorting them.

    A task reads a block from its beginning to its end, so marks are dense in a block; only blocks, a row for each, are put in order.
    """
    blocks = rows.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_f", "_b", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(F.broadcast(blocks), ["_f", "_b"]).withColumn("_n", F.col("_m") + F.col("_shift"))


def read_counts_csv(spark: SparkSession, path: str) -> DataFrame:
    """A counts table of CSV files: headers in any case, missing Rank, Reads and RPU as in :func:`read_fasta`."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    have = {c.lower(): c for c in raw.columns}
    types = {"ID": "string", **KEYS, "length": "int", "sequences": "string"}
    out = raw.select(*[(F.col(f"`{have[k.lower()]}`").try_cast(t) if k.lower() in have else F.lit(None).cast(t)).alias(k) for k, t in types.items()])
    if "rank" not in have:
        out = numbered(out.withColumn("_m", F.monotonically_increasing_id()), [F.col("_m")], "_n").withColumn("Rank", F.col("_n"))
    out = out.withColumns({"Reads": F.coalesce("Reads", F.lit(0).cast("long")), "RPU": F.coalesce("RPU", F.lit(0.0)), "length": F.coalesce("length", F.length("sequences"))})
    return out.select(*types)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Reader by extension (.fa .fasta .fq .fastq with or without .gz, .csv); ValueError for others and for empty input."""
    name = path.lower().rstrip("/").removesuffix(".gz").removesuffix(".bgz")
    if name.endswith((".fa", ".fasta")):
        out = read_fasta(spark, path)
    elif name.endswith((".fq", ".fastq")):
        out = read_fastq(spark, path)
    elif name.endswith(".csv"):
        out = read_counts_csv(spark, path)
    else:
        raise ValueError(f"unknown format: {path}")
    if out.isEmpty():
        raise ValueError(f"no records in {path}")
    return out


def write_fasta(df: DataFrame, path: str, id_col: str = "ID") -> None:
    """FASTA files: a header with the ID and one sequence line."""
    df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col("sequences"))).write.text(path)


def write_fastq(df: DataFrame, path: str, id_col: str = "id") -> None:
    """FASTQ files of (id, sequences, quality)."""
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col(id_col)), "sequences", F.lit("+"), "quality")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header."""
    df.write.option("header", True).csv(path)


def write_profile(emissions: DataFrame, transitions: DataFrame, path: str) -> None:
    """A profile as two JSON tables."""
    emissions.write.json(f"{path}/emissions")
    transitions.write.json(f"{path}/transitions")
