"""Token counts by an exact length histogram (operator 3).

Every document is encoded once; documents are aggregated by encoded length, and suffix sums over the
histogram answer totals, quantiles and truncated totals for every context limit without the texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as hs

#: Vocabulary of byte pairs and ranks, and the pattern that cuts texts into pieces (fixed values of that tokenizer).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths per block of the two-level suffix sums.
BLOCK = 1024


@lru_cache(2)
def encoder(ranks: bytes, pattern: str):
    """The tokenizer of a vocabulary file's content."""
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): partial histograms of the encoded lengths, one for each slice of ``docs``.

    The vocabulary file is read on the driver and broadcast (under 1 MB).  Null and empty texts have length 0.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value, pattern)
        for piece in hs.pieces(batches, text_col):
            lengths = [len(e.encode_ordinary(x)) if x else 0 for x in piece.column(0).to_pylist()]
            n, count = np.unique(np.array(lengths, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(count)], ["n_tokens", "n_docs"])

    return docs.select(F.col(f"`{text_col}`").alias(text_col)).mapInArrow(run, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs) of every length that occurs; no documents, no rows."""
    return token_counts(docs, vocabulary, pattern, text_col).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with its suffix sums, so that each row answers for the context limit ``n_tokens``.

    docs_over and tokens_over: documents longer than the limit and their tokens; docs_within and
    tokens_within: the others; truncated_tokens: the total if each document is cut at the limit;
    share_within: share of documents that fit (the limit is the quantile of that share).
    Sums run in two levels, blocks of lengths and lengths in a block, so no task holds all lengths.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), zero).alias("d_after"), F.coalesce(F.sum("t").over(later), zero).alias("t_after"))
    total = h.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    blocks = blocks.crossJoin(F.broadcast(total))  # one row
    longer = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = h.join(blocks, "block").withColumn("docs_over", F.coalesce(F.sum("n_docs").over(longer), zero) + F.col("d_after")).withColumn("tokens_over", F.coalesce(F.sum("tokens").over(longer), zero) + F.col("t_after"))
    within, tokens = F.col("all_docs") - F.col("docs_over"), F.col("all_tokens") - F.col("tokens_over")
    return x.select("n_tokens", "n_docs", "docs_over", "tokens_over", within.alias("docs_within"), tokens.alias("tokens_within"), (tokens + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"), (within / F.col("all_docs")).alias("share_within"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: documents, tokens, tokens if each document is cut at any ``limit``, and documents that are cut."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0).cast("long")).alias(name)
    return histogram.agg(total(d, "docs"), total(n * d, "tokens"), total(F.least(n, F.lit(limit)) * d, "truncated_tokens"), total(F.when(n > limit, d).otherwise(0), "docs_cut"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least ``share`` of the documents do not exceed (null without documents)."""
    return sums.where(F.col("share_within") >= share).agg(F.min("n_tokens").alias("n_tokens"))
