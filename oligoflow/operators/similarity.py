"""Pairs of strings within a few edits of each other, without comparing all with all.

A string cut into ``most`` + 1 pieces and changed by ``most`` edits keeps one of them whole, near its place.  So one side is cut into
pieces, the other gives the substrings that could be such a piece, an equality join brings both together, and the
edit distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _piece(length: Column, number: Column, pieces: int) -> tuple[Column, Column]:
    """(start from 1, length) of a piece of a string: all have nearly the same length, the last ones one more."""
    short = F.floor(length / pieces).cast("int")
    longer = length % pieces  # so many of the last pieces have one character more
    before = F.greatest(number - 1 - (pieces - longer), F.lit(0))
    return (number - 1) * short + before + 1, short + F.when(number > pieces - longer, 1).otherwise(0)


def _cut(df: DataFrame, text: str, most: int) -> DataFrame:
    """A row for each piece of each string: (_length, _number, _piece); strings too short for pieces have one empty piece, number 0."""
    length, number = F.length(text), F.explode(F.when(F.length(text) > most, F.sequence(F.lit(1), F.lit(most + 1))).otherwise(F.array(F.lit(0)))).alias("_number")
    start, size = _piece(F.col("_length"), F.col("_number"), most + 1)
    rows = df.select("*", length.alias("_length"), number)
    return rows.withColumn("_piece", F.when(F.col("_number") > 0, F.substring(F.col(text), start, size)).otherwise(""))


def _probes(df: DataFrame, text: str, most: int, lengths: list[int]) -> DataFrame:
    """A row for each substring that may be a piece of a string of one of ``lengths``.

    Of a piece, only places are tried at which the edits before it and behind it can still add up to ``most``.
    """
    n = F.length(text)
    rows = df.select("*", F.explode(F.array(*[F.lit(x) for x in lengths]).cast("array<int>")).alias("_length")).where(F.abs(n - F.col("_length")) <= most)
    rows = rows.select("*", F.explode(F.when(F.col("_length") > most, F.sequence(F.lit(1), F.lit(most + 1))).otherwise(F.array(F.lit(0)))).alias("_number"))
    start, size = _piece(F.col("_length"), F.col("_number"), most + 1)
    shift, before, behind = n - F.col("_length"), F.col("_number") - 1, most + 1 - F.col("_number")
    low = F.greatest(F.lit(1), start - before, start + shift - behind)
    high = F.least(n - size + 1, start + before, start + shift + behind)
    places = F.when(F.col("_number") == 0, F.array(F.lit(1))).when(low <= high, F.sequence(low, high))
    rows = rows.withColumns({"_size": size, "_places": places}).select("*", F.explode("_places").alias("_at"))
    return rows.withColumn("_piece", F.when(F.col("_number") > 0, F.substring(F.col(text), F.col("_at"), F.col("_size"))).otherwise("")).drop("_size", "_places", "_at")


def similar_pairs(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """(i, j, led): the rows of ``a`` (i, s) and ``b`` (j, t) whose strings are at most ``most`` edits apart; i and j are ids of any type.

    A pair that shares several pieces comes several times: take a minimum, or distinct rows.  Null strings have no pairs.  Strings of
    ``b`` of up to ``most`` characters have no pieces and are compared with all of ``a`` of nearly their length; few such strings differ.
    The distinct lengths of ``b`` reach the driver.
    """
    b = b.where("t IS NOT NULL")
    lengths = sorted(r[0] for r in b.select(F.length("t")).distinct().collect())
    if not lengths:
        return a.crossJoin(b.limit(0)).select("i", "j", F.lit(0).alias("led"))
    pieces = _cut(b.select("j", "t"), "t", most)
    sought = _probes(a.where("s IS NOT NULL").select("i", "s"), "s", most, lengths)
    found = sought.join(pieces, ["_length", "_number", "_piece"]).withColumn("led", F.levenshtein("s", "t", most))
    return found.where("led >= 0").select("i", "j", "led")
