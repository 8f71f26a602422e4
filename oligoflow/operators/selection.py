"""Exact medians and other order statistics without bringing a column's values together.

A number's bits, made to sort like the number, are counted DIGIT_BITS at a time from the top: the counts say in which
bin a rank lies, the next pass counts the next bits inside that bin only.  State is a histogram of 2**DIGIT_BITS bins for each
rank that is sought; every pass is one partial aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..storage import stored

DIGIT_BITS = 16
_TOP = np.uint64(1 << 63)


@F.arrow_udf(LongType())
def _sortable(x: pa.Array) -> pa.Array:
    """Bits of doubles as numbers that sort like them (-0.0 as 0.0; NaN above all), less 2**63 so that they are signed."""
    bits = (x.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0).view(np.uint64)
    key = np.where(bits & _TOP, ~bits, bits | _TOP) ^ _TOP
    return pa.array(key.view(np.int64), mask=np.asarray(x.is_null()))


def _number(key: int) -> float:
    """The double of a key."""
    bits = (key + (1 << 63)) % (1 << 64)
    bits = bits ^ (1 << 63) if bits >> 63 else ~bits % (1 << 64)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def order_statistics(df: DataFrame, ranks: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """For each column, the values at given fractions of its order (0 smallest, 0.5 median, 1 largest), interpolated between neighbours.

    Nulls don't count; a column without values gives None.  Any numeric type is taken as double.
    """
    columns = list(ranks)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(x).cast("double").alias("x")) for k, x in enumerate(columns)])).alias("v")
    keys = df.select(cells).where("v.x IS NOT NULL").select(F.col("v.c").alias("c"), _sortable("v.x").alias("key"))
    keys = stored(keys, "keys")
    sizes = {r["c"]: r["n"] for r in keys.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {}  # (column, place from 0) -> (bits known, prefix, place inside the prefix)
    for k, name in enumerate(columns):
        for q in ranks[name] if k in sizes else []:
            at = q * (sizes[k] - 1)
            for place in {int(np.floor(at)), int(np.ceil(at))}:
                wanted[k, place] = (0, 0, place)
    while open_ := {x: s for x, s in wanted.items() if s[0] < 64}:
        bins = _counted(keys, {(c, *s[:2]) for (c, _), s in open_.items()})
        for (c, place), (known, prefix, rank) in open_.items():
            digits, counts, low, high = bins[c, known, prefix]
            below = np.cumsum(counts)
            at = int(np.searchsorted(below, rank, side="right"))
            inside = rank - int(below[at] - counts[at])
            wanted[c, place] = (64, int(low[at]), 0) if low[at] == high[at] else (known + DIGIT_BITS, (prefix << DIGIT_BITS) | int(digits[at]), inside)
    value = {x: _number(key if known == 64 else 0) for x, (known, key, _) in wanted.items()}
    out = {}
    for k, name in enumerate(columns):
        out[name] = []
        for q in ranks[name]:
            if k not in sizes:
                out[name].append(None)
                continue
            at = q * (sizes[k] - 1)
            lo, hi = int(np.floor(at)), int(np.ceil(at))
            out[name].append(value[k, lo] if lo == hi else (hi - at) * value[k, lo] + (at - lo) * value[k, hi])
    return out


def _counted(keys: DataFrame, prefixes: set[tuple[int, int, int]]) -> dict[tuple, tuple]:
    """For each (column, bits known, prefix): the next digits that occur, their counts and their least and largest keys.  At most 2**DIGIT_BITS rows each reach the driver."""
    unsigned = F.col("key").bitwiseXOR(F.lit(-(2**63)))
    parts = []
    for c, known, prefix in sorted(prefixes):
        mine = (F.col("c") == c) & ((F.shiftrightunsigned(unsigned, 64 - known) == prefix) if known else F.lit(True))
        parts.append(F.when(mine, F.struct(F.lit(known).alias("known"), F.lit(prefix).cast("long").alias("prefix"), F.shiftrightunsigned(unsigned, 64 - known - DIGIT_BITS).bitwiseAND(2**DIGIT_BITS - 1).alias("digit"))))
    rows = keys.select("c", "key", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))
    found = rows.groupBy("c", "p").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).select("c", "p.*", "n", "low", "high").toPandas()
    out = {}
    for name, part in found.groupby(["c", "known", "prefix"]):
        part = part.sort_values("digit")
        out[tuple(int(x) for x in name)] = tuple(part[x].to_numpy() for x in ("digit", "n", "low", "high"))
    return out


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column, of the middle two the mean."""
    return {k: v[0] for k, v in order_statistics(df, {c: [0.5] for c in columns}).items()}


def literal(value: float | None) -> Column:
    return F.lit(value).cast("double")
