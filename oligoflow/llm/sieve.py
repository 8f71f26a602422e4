"""A Bloom filter of fixed size: keeps rows that can have no partner in a join from being shuffled with their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 8 MB, whatever the input.  From some ten million keys on it lets more and more rows pass, which costs
#: shuffle and changes no result.
BITS = 1 << 26


def places(key: Column) -> list[Column]:
    """The two bits of a key (a null key has bits too)."""
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BITS)).alias(f"_bit{seed}") for seed in (1, 2)]


def hash_places(h: Column) -> list[Column]:
    """The two bits of a key that is a mixed 64-bit hash already: its lowest bits, as :func:`hash_passes` reads them."""
    return [h.bitwiseAND(BITS - 1), F.shiftrightunsigned(h, 26).bitwiseAND(BITS - 1)]


def sieve(keys: DataFrame, hashed: bool = False) -> Broadcast:
    """The filter of the only column of ``keys``; at most BITS / 64 rows of two numbers reach the driver."""
    key = F.col(keys.columns[0])
    bit = keys.select(F.explode(F.array(*(hash_places(key) if hashed else places(key)))).alias("p"))
    words = bit.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def passes(bits: np.ndarray, a: pa.Array, b: pa.Array) -> np.ndarray:
    """Which rows the filter lets pass, from their two bits."""
    out = np.ones(len(a), bool)
    for p in (a.to_numpy(), b.to_numpy()):
        out &= (bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def hash_passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of these hashes (unsigned) the filter of a ``hashed`` sieve lets pass."""
    out = np.ones(len(h), bool)
    for p in (h & np.uint64(BITS - 1), (h >> np.uint64(26)) & np.uint64(BITS - 1)):
        out &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def sieved(df: DataFrame, key: Column, bits: Broadcast) -> DataFrame:
    """The rows of ``df`` whose key may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(passes(bits.value, batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], batch.schema.names[:-2]).filter(keep)

    return df.select("*", *places(key)).mapInArrow(run, df.schema)
