"""A two-dimensional map of sequences that keeps near ones near.

The neighbour table becomes a weighted graph: each row has a bandwidth, found by bisection, so that its neighbours' weights
add up to the same for dense and sparse regions, and both directions of a pair are put together.  Points start at their
principal components.  In each epoch every point is drawn to its neighbours and pushed from a few sampled points; both are joins of
pairs with coordinates and one aggregate, in SQL expressions, so nothing but the number of rows reaches the driver.  Samples are pairs of
numbers a hashed distance apart in a hashed order, so a seed gives one map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import numbered, stored
from . import kmer

#: Shape of the similarity of two points at distance d, 1 / (1 + A d^2B): about 1 up to 0.1, then falling (fixed values).
A, B = 1.577, 0.895
#: Largest move that one pair may cause, points that each one is pushed from in an epoch, weight of pushes, first step, spread of the start.
CLIP, SAMPLES, PUSH, STEP, SPREAD = 4.0, 8, 3.0, 0.5, 10.0
BISECTIONS = 48


def neighbor_weights(neighbors: DataFrame) -> DataFrame:
    """(query, neighbor, weight) of a neighbour table (query, neighbor, distance): exp(-(distance - nearest) / bandwidth).

    A row's bandwidth makes its weights add up to the binary logarithm of their number; its nearest neighbours weigh 1.
    """
    lists = neighbors.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))).alias("l"))  # as many as neighbours were asked for
    lists = lists.select("query", F.col("l.neighbor").alias("neighbors"), F.col("l.distance").alias("distances"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets = batch.column(2).offsets.to_numpy()
            n = np.diff(offsets)
            d = np.full((len(n), n.max()), np.inf)
            d[np.arange(n.max()) < n[:, None]] = batch.column(2).flatten().to_numpy()
            d -= d[:, :1]
            goal, low, high = np.log2(np.maximum(n, 2)), np.zeros(len(n)), np.where(np.isfinite(d), d, 0).max(axis=1) * 64 + 1e-9
            for _ in range(BISECTIONS):
                mid = (low + high) / 2
                over = np.exp(-d / mid[:, None]).sum(axis=1) > goal
                low, high = np.where(over, low, mid), np.where(over, mid, high)
            weight = np.exp(-d / high[:, None])[np.isfinite(d)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), batch.column(1).flatten(), pa.array(weight)], ["query", "neighbor", "weight"])

    return lists.mapInArrow(run, "query string, neighbor string, weight double")


def neighbor_graph(neighbors: DataFrame) -> DataFrame:
    """(i, j, weight) in both directions: a + b - a b of the two rows' weights of a pair, 0 where one doesn't have the other."""
    w = neighbor_weights(neighbors)
    both = w.select(F.col("query").alias("i"), F.col("neighbor").alias("j"), "weight").unionByName(w.select(F.col("neighbor").alias("i"), F.col("query").alias("j"), "weight"))
    return both.groupBy("i", "j").agg((F.sum("weight") - F.when(F.count(F.lit(1)) > 1, F.min("weight") * F.max("weight")).otherwise(0.0)).alias("weight"))


def _force(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Factors of (dx, dy) by which a pair of points is drawn together and pushed apart."""
    d2 = dx * dx + dy * dy
    shape = 1 + A * F.pow(d2, B)
    return F.when(d2 > 0, -2 * A * B * F.pow(d2, B - 1) / shape).otherwise(0.0), 2 * B / ((0.001 + d2) * shape)


def _clipped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(CLIP)), F.lit(-CLIP))


def layout(graph: DataFrame, start: DataFrame, epochs: int = 40, seed: int = 7) -> DataFrame:
    """(name, x, y) of each row of ``start`` (name, x, y), moved so that ``graph`` (i, j, weight) over names has near points near."""
    spread = start.agg(F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))  # one row
    jitter = lambda k: F.pmod(F.xxhash64("name", F.lit(seed + k)), F.lit(2001)) / 1e6 - 0.001
    near = lambda c, k: F.coalesce(F.try_divide(F.col(c) - F.col(f"m{c}"), F.col(f"s{c}")), F.lit(0.0)) * SPREAD / 3 + jitter(k)
    placed = start.crossJoin(F.broadcast(spread)).select("name", near("x", 1).alias("x"), near("y", 2).alias("y"))
    placed = stored(numbered(placed, [F.xxhash64("name", F.lit(seed)), F.col("name")], "n").withColumn("n", F.col("n") - 1), "places")
    size = placed.count()
    names = placed.select("n", "name")
    edges = graph.join(names.select(F.col("name").alias("i"), F.col("n").alias("a")), "i").join(names.select(F.col("name").alias("j"), F.col("n").alias("b")), "j")
    edges = stored(edges.select("a", "b", "weight"), "edges")
    points = placed.select("n", "x", "y")
    for epoch in range(epochs if size > 1 else 0):
        hops = F.array(*[(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(s)), F.lit(size - 1)) + 1) for s in range(SAMPLES)])
        pushed = points.select(F.col("n").alias("a"), F.explode(hops).alias("hop")).select("a", F.pmod(F.col("a") + F.col("hop"), F.lit(size)).alias("b"), F.lit(None).cast("double").alias("weight"))
        other = points.select(F.col("n").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
        pairs = edges.unionByName(pushed).join(other, "b").join(points, F.col("a") == F.col("n"))
        dx, dy = F.col("x") - F.col("xb"), F.col("y") - F.col("yb")
        pull, push = _force(dx, dy)
        moves = []
        for axis, d in (("x", dx), ("y", dy)):
            drawn = F.coalesce(F.sum(F.col("weight") * _clipped(pull * d)) / F.sum("weight"), F.lit(0.0))
            moves.append((F.col(axis) + STEP * (1 - epoch / epochs) * (drawn + PUSH * F.coalesce(F.avg(F.when(F.col("weight").isNull(), _clipped(push * d))), F.lit(0.0)))).alias(f"_{axis}"))
        points = stored(pairs.groupBy("n", "x", "y").agg(*moves).select("n", F.col("_x").alias("x"), F.col("_y").alias("y")), "epoch")
    return names.join(points, "n").select("name", "x", "y")


def kmer_layout(df: DataFrame, k: int = 4, neighbors: int = 15, epochs: int = 40, seed: int = 7, exact: bool = False) -> DataFrame:
    """(sequences, x, y): a map of distinct sequences by their standardised k-mer vectors.

    Neighbours are those of :func:`.kmer.kmer_neighbors` (``exact`` there); null sequences have no place; the same input and seed give
    the same map but for the order in which sums are added.
    """
    rows = stored(df.where("sequences IS NOT NULL").select("sequences").distinct(), "sequences")
    graph = neighbor_graph(kmer.kmer_neighbors(rows, rows, k, neighbors, exact=exact))
    start = kmer.kmer_pca(rows, k).select(F.col("sequences").alias("name"), F.col("PC1").alias("x"), F.col("PC2").alias("y"))
    return layout(stored(graph, "graph"), start, epochs, seed).withColumnRenamed("name", "sequences")
