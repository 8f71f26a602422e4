"""Connected components by label propagation with pointer jumping, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import partitions, stored

#: Edges for each task of a pass; small graphs are not spread over more tasks than they fill.
EDGES_A_TASK = 50_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: each node with the smallest it is connected to by them; a bounded number of edges at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = root(a), root(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
        if len(parent) > 2 * EDGES_A_TASK:
            yield stars()
            parent.clear()
    yield stars()


def components(edges: DataFrame, passes: int | None = None) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b; ids not equal); component is the smallest id reachable.

    Tasks first contract their own edges to stars, and once more what is left, in tasks of EDGES_A_TASK.  Each pass takes the smallest label among neighbours and
    then the label of that label, so paths halve; passes are cut by tables in the shared folder.  A hub's
    edges are one key of a join that Spark can split and of an aggregate with partial sums, never a group in
    one task.  With ``passes`` it stops after so many: labels are then of nodes that are connected, but
    a component may still have several.
    """
    stars = stored(edges.select("a", "b").mapInArrow(_contracted, "a long, b long").distinct(), "edges")
    tasks = min(partitions(edges.sparkSession), 1 + stars.count() // EDGES_A_TASK)
    stars = stored(stars.coalesce(tasks).mapInArrow(_contracted, "a long, b long"), "edges")
    both = stored(stars.union(stars.select("b", "a")).coalesce(tasks), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")).coalesce(tasks), "labels")
    done = 0
    while passes is None or done < passes:
        seen = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(seen, labels.id == seen.a).select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        hooked = stored(hooked.coalesce(tasks), "labels")
        if hooked.where("component <> old").isEmpty():
            return hooked.select("id", "component")
        up = hooked.select(F.col("id").alias("up"), F.col("component").alias("top"))
        labels = stored(hooked.join(up, hooked.component == up.up).select("id", F.least("component", "top").alias("component")).coalesce(tasks), "labels")
        done += 1
    return labels
