"""Subtree totals of a forest by parallel tree contraction.

Rounds of joins shrink the tree.  Rake: all leaves are taken off and their totals added to their parents, as one partial
aggregate, so a node with millions of children is no hot group.  Compress: in chains of nodes with a single child those whose
random priority is smaller than that of both neighbours are cut out and their child tied to their parent, with what the cut
node would have added kept on the new edge.  A path of a million nodes loses about a third of them a round, so rounds follow
the logarithm of the number of nodes and not the depth.  Then the rounds are undone from the last to the first:
the total of a node that was cut out is that of the child it was cut from, plus what was noted.

Every node travels by its own id only, which is unique, and never with its siblings.  Each round is a table in the shared
folder, geometrically smaller than the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(a, b, kids, total of each value) of each node: its value summed over its subtree, itself included.

    ``nodes`` has an id of two longs (a, b), unique and not null, the parent's id (pa, pb), null for roots, and LONG columns
    ``values``; a null value counts 0.  Other columns are not read.  A parent must be a node, and parents form no cycle.
    ``kids`` is the number of children.  No nodes, no rows.
    """
    kids = nodes.where("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("kids"))
    mine = nodes.select("a", "b", "pa", "pb", *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values], *[F.lit(0).cast("long").alias(f"edge_{v}") for v in values])
    alive = stored(mine.join(kids, ["a", "b"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)).cast("long")), "tree")
    first, rounds = alive.select("a", "b", "kids"), []
    while not alive.where("pa IS NOT NULL").isEmpty():
        raked, rest = _rake(alive, values)
        spliced = stored(_compress(rest, values, len(rounds)), "compressed")
        cut = spliced.where("va IS NOT NULL").select(F.col("va").alias("a"), F.col("vb").alias("b"), F.col("a").alias("ca"), F.col("b").alias("cb"), *[F.col(f"add_{v}") for v in values])
        rounds.append((raked, cut))
        alive = spliced.select(*alive.columns)
    totals = alive.select("a", "b", *values)
    for raked, cut in reversed(rounds):
        child = totals.select(F.col("a").alias("ca"), F.col("b").alias("cb"), *[F.col(v).alias(f"of_{v}") for v in values])
        undone = cut.join(child, ["ca", "cb"]).select("a", "b", *[(F.col(f"add_{v}") + F.col(f"of_{v}")).alias(v) for v in values])
        totals = stored(totals.unionByName(undone).unionByName(raked), "totals")
    return first.join(totals, ["a", "b"])


def _rake(alive: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Totals of the leaves, and the other nodes with what their leaves add, their remaining children and (``child``) one of those."""
    leaf = (F.col("kids") == 0) & F.col("pa").isNotNull()
    sums = [F.sum(F.when(leaf, F.col(v) + F.col(f"edge_{v}"))).alias(f"more_{v}") for v in values]
    given = alive.where("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count_if(~leaf).alias("left"), F.max(F.when(~leaf, F.struct("a", "b"))).alias("child"), *sums)
    rest = alive.where(~leaf).join(given, ["a", "b"], "left")
    out = rest.select("a", "b", "pa", "pb", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values], *[f"edge_{v}" for v in values], F.coalesce("left", F.lit(0)).cast("long").alias("kids"), "child")
    return alive.where(leaf).select("a", "b", *values), out


def _compress(rest: DataFrame, values: list[str], number: int) -> DataFrame:
    """``rest`` without the nodes that are cut out; a row that takes the place of one has its id (va, vb) and what it adds to the row's total (add_)."""

    def priority(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b, F.lit(number))

    own = priority(F.col("a"), F.col("b"))
    cut = (F.col("kids") == 1) & F.col("pa").isNotNull() & (own < priority(F.col("child.a"), F.col("child.b"))) & (own < priority(F.col("pa"), F.col("pb")))
    told = rest.where(cut).select(F.col("child.a").alias("a"), F.col("child.b").alias("b"), F.col("a").alias("va"), F.col("b").alias("vb"), F.col("pa").alias("na"), F.col("pb").alias("nb"), *[F.col(v).alias(f"cut_{v}") for v in values], *[F.col(f"edge_{v}").alias(f"cut_edge_{v}") for v in values])
    both = rest.where(~F.coalesce(cut, F.lit(False))).drop("child").join(told, ["a", "b"], "left")
    zero = F.lit(0).cast("long")
    return both.select(
        "a", "b", F.coalesce("na", "pa").alias("pa"), F.coalesce("nb", "pb").alias("pb"), *values,
        *[(F.col(f"edge_{v}") + F.coalesce(f"cut_{v}", zero) + F.coalesce(f"cut_edge_{v}", zero)).alias(f"edge_{v}") for v in values],
        "kids", "va", "vb", *[(F.col(f"cut_{v}") + F.col(f"edge_{v}")).alias(f"add_{v}") for v in values],
    )
