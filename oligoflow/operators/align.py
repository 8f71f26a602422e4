"""Multiple alignment of clusters, and statistics of alignment columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import progressive
from ..functions import sequences as sq
from ..functions.sequences import rint_to
from ..storage import numbered_within, stored
from .browse import top_enriched

#: Most sequences, and most characters of them, that are aligned in one task; aligned groups that are merged at a time.
GROUP_ROWS, GROUP_CHARS, FAN = 192, 1 << 14, 48
_GROUP = "Cluster int, node long, parent long, symbols string, profile array<double>, columns array<int>, seqs array<string>"


def _codes(text: str, place: dict[str, int]) -> np.ndarray:
    return np.array([place[c] for c in text], np.int64)


def _merged(cluster: int | None, parent: int, names: list[int], symbols: str, profiles: list[np.ndarray], seqs: list[list[str] | None]) -> list[tuple]:
    """Rows of a group that was aligned: each input with the columns it takes, and the group's profile as an input of the next level."""
    at = progressive.align(profiles)
    columns = max((int(x.max(initial=-1)) for x in at), default=-1) + 1
    total = np.zeros((columns, len(symbols) + 1))
    for p, x in zip(profiles, at, strict=True):
        total[:, -1] += p.sum(axis=1).max(initial=0)
        total[x, -1] -= p.sum(axis=1)
        total[x] += p
    out = [(cluster, n, parent, None, None, x.tolist(), s) for n, x, s in zip(names, at, seqs, strict=True)]
    return [*out, (cluster, parent, None, symbols, total.ravel().tolist(), None, None)]


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.string())]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in _GROUP.split(", ")])


def _first_groups(table: pa.Table) -> pa.Table:
    """A group of sequences, aligned; its sequences stand in one row for each."""
    texts = table.column("seq").to_pylist()
    symbols = "".join(sorted(set("".join(texts))))
    place = {c: k for k, c in enumerate(symbols)}
    profiles = [progressive.one_hot(_codes(t, place), len(symbols) + 1) for t in texts]
    cluster, group = table.column("Cluster")[0].as_py(), table.column("group")[0].as_py()
    return _table(_merged(cluster, group, list(range(len(texts))), symbols, profiles, [[t] for t in texts]))


def _next_groups(table: pa.Table) -> pa.Table:
    """Profiles of several groups, aligned."""
    rows = sorted(table.select(["Cluster", "node", "symbols", "profile", "group"]).to_pylist(), key=lambda r: r["node"])
    symbols = "".join(sorted(set("".join(r["symbols"] for r in rows))))
    place = {c: k for k, c in enumerate(symbols)}
    profiles = []
    for r in rows:
        mine = np.array(r["profile"]).reshape(-1, len(r["symbols"]) + 1)
        wide = np.zeros((len(mine), len(symbols) + 1))
        wide[:, [place[c] for c in r["symbols"]] + [-1]] = mine
        profiles.append(wide)
    return _table(_merged(rows[0]["Cluster"], rows[0]["group"], [r["node"] for r in rows], symbols, profiles, [None] * len(rows)))


def _sketch(seq: Column) -> list[Column]:
    """Two small numbers that similar sequences are likely to share: the smallest hashes of their words."""
    n = progressive.WORD
    words = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - n + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(n)))
    return [F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(seed)))) for seed in (1, 2)]


def cluster_align(clustered: DataFrame) -> DataFrame:
    """``clustered`` with gapped sequences of equal length in each cluster, sorted by Cluster and Rank.

    A multiple alignment by sum of pairs (:mod:`..functions.progressive`).  Distinct sequences of a cluster are sorted by what
    similar ones share and dealt to groups of at most GROUP_ROWS; a task aligns a group along its guide tree.  The groups' profiles are
    then aligned in the same way, FAN at a time, level by level, until a cluster has one; columns are handed down from there.  So a
    cluster of any size never meets in one task, and one of up to GROUP_ROWS sequences is aligned whole.

    Gaps in the input are removed first; null sequences stay null; a single sequence passes; rows that repeat a sequence get the same
    row; an empty sequence is all gaps; rows without a Cluster are a cluster of their own.
    """
    bare = F.replace("sequences", F.lit("-"), F.lit(""))
    distinct = stored(clustered.select(F.col("Cluster").cast("int").alias("Cluster"), bare.alias("seq")).where("seq <> ''").distinct(), "distinct")
    longest = distinct.agg(F.max(F.length("seq"))).first()[0] or 1
    rows = max(2, min(GROUP_ROWS, GROUP_CHARS // longest))
    dealt = numbered_within(distinct.select("*", *[x.alias(f"k{k}") for k, x in enumerate(_sketch(F.col("seq")))]), "Cluster", [F.col("k0"), F.col("k1"), F.col("seq")], "n")
    dealt = dealt.select("Cluster", "seq", F.floor((F.col("n") - 1) / rows).cast("long").alias("group"))
    level = stored(dealt.groupBy("Cluster", "group").applyInArrow(_first_groups, _GROUP), "groups")
    leaves, maps = level.where("seqs IS NOT NULL"), []
    while True:
        tops = level.where("profile IS NOT NULL")
        if (tops.agg(F.max("node")).first()[0] or 0) == 0:
            break
        level = stored(tops.withColumn("group", F.floor(F.col("node") / FAN).cast("long")).groupBy("Cluster", "group").applyInArrow(_next_groups, _GROUP), "groups")
        maps.append(level.where("columns IS NOT NULL"))
    wide = F.size("profile").cast("long") / (F.length("symbols") + 1)
    own = F.when(wide > 0, F.sequence(F.lit(0), wide.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    final = tops.select("Cluster", "node", own.alias("to"), wide.cast("int").alias("wide"))
    for down in reversed(maps):
        above = final.select(F.col("Cluster").alias("_c"), F.col("node").alias("_p"), "to", "wide")
        both = down.join(above, F.col("Cluster").eqNullSafe(F.col("_c")) & (F.col("parent") == F.col("_p")))
        final = stored(both.select("Cluster", "node", F.transform("columns", lambda c: F.get("to", c)).alias("to"), "wide"), "columns")
    above = final.select(F.col("Cluster").alias("_c"), F.col("node").alias("_p"), "to", "wide")
    placed = leaves.join(above, F.col("Cluster").eqNullSafe(F.col("_c")) & (F.col("parent") == F.col("_p"))).select("Cluster", F.col("seqs")[0].alias("seq"), "columns", "to", "wide")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, columns, to, wide in zip(*(batch.column(k) for k in range(1, 5)), strict=True):
                row = np.full(wide.as_py(), "-")
                row[to.values.to_numpy()[columns.values.to_numpy()]] = list(seq.as_py())
                out.append("".join(row))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["_c", "_s", "_aligned"])

    aligned = stored(placed.mapInArrow(spread, "_c int, _s string, _aligned string"), "aligned")
    both = clustered.withColumn("_bare", bare).join(aligned, F.col("Cluster").eqNullSafe(F.col("_c")) & (F.col("_bare") == F.col("_s")), "left")
    widths = final.groupBy(F.col("Cluster").alias("_cw")).agg(F.max("wide").alias("_wide"))  # a row for each cluster, for sequences that are empty
    both = both.join(widths, F.col("Cluster").eqNullSafe(F.col("_cw")), "left")
    gaps = F.when(F.col("_bare") == "", F.repeat(F.lit("-"), F.coalesce("_wide", F.lit(0))))
    return both.withColumn("sequences", F.coalesce("_aligned", gaps)).select(clustered.columns).orderBy("Cluster", "Rank")


def alignment_score(df: DataFrame) -> DataFrame:
    """(Cluster, score): sum of pairs over all rows and columns of each cluster's alignment, from the counts of each column.

    Two equal residues MATCH, two others MISMATCH, a residue and a gap GAP, two gaps 0 (see :mod:`..functions.progressive`).
    """
    n = residue_positions(df.select("Cluster", "sequences")).groupBy("Cluster", "Position", "Residue").agg(F.count(F.lit(1)).cast("double").alias("n"))
    gap = F.col("Residue") == "-"
    column = n.groupBy("Cluster", "Position").agg(F.coalesce(F.sum(F.when(~gap, F.col("n"))), F.lit(0.0)).alias("r"), F.coalesce(F.sum(F.when(gap, F.col("n"))), F.lit(0.0)).alias("g"), F.coalesce(F.sum(F.when(~gap, F.col("n") * F.col("n"))), F.lit(0.0)).alias("q"))
    same, pairs = (F.col("q") - F.col("r")) / 2, F.col("r") * (F.col("r") - 1) / 2
    return column.groupBy("Cluster").agg(F.sum(progressive.MATCH * same + progressive.MISMATCH * (pairs - same) + progressive.GAP * F.col("r") * F.col("g")).alias("score"))


def msa_check(df: DataFrame) -> DataFrame:
    """(Cluster, lengths, aligned): number of different lengths in each cluster, and whether it is one."""
    out = df.groupBy("Cluster").agg(F.count_distinct(F.length("sequences")).alias("lengths"))
    return out.withColumn("aligned", F.col("lengths") == 1)


def require_aligned(df: DataFrame) -> DataFrame:
    """``df``, or ValueError if its sequences have several lengths."""
    lengths = df.agg(F.min(F.length("sequences")).alias("lo"), F.max(F.length("sequences")).alias("hi")).first()
    if lengths["lo"] != lengths["hi"]:
        raise ValueError(f"sequences are not aligned: lengths {lengths['lo']} to {lengths['hi']}")
    return df


def residue_positions(df: DataFrame) -> DataFrame:
    """``df`` exploded to a row for each (Position from 1, Residue)."""
    return df.select("*", F.posexplode(F.split("sequences", "")).alias("_p", "Residue")).withColumn("Position", F.col("_p") + 1).drop("_p")


def column_entropy(df: DataFrame) -> DataFrame:
    """(Position, entropy): Shannon entropy in nats of each column, gaps included, to 6 decimals."""
    n = residue_positions(df.select("sequences")).groupBy("Position", "Residue").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = F.sum("n")
    # sum of -p ln p with p = n / N is ln N - (sum n ln n) / N
    return n.groupBy("Position").agg(rint_to(F.log(total) - F.sum(F.col("n") * F.log("n")) / total, 6).alias("entropy")).orderBy("Position")


def column_mutual_info(df: DataFrame) -> DataFrame:
    """(i, j, mi): mutual information in nats of all pairs of columns, to 6 decimals; the diagonal is the entropy.

    Each task adds up one matrix of joint residue counts (residues of a column against those of all others),
    so rows are never expanded to pairs; sequences must have one length, others are refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            seqs = [x for x in batch.column(0).to_pylist() if x]
            for at in range(0, len(seqs), 4096):
                matrix = np.array([np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in seqs[at : at + 4096]])
                letters = np.unique(matrix).tolist()
                hot = {c: (matrix == c).astype(np.float32) for c in letters}
                for a in letters:
                    for b in letters:
                        part = (hot[a].T @ hot[b]).astype(np.int64)
                        joint[a, b] = joint[a, b] + part if (a, b) in joint else part
        for (a, b), n in joint.items():
            i, j = np.nonzero(np.triu(n))
            yield pa.RecordBatch.from_arrays([pa.array(i + 1), pa.array(j + 1), pa.array([chr(a)] * len(i), pa.string()), pa.array([chr(b)] * len(i), pa.string()), pa.array(n[i, j])], ["i", "j", "a", "b", "n"])

    joint = require_aligned(df).select("sequences").mapInArrow(run, "i long, j long, a string, b string, n long")
    joint = stored(joint.groupBy("i", "j", "a", "b").agg(F.sum("n").cast("double").alias("n")), "joint")
    single = joint.where("i = j AND a = b").select("i", "a", "n")
    left = single.select("i", "a", F.col("n").alias("na"))
    right = single.select(F.col("i").alias("j"), F.col("a").alias("b"), F.col("n").alias("nb"))
    total = single.where("i = 1").agg(F.sum("n").alias("t"))  # one row
    terms = joint.join(left, ["i", "a"]).join(right, ["j", "b"]).crossJoin(F.broadcast(total))
    mi = terms.groupBy("i", "j").agg(rint_to(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))), 6).alias("mi"))
    return mi.union(mi.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "mi"))


def position_enrichment(df: DataFrame, cluster: int, seq_type: str = "dna", max_sequences: int | None = None) -> DataFrame:
    """(Residue, Position, AvEnrich): mean Enrichment of the sequences with a residue at a position, to 3 decimals, null if none has it.

    Takes one cluster's sequences over the alphabet with a finite Enrichment, with ``max_sequences`` only so many of largest
    Enrichment; if they have several lengths they are aligned first.
    """
    seq = sq.u_to_t(F.col("sequences")) if seq_type == "dna" else F.col("sequences")
    x = df.withColumn("sequences", seq).where((F.col("Cluster") == cluster) & sq.only_alphabet(F.col("sequences"), seq_type) & F.col("Enrichment").isNotNull())
    x = stored(x if max_sequences is None else top_enriched(x, max_sequences), "positions")
    lengths = x.agg(F.min(F.length("sequences")).alias("lo"), F.max(F.length("sequences")).alias("hi")).first()
    if lengths["lo"] is None:
        raise ValueError(f"no valid sequences in cluster {cluster}")
    if lengths["lo"] != lengths["hi"]:
        x = cluster_align(x.dropDuplicates(["sequences"]).withColumn("Rank", F.lit(1)))
    length = x.agg(F.max(F.length("sequences")).alias("n")).first()["n"]
    means = residue_positions(x.select("sequences", "Enrichment")).groupBy("Residue", "Position").agg(rint_to(F.avg("Enrichment"), 3).alias("AvEnrich"))
    spark = df.sparkSession
    grid = spark.range(1, length + 1).select(F.col("id").cast("int").alias("Position"), F.explode(F.array(*[F.lit(c) for c in sq.ALPHABETS[seq_type]])).alias("Residue"))
    return grid.join(means, ["Residue", "Position"], "left").select("Residue", "Position", "AvEnrich")


def position_matrix(positions: DataFrame, length: int) -> DataFrame:
    """Residues as rows, positions 1..length as columns."""
    return positions.groupBy("Residue").pivot("Position", list(range(1, length + 1))).agg(F.first("AvEnrich"))


def position_stats(positions: DataFrame) -> DataFrame:
    """One row over all cells that have a value: min, max, mean, median; and the numbers of positions and cells."""
    e = F.col("AvEnrich")
    return positions.agg(F.min(e).alias("min"), F.max(e).alias("max"), rint_to(F.avg(e), 6).alias("mean"), F.median(e).alias("median"), F.count_distinct("Position").alias("positions"), F.count(e).alias("cells"))
