"""k-mer counts, vectors, principal components and neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, BucketedRandomProjectionLSH, CountVectorizerModel, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import rint_to
from ..storage import partitions, stored

#: Order of residues in the vocabulary (fixed).
RESIDUES = "ATGC"
#: Columns up to which a covariance is formed; vectors and most passes of the iteration beyond.
COVARIANCE_COLUMNS, PASS_VECTORS, PASSES = 1024, 8, 60
#: Bytes of a block of vectors, queries that are compared with a block at a time, vectors that are subtracted at a time.
BLOCK_BYTES, QUERY_ROWS, EXACT_ROWS = 4 << 20, 256, 8192


def _kmers(k: int):
    """Array of the k-mers over ACGT of a sequence; shorter sequences have none."""
    if not 2 <= k <= 8:
        raise ValueError("k must be 2 to 8")
    seq = F.upper("sequences")
    windows = F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(F.length(seq) >= k, F.filter(windows, lambda w: w.rlike("^[ACGT]+$"))).otherwise(F.array().cast("array<string>"))


def kmer_counts(df: DataFrame, k: int = 4) -> DataFrame:
    """(sequences, kmer, n) of k-mers that occur."""
    return df.select("sequences", F.explode(_kmers(k)).alias("kmer")).groupBy("sequences", "kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_vectors(df: DataFrame, k: int = 4) -> DataFrame:
    """``df`` with ``features``: sparse counts over the whole vocabulary in fixed order."""
    words = ["".join(x) for x in product(RESIDUES, repeat=k)]
    model = CountVectorizerModel.from_vocabulary(words, inputCol="_kmers", outputCol="features")
    return model.transform(df.withColumn("_kmers", _kmers(k))).drop("_kmers")


def _standardised(df: DataFrame, k: int) -> DataFrame:
    vectors = stored(kmer_vectors(df, k), "kmers")
    return StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(vectors).transform(vectors)


def kmer_pca(df: DataFrame, k: int = 4) -> DataFrame:
    """``df`` with PC1, PC2 and both explained variances in percent.

    Columns are standardised by their population deviation; a component's sign makes its largest loading
    positive.  Up to COVARIANCE_COLUMNS columns the covariance is formed; for more, a few vectors are multiplied by it
    pass after pass (subspace iteration), which needs memory for the vectors only.
    """
    columns = 4**k
    vectors = stored(kmer_vectors(df, k), "kmers")
    found = vectors.select(Summarizer.metrics("mean", "std", "count").summary(F.col("features")).alias("s")).first()["s"]
    n, mean, std = found["count"], found["mean"].toArray(), found["std"].toArray()
    scale = np.divide(1.0, std, out=np.zeros(columns), where=std > 0) * (np.sqrt(n / (n - 1)) if n > 1 else 1.0)
    if columns <= COVARIANCE_COLUMNS:
        scaled = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(vectors).transform(vectors)
        model = PCA(k=2, inputCol="scaled", outputCol="pcs").fit(scaled)
        loadings, share = model.pc.toArray(), model.explainedVariance.toArray()
    else:
        loadings, share = _components(vectors, mean, scale, n)
    loadings = loadings * [np.sign(loadings[np.abs(loadings[:, c]).argmax(), c]) or 1.0 for c in (0, 1)]
    held = vectors.sparkSession.sparkContext.broadcast((loadings * scale[:, None], mean @ (loadings * scale[:, None])))
    share = [float(np.rint(x * 10000) / 100) for x in share]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pcs = _rows(batch, columns) @ held.value[0] - held.value[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pcs[:, 0]), pa.array(pcs[:, 1])], ["sequences", "PC1", "PC2"])

    pcs = _entries(vectors).mapInArrow(run, "sequences string, PC1 double, PC2 double")
    return pcs.select("*", *[F.lit(share[c]).alias(f"explained{c + 1}") for c in (0, 1)])


def _entries(vectors: DataFrame) -> DataFrame:
    """(sequences, at, n): places and counts of each vector that are not 0."""
    v = vectors.select("sequences", F.transform(vector_to_array("features"), lambda x, i: F.struct(i.alias("at"), x.alias("n"))).alias("v"))
    v = v.select("sequences", F.filter("v", lambda e: e["n"] != 0).alias("v"))
    return v.select("sequences", F.col("v.at").alias("at"), F.col("v.n").alias("n"))


def _rows(batch: pa.RecordBatch, columns: int):
    """The vectors of a batch of :func:`_entries` as a sparse matrix that can be multiplied from the left."""
    return _Sparse(batch.num_rows, columns, batch.column(1), batch.column(2))


class _Sparse:
    """Rows of sparse counts; products with dense matrices, both ways."""

    def __init__(self, rows: int, columns: int, at: pa.ListArray, n: pa.ListArray) -> None:
        self.shape, self.at, self.n = (rows, columns), at.flatten().to_numpy(), n.flatten().to_numpy()
        self.row = np.repeat(np.arange(rows), np.diff(at.offsets.to_numpy()))

    def _sum(self, place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(place, weights=v, minlength=size) for v in values.T], axis=1)

    def __matmul__(self, dense: np.ndarray) -> np.ndarray:
        return self._sum(self.row, self.n[:, None] * dense[self.at], self.shape[0])

    def transposed(self, dense: np.ndarray) -> np.ndarray:
        return self._sum(self.at, self.n[:, None] * dense[self.row], self.shape[1])


def _components(vectors: DataFrame, mean: np.ndarray, scale: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Loadings of two components and their shares of the variance, by subspace iteration over the rows.

    A pass sends PASS_VECTORS numbers for each column and task, added up by column before they reach the driver.
    """
    columns, entries = len(mean), stored(_entries(vectors), "entries")
    basis = np.linalg.qr(np.random.default_rng(3).standard_normal((columns, PASS_VECTORS)))[0]
    last = np.zeros(2)
    for _ in range(PASSES):
        held = entries.sparkSession.sparkContext.broadcast((basis * scale[:, None], mean @ (basis * scale[:, None])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sums = np.zeros((columns, PASS_VECTORS)), np.zeros(PASS_VECTORS)
            for batch in batches:
                x = _rows(batch, columns)
                y = x @ held.value[0] - held.value[1]
                total += x.transposed(y)
                sums += y.sum(axis=0)
            at = np.flatnonzero(total.any(axis=1))
            out = np.concatenate([total[at], sums[None, :]])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, columns).astype(np.int32)), *[pa.array(v) for v in out.T]], ["at", *[f"v{c}" for c in range(PASS_VECTORS)]])

        parts = entries.mapInArrow(run, "at int, " + ", ".join(f"v{c} double" for c in range(PASS_VECTORS)))
        got = parts.groupBy("at").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(PASS_VECTORS)]).toPandas().to_numpy()
        product = np.zeros((columns + 1, PASS_VECTORS))
        product[got[:, 0].astype(int)] = got[:, 1:]
        product = (product[:-1] - mean[:, None] * product[-1]) * scale[:, None] / max(n, 1)
        small = basis.T @ product
        values, turned = np.linalg.eigh((small + small.T) / 2)
        top = values[::-1][:2]
        loadings = basis @ turned[:, ::-1][:, :2]
        if np.abs(top - last).max() <= 1e-10 * max(top[0], 1e-300):
            break
        last = top
        basis = np.linalg.qr(product)[0]
    return loadings, top / max(np.count_nonzero(scale), 1)


def kmer_neighbors(queries: DataFrame, df: DataFrame, k: int = 3, neighbors: int = 15, bucket: float = 6.0, tables: int = 4, reach: float = 30.0, exact: bool = False) -> DataFrame:
    """(query, neighbor, distance, place): nearest sequences of a query set on standardised k-mer vectors, distances to 6 decimals.

    Buckets of random projections propose candidates within ``reach``; larger buckets or more tables find more.  Queries
    that find fewer than ``neighbors`` so, and all queries with ``exact``, are compared with all rows, block by block:
    a pair of blocks is a task's work and gives ``neighbors`` rows a query at most.
    """
    scaled = stored(_standardised(df, k).select("sequences", "scaled"), "scaled")
    asked = stored(scaled.join(queries.select("sequences").distinct(), "sequences", "left_semi"), "asked")
    if exact:
        return _nearest(_compared(asked, scaled, neighbors), neighbors)
    model = BucketedRandomProjectionLSH(inputCol="scaled", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=5).fit(scaled)
    near = model.approxSimilarityJoin(asked, scaled, reach, "distance").select(F.col("datasetA.sequences").alias("query"), F.col("datasetB.sequences").alias("neighbor"), rint_to(F.col("distance"), 6).alias("distance"))
    near = stored(_nearest(near.where("query <> neighbor"), neighbors), "near")
    full = near.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= neighbors).select(F.col("query").alias("sequences"))
    few = stored(asked.join(full, "sequences", "left_anti"), "few")
    return near.join(full.withColumnRenamed("sequences", "query"), "query", "left_semi").unionByName(_nearest(_compared(few, scaled, neighbors), neighbors))


def _nearest(pairs: DataFrame, neighbors: int) -> DataFrame:
    """The ``neighbors`` nearest of each query, numbered."""
    order = Window.partitionBy("query").orderBy("distance", "neighbor")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= neighbors)


def _blocks(df: DataFrame, name: str) -> DataFrame:
    """One row for every BLOCK_BYTES of vectors of a partition at most: their sequences and vectors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = max(1, BLOCK_BYTES * batch.num_rows // (8 * max(1, len(batch.column(1).flatten()))))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.string())), pa.array([part.column(1).flatten().to_numpy().tobytes()], pa.binary())], [f"{name}s", f"{name}_vectors"])

    return df.select("sequences", vector_to_array("scaled").alias("v")).mapInArrow(run, f"{name}s array<string>, {name}_vectors binary")


def _block_nearest(queries: list[str], a: np.ndarray, rows: np.ndarray, b: np.ndarray, neighbors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the query, place of the row, distance) of the ``neighbors`` rows nearest to each query, other names only.

    Products of matrices tell which rows may be among them; their error is far below ``slack``, so none is lost, and the distances of
    these rows are then taken from their differences.
    """
    own: dict[str, list[int]] = {}
    for k, name in enumerate(rows):
        own.setdefault(name, []).append(k)
    texts, squares, m = rows.astype(str), np.square(b).sum(axis=1), min(neighbors, len(rows))
    for lo in range(0, len(queries), QUERY_ROWS):
        part = a[lo : lo + QUERY_ROWS]
        mine = np.square(part).sum(axis=1)
        near = mine[:, None] + squares - 2 * (part @ b.T)
        slack = 1e-11 * (mine + squares.max())
        for i, name in enumerate(queries[lo : lo + QUERY_ROWS]):
            near[i, own.get(name, [])] = np.inf
        edge = np.sqrt(np.maximum(np.partition(near, m - 1, axis=1)[:, m - 1], 0) + slack) + 2e-6  # distances are rounded to 6 decimals
        q, r = np.nonzero((near <= (np.square(edge) + slack)[:, None]) & np.isfinite(near))
        far = np.empty(len(q))
        for k in range(0, len(q), EXACT_ROWS):
            s = slice(k, k + EXACT_ROWS)
            far[s] = np.rint(np.sqrt(np.square(b[r[s]] - part[q[s]]).sum(axis=1)) * 1e6) / 1e6
        order = np.lexsort((texts[r], far, q))
        q, r, far = q[order], r[order], far[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < neighbors
        yield q[kept] + lo, r[kept], far[kept]


def _compared(asked: DataFrame, scaled: DataFrame, neighbors: int) -> DataFrame:
    """(query, neighbor, distance): of each pair of blocks, the ``neighbors`` nearest rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, q, rows, d in zip(*batch.columns, strict=True):
                queries, rows = queries.as_py(), np.array(rows.as_py(), object)
                a, b = (np.frombuffer(x.as_py()).reshape(len(names), -1) for x, names in ((q, queries), (d, rows)))
                names = np.array(queries, object)
                for i, j, far in _block_nearest(queries, a, rows, b, neighbors):
                    yield pa.RecordBatch.from_arrays([pa.array(names[i], pa.string()), pa.array(rows[j], pa.string()), pa.array(far)], ["query", "neighbor", "distance"])

    # stored, so that blocks aren't packed again for every partition they meet, and dealt to all tasks
    pairs = stored(_blocks(asked.repartition(partitions(asked.sparkSession)), "query"), "blocks").crossJoin(stored(_blocks(scaled, "row"), "blocks"))
    return pairs.mapInArrow(run, "query string, neighbor string, distance double")


def kmer_cluster_summary(clustered: DataFrame, clusters: list[int]) -> DataFrame:
    """(Cluster, count) of selected clusters."""
    return clustered.where(F.col("Cluster").isin(clusters)).groupBy("Cluster").agg(F.count(F.lit(1)).alias("count"))
