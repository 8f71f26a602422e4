"""Queries over the test tables, with an SQL oracle for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import align, browse, cluster, compare, counts, diversity, kmer, layout, preprocess, profile
from ..sources import files
from ..storage import new_path, stored
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A best match of a constant region as one number (edits, distance of lengths, length), for the oracles.
_CUT5 = "list_min([levenshtein(substring({s}, 1, k), '{c}') * 1000000 + abs(k - {n}) * 1000 + k FOR k IN range({lo}, {hi} + 1)])"
_CUT3 = "list_min([levenshtein(substring({s}, greatest(length({s}) - k, 0) + 1, k), '{c}') * 1000000 + abs(k - {n}) * 1000 + k FOR k IN range({lo}, {hi} + 1)])"


def query(sql: str | None = None, recursive: bool = False, plain: bool = False):
    """Register a query under its function's name, with the rest of its oracle after the common CTEs."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if plain else fx.prelude(recursive) + sql
        return f

    return add


def _cut_sql(end: str, const: str) -> str:
    """SQL of the number of characters cut at one end of raw."""
    n, e = len(const), int(len(const) * 0.1)
    best = (_CUT5 if end == "5" else _CUT3).format(s="raw" if end == "5" else "cut5", c=const, n=n, lo=n - e, hi=n + e)
    s = "raw" if end == "5" else "cut5"
    return f"CASE WHEN {best} // 1000000 <= {e} THEN least({best} % 1000, length({s})) ELSE 0 END"


_TRIMMED = f""", t5 AS (SELECT *, {_cut_sql('5', fx.CONST_5P)} AS n5 FROM reads),
c5 AS (SELECT *, substring(raw, n5 + 1) AS cut5, substring(raw_quality, n5 + 1) AS cut5q FROM t5),
t3 AS (SELECT *, {_cut_sql('3', fx.CONST_3P)} AS n3 FROM c5),
trimmed AS (SELECT *, substring(cut5, 1, length(cut5) - n3) AS both_s, substring(cut5q, 1, length(cut5q) - n3) AS both_q FROM t3)
"""
_ERROR = "list_sum([pow(10.0, -(ascii(c) - 33) / 10.0) FOR c IN string_split({q}, '')]) / length({q})"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.reads(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("raw").alias("sequences"), F.col("raw_quality").alias("quality"))


# sources and sinks


@query("SELECT ID, Rank, Reads, CAST(RPU AS DOUBLE) AS RPU, length, sequences FROM counta")
def read_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counts table written as FASTA and read back."""
    path = new_path(spark, "fasta")
    files.write_fasta(fx.population(spark, sf_dir), path)
    return files.read_fasta(spark, path).select("ID", "Rank", "Reads", "RPU", "length", "sequences")


@query("SELECT concat(l_orderkey, '-', l_linenumber) AS id, sequences, quality FROM reads")
def read_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads written as FASTQ and read back."""
    path = new_path(spark, "fastq")
    files.write_fastq(fx.reads(spark, sf_dir).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "sequences", "quality"), path)
    return files.read_fastq(spark, path)


@query("SELECT concat(l_orderkey, '-', l_linenumber) AS id, sequences, quality FROM reads")
def read_fastq_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads written as FASTQ with lines of 20 characters and read back."""
    path = new_path(spark, "fastq-wrapped")
    wrapped = [F.regexp_replace(c, "(.{20})(?=.)", "$1\n") for c in ("sequences", "quality")]
    fx.reads(spark, sf_dir).select(F.concat_ws("\n", F.concat(F.lit("@"), F.concat_ws("-", "l_orderkey", "l_linenumber")), wrapped[0], F.lit("+"), wrapped[1])).write.text(path)
    return files.read_fastq(spark, path)


@query("SELECT ID, Rank, Reads, CAST(RPU AS DOUBLE) AS RPU, length, sequences FROM counta")
def read_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counts table written as gzipped FASTA and read back."""
    path = new_path(spark, "fasta-gz")
    rows = fx.population(spark, sf_dir)
    rows.select(F.concat(F.lit(">"), F.col("ID"), F.lit("\n"), F.col("sequences"))).write.option("compression", "gzip").text(path)
    return files.read_fasta(spark, path).select("ID", "Rank", "Reads", "RPU", "length", "sequences")


@query("SELECT ID, Rank, Reads, CAST(RPU AS DOUBLE) AS RPU, Cluster, RankInCluster, LED, CAST(length(sequences) AS INT) AS length, sequences FROM clustera")
def read_counts_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clustered table written as CSV and read back."""
    path = new_path(spark, "csv")
    files.write_csv(fx.clustered(fx.population(spark, sf_dir)), path)
    return files.read_counts_csv(spark, path)


@query("SELECT sequences, CAST(length(sequences) AS INT) AS length, count(*) AS n FROM reads GROUP BY ALL")
def convert_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ to FASTA: reads written as FASTQ, read, written as FASTA, read again, and counted."""
    fastq, fasta = new_path(spark, "fastq"), new_path(spark, "fasta")
    files.write_fastq(fx.reads(spark, sf_dir).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "sequences", "quality"), fastq)
    files.write_fasta(files.read_fastq(spark, fastq), fasta, id_col="id")
    return files.read_fasta(spark, fasta).groupBy("sequences", "length").agg(F.count(F.lit(1)).alias("n"))


# row operators


@query(_TRIMMED + "SELECT l_orderkey, l_linenumber, cut5 AS sequences, cut5q AS quality FROM trimmed")
def trim_5p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.trim_5p(_raw(spark, sf_dir), fx.CONST_5P)


@query(_TRIMMED + "SELECT l_orderkey, l_linenumber, both_s AS sequences, both_q AS quality FROM trimmed")
def trim_3p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.trim_3p(preprocess.trim_5p(_raw(spark, sf_dir), fx.CONST_5P), fx.CONST_3P)


@query("SELECT l_orderkey, l_linenumber, ragged AS sequences FROM reads WHERE length(ragged) BETWEEN 32 AND 100")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.length_filter(fx.reads(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("ragged").alias("sequences")), 32, 100)


@query(f"SELECT l_orderkey, l_linenumber, sequences, quality FROM reads WHERE {_ERROR.format(q='quality')} <= 0.005")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.quality_filter(fx.reads(spark, sf_dir).select("l_orderkey", "l_linenumber", "sequences", "quality"))


@query("""SELECT sequences AS original, CASE WHEN hit IS NULL THEN sequences ELSE concat(substring(sequences, 1, hit // 1000000 - 1), substring(sequences, hit // 1000000 + hit % 1000)) END AS sequences
FROM (SELECT sequences, [x FOR x IN [s * 1000000 + (list_min([levenshtein(substring(sequences, s, k), 'ACGTTGCA') * 1000000 + abs(k - 8) * 1000 + k FOR k IN range(7, 10)]) % 1000)
  + CASE WHEN list_min([levenshtein(substring(sequences, s, k), 'ACGTTGCA') FOR k IN range(7, 10)]) <= 1 THEN 0 ELSE -1000000000 END FOR s IN range(1, length(sequences) + 1)] IF x > 0][1] AS hit FROM ua)""")
def excise_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = counts.count_unique(fx.reads(spark, sf_dir)).select(F.col("sequences").alias("original"), "sequences")
    return preprocess.excise_region(unique, "ACGTTGCA")


_REPORT = _TRIMMED + f""", f AS (SELECT length(both_s) BETWEEN 10 AND 100 AS fits, coalesce(CASE WHEN length(both_q) > 0 THEN {_ERROR.format(q='both_q')} END <= 0.005, false) AS good FROM trimmed)
SELECT count(*) AS total_reads, count_if(fits)::BIGINT AS length_passed, count_if(fits AND good)::BIGINT AS passed, round_even(count_if(fits AND good) * 100.0::DOUBLE / count(*) * 100, 0) / 100 AS pass_rate FROM f"""


@query(_REPORT)
def preprocess_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.preprocess_report(_raw(spark, sf_dir), fx.CONST_5P, fx.CONST_3P)


@query(_REPORT.replace("SELECT count(*) AS total_reads", "SELECT count_if(fits AND good)::BIGINT AS written, count(*) AS total_reads"))
def preprocess_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report gathered by the job that writes the filtered reads, and how many it wrote."""
    path = new_path(spark, "filtered")
    reads, seen = preprocess.preprocess_observed(_raw(spark, sf_dir), fx.CONST_5P, fx.CONST_3P)
    reads.write.parquet(path)
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written"))
    return preprocess.report_of(spark, seen).crossJoin(F.broadcast(written))  # one row each


@query(_TRIMMED + f"SELECT l_orderkey, l_linenumber, both_s AS sequences, both_q AS quality FROM trimmed WHERE length(both_s) BETWEEN 10 AND 100 AND {_ERROR.format(q='both_q')} <= 0.005")
def preprocess_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.preprocess(_raw(spark, sf_dir), fx.CONST_5P, fx.CONST_3P)


@query("SELECT sequences, reverse(translate(sequences, 'ACGT', 'TGCA')) AS complement, length(sequences) AS length FROM ua")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = counts.count_unique(fx.reads(spark, sf_dir))
    return unique.select("sequences", sq.reverse_complement(F.col("sequences")).alias("complement"), F.length("sequences").cast("long").alias("length"))


@query("SELECT concat('Rank=', Rank, ';Reads=', Reads, ';RPU=', RPU) AS ID, replace(sequences, 'T', 'U') AS rna, sequences AS dna FROM counta")
def compose_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed identifiers, and U to T on RNA letters."""
    df = fx.population(spark, sf_dir).withColumn("rna", F.translate("sequences", "T", "U"))
    return df.select(sq.compose_id("Rank", "Reads", "RPU").alias("ID"), "rna", sq.u_to_t(F.col("rna")).alias("dna"))


@query("SELECT aligned, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 5 = 0 THEN replace(aligned, 'A', 'N') ELSE aligned END AS aligned FROM reads) WHERE NOT regexp_matches(aligned, '[^ACGT-]') GROUP BY aligned")
def alphabet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.reads(spark, sf_dir).select(F.when(F.col("l_orderkey") % 5 == 0, F.translate("aligned", "A", "N")).otherwise(F.col("aligned")).alias("aligned"))
    return df.where(sq.only_alphabet(F.col("aligned"), "dna")).groupBy("aligned").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sequences, CAST(levenshtein(sequences, aligned) AS INT) AS led, CAST(CASE WHEN levenshtein(aligned, ragged) <= 2 THEN levenshtein(aligned, ragged) ELSE -1 END AS INT) AS bounded FROM reads")
def levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.reads(spark, sf_dir)
    return df.select("sequences", sq.edit_distance(F.col("sequences"), F.col("aligned")).alias("led"), sq.edit_distance(F.col("aligned"), F.col("ragged"), 2).alias("bounded"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS value FROM lineitem", plain=True)
def numeric_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from text: unparsable and infinite ones are null."""
    text = F.when(F.col("l_linenumber") % 3 == 0, F.lit("n/a")).when(F.col("l_linenumber") % 3 == 1, F.lit("Infinity")).otherwise(F.col("l_quantity").cast("string"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", sq.to_number(text).alias("value"))


# counting


@query("SELECT sequences, count(*) AS Reads FROM reads GROUP BY sequences")
def count_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_unique(fx.reads(spark, sf_dir))


@query("SELECT sequences, Reads, row_number() OVER (ORDER BY Reads DESC, sequences) AS Rank FROM ua")
def count_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_rank(counts.count_unique(fx.reads(spark, sf_dir)))


@query("SELECT sequences, Reads, CAST(round_even(Reads / ((SELECT CAST(sum(Reads) AS DOUBLE) FROM ua) / 1e6), 0) AS BIGINT) AS RPU FROM ua")
def count_rpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_rpu(counts.count_unique(fx.reads(spark, sf_dir)))


@query("SELECT * FROM counta")
def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(fx.reads(spark, sf_dir).select("sequences"))


@query("SELECT count(*) AS unique_sequences, CAST(sum(Reads) AS BIGINT) AS total_reads FROM ua")
def population_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.population_totals(counts.count_unique(fx.reads(spark, sf_dir)))


@query(", um AS (SELECT sequences, CAST(sum(Reads) AS BIGINT) AS Reads FROM (SELECT * FROM u0 UNION ALL SELECT * FROM u1) GROUP BY sequences), " + fx.finished_sql("um", "merged") + " SELECT * FROM merged")
def recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.recount(*fx.populations(spark, sf_dir))


@query("SELECT Rank, Reads FROM counta WHERE Reads >= 10 AND Rank <= 1000")
def reads_per_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.reads_per_rank(fx.population(spark, sf_dir))


@query(", l AS (SELECT ragged AS sequences, count(*) AS Reads FROM reads GROUP BY ragged) SELECT CAST(length(sequences) AS INT) AS length, count(*) AS unique_count, CAST(sum(Reads) AS BIGINT) AS total_reads FROM l GROUP BY 1")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.length_histogram(counts.count_unique(fx.reads(spark, sf_dir).select(F.col("ragged").alias("sequences"))))


@query("""SELECT bin, sum(Reads)::DOUBLE / (SELECT sum(Reads) FROM ua)::DOUBLE AS fraction, count(*) AS unique_count FROM (
SELECT Reads, CASE WHEN Reads = 1 THEN 'Singleton' WHEN Reads < 10 THEN '1 < Reads < 10' WHEN Reads < 100 THEN '10 ≤ Reads < 100' WHEN Reads < 1000 THEN '100 ≤ Reads < 1000' ELSE '1000 ≤ Reads' END AS bin FROM ua) GROUP BY bin""")
def abundance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.abundance_bins(counts.count_unique(fx.reads(spark, sf_dir)))


# browsing


@query("SELECT * FROM counta WHERE concat_ws(' ', lower(ID), Rank, Reads, RPU, length) LIKE '%acgt%' OR lower(sequences) LIKE '%acgt%'")
def search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.search_any(fx.population(spark, sf_dir), "acgt")


@query("SELECT * FROM counta WHERE lower(sequences) LIKE '%gat%' AND Reads = 3")
def search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.search_columns(fx.population(spark, sf_dir), {"sequences": "GAT"}, {"Reads": 3})


@query("SELECT *, (SELECT CAST(ceil(count(*) / 25) AS BIGINT) FROM counta) AS total_pages FROM counta WHERE Rank BETWEEN 51 AND 75")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.page(fx.population(spark, sf_dir), ["Rank"], number=3, size=25)


@query("SELECT *, (SELECT CAST(ceil(count(*) / 25) AS BIGINT) FROM counta) AS total_pages FROM counta WHERE Rank BETWEEN 976 AND 1000")
def page_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 40 of a table that is sorted once for all pages."""
    return browse.Pages(fx.population(spark, sf_dir), [F.col("Rank")]).page(40, 25)


@query("SELECT DISTINCT Cluster FROM clustera")
def cluster_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.cluster_list(fx.clustered(fx.population(spark, sf_dir)))


@query("SELECT * FROM clustera WHERE Cluster IN (2, 7)")
def cluster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.cluster_filter(fx.clustered(fx.population(spark, sf_dir)), [2, 7])


# clustering and diversity


@query("SELECT ID, Rank, Reads, RPU, length, sequences, row_number() OVER (ORDER BY RPU DESC, Rank, sequences) AS place FROM counta WHERE Reads >= 3")
def cluster_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_input(fx.population(spark, sf_dir), 3).withColumnRenamed("_pos", "place")


def greedy_sql(total: int, keep_nc: bool, table: str = "counta") -> str:
    """Greedy clustering as a recursive CTE: seeds one after the other, then the first seed in reach of each sequence."""
    rest = "UNION ALL SELECT Rank, Reads, RPU, 0 AS Cluster, CAST(levenshtein(sequences, (SELECT min_by(sequences, pos) FROM found WHERE k IS NULL)) AS INT) AS LED, sequences, pos FROM found WHERE k IS NULL" if keep_nc else ""
    return f""", input AS (SELECT *, row_number() OVER (ORDER BY RPU DESC, Rank, sequences) AS pos FROM {table} WHERE Reads >= 10),
seeds AS (
  SELECT 1 AS k, pos, [sequences] AS seen FROM input WHERE pos = 1
  UNION ALL
  SELECT k + 1, pos, list_append(seen, sequences) FROM (
    SELECT s.k, s.seen, min(i.pos) AS pos, min_by(i.sequences, i.pos) AS sequences FROM seeds s JOIN input i ON i.pos > s.pos
    WHERE s.k < {total} AND len([x FOR x IN s.seen IF levenshtein(x, i.sequences) <= 7]) = 0 GROUP BY s.k, s.seen)),
best AS (SELECT max_by(seen, k) AS seen FROM seeds),
found AS (SELECT i.*, [x FOR x IN range(1, len(seen) + 1) IF levenshtein(seen[x], i.sequences) <= 7][1] AS k, seen FROM input i, best),
assigned AS (SELECT Rank, Reads, RPU, CAST(k AS INT) AS Cluster, CAST(levenshtein(seen[k], sequences) AS INT) AS LED, sequences, pos FROM found WHERE k IS NOT NULL {rest}),
greedy AS (SELECT Rank, Reads, RPU, Cluster, CAST(row_number() OVER (PARTITION BY Cluster ORDER BY pos) AS INT) AS RankInCluster, LED, sequences FROM assigned)
SELECT concat('Rank=', Rank, ';Reads=', Reads, ';RPU=', RPU, ';Cluster=', Cluster, ';RankInCluster=', RankInCluster, ';LED=', LED) AS ID, * FROM greedy"""


@query(greedy_sql(20, False), recursive=True)
def cluster_led(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_led(fx.population(spark, sf_dir), min_reads=10, total_clusters=20, keep_nc=False)


@query(greedy_sql(8, True), recursive=True)
def cluster_keep_nc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_led(fx.population(spark, sf_dir), min_reads=10, total_clusters=8, keep_nc=True)


@query("SELECT sequences, Cluster, RankInCluster FROM clustera")
def rank_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.clustered(fx.population(spark, sf_dir)).select("sequences", "Cluster", "RankInCluster")


_SID = "CASE WHEN sum(Reads) <= 1 THEN 0.0 ELSE round_even((1 - sum(Reads::DOUBLE * (Reads - 1)) / (sum(Reads)::DOUBLE * (sum(Reads)::DOUBLE - 1))) * 100, 0) / 100 END"
_DIVERSITY = f"""SELECT Cluster, count(*) AS TotalSequences, CAST(sum(Reads) AS BIGINT) AS TotalReads, CAST(sum(RPU) AS BIGINT) AS TotalRPU, round_even(avg(LED) * 100, 0) / 100 AS AverageLED, {_SID} AS SID,
max(CASE WHEN RankInCluster = 1 THEN ID END) AS ID, max(CASE WHEN RankInCluster = 1 THEN sequences END) AS sequences FROM clustera GROUP BY Cluster"""


@query(_DIVERSITY)
def cluster_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.cluster_diversity(fx.clustered(fx.population(spark, sf_dir)))


@query(f"SELECT Cluster, {_SID} AS SID FROM clustera GROUP BY Cluster")
def simpson_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.clustered(fx.population(spark, sf_dir)).groupBy("Cluster").agg(diversity.simpson_index(F.col("Reads")).alias("SID"))


@query("SELECT Cluster, ID, sequences FROM clustera WHERE RankInCluster = 1")
def cluster_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_seeds(fx.clustered(fx.population(spark, sf_dir)))


@query(f"SELECT Cluster, TotalSequences, TotalReads, AverageLED FROM ({_DIVERSITY})")
def cluster_metaplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.cluster_metaplot(fx.clustered(fx.population(spark, sf_dir)))


@query("SELECT sequences, kmer, count(*) AS n FROM (SELECT sequences, unnest([substring(sequences, i, 4) FOR i IN range(1, length(sequences) - 2)]) AS kmer FROM ua) GROUP BY ALL")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.kmer_counts(counts.count_unique(fx.reads(spark, sf_dir)), 4)


@query("""SELECT sequences, place, count(*)::DOUBLE AS n FROM (SELECT sequences, CAST(16 * (instr('ATGC', substring(sequences, i, 1)) - 1) + 4 * (instr('ATGC', substring(sequences, i + 1, 1)) - 1) + instr('ATGC', substring(sequences, i + 2, 1)) - 1 AS INT) AS place
FROM (SELECT sequences, unnest(range(1, length(sequences) - 1)) AS i FROM ua)) GROUP BY ALL""")
def kmer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each sparse vector of 3-mers that are not 0, by their place in it."""
    from pyspark.ml.functions import vector_to_array

    v = kmer.kmer_vectors(counts.count_unique(fx.reads(spark, sf_dir)), 3)
    return v.select("sequences", F.posexplode(vector_to_array("features")).alias("place", "n")).where("n <> 0")


@query()
def kmer_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.kmer_pca(fx.population(spark, sf_dir), 3)


@query(""", words AS (SELECT concat(a, b, c) AS kmer FROM (SELECT unnest(['A', 'T', 'G', 'C']) AS a), (SELECT unnest(['A', 'T', 'G', 'C']) AS b), (SELECT unnest(['A', 'T', 'G', 'C']) AS c)),
n AS (SELECT sequences, kmer, count(*)::DOUBLE AS n FROM (SELECT sequences, unnest([substring(sequences, i, 3) FOR i IN range(1, length(sequences) - 1)]) AS kmer FROM counta) GROUP BY ALL),
spread AS (SELECT kmer, sqrt((sum(n * n) - sum(n) * sum(n) / (SELECT count(*) FROM counta)) / ((SELECT count(*) FROM counta) - 1)) AS s FROM n GROUP BY kmer),
vec AS (SELECT sequences, Rank, list(coalesce(n.n / nullif(s, 0), 0) ORDER BY kmer)::DOUBLE[64] AS v FROM counta CROSS JOIN words LEFT JOIN n USING (sequences, kmer) LEFT JOIN spread USING (kmer) GROUP BY ALL),
pairs AS (SELECT q.sequences AS query, d.sequences AS neighbor, round_even(array_distance(q.v, d.v) * 1e6, 0) / 1e6 AS distance FROM vec q JOIN vec d ON q.sequences <> d.sequences WHERE q.Rank % 100 = 0)
SELECT query, neighbor, distance, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS place FROM pairs) WHERE place <= 15""")
def kmer_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every hundredth sequence by rank among all sequences, exactly."""
    df = fx.population(spark, sf_dir)
    return kmer.kmer_neighbors(df.where("Rank % 100 = 0"), df, exact=True)


@query()
def kmer_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of all sequences that clustering takes, with their clusters."""
    clustered = stored(cluster_keep_nc(spark, sf_dir), "clustered")
    return layout.kmer_layout(clustered, 4, epochs=20, exact=True).join(clustered.select("sequences", "Cluster"), "sequences")


@query("SELECT Cluster, count(*) AS count FROM clustera WHERE Cluster IN (1, 2, 3) GROUP BY Cluster")
def kmer_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.kmer_cluster_summary(fx.clustered(fx.population(spark, sf_dir)), [1, 2, 3])


# two populations

_ENRICHED = """SELECT sequences, a.ID AS ID_a, coalesce(a.Rank, 0) AS Rank_a, coalesce(a.Reads, 0) AS Reads_a, coalesce(a.RPU, 0) AS RPU_a, b.ID AS ID_b, coalesce(b.Rank, 0) AS Rank_b, coalesce(b.Reads, 0) AS Reads_b, coalesce(b.RPU, 0) AS RPU_b,
CASE WHEN coalesce(a.RPU, 0) > 0 THEN round_even(coalesce(b.RPU, 0) / a.RPU * 1000, 0) / 1000 WHEN coalesce(b.RPU, 0) > 0 THEN 999.999 ELSE 0 END::DOUBLE AS Enrichment,
CASE WHEN coalesce(a.RPU, 0) > 0 AND coalesce(b.RPU, 0) > 0 THEN round_even(log2(b.RPU / a.RPU) * 1000, 0) / 1000 WHEN coalesce(b.RPU, 0) > 0 THEN 20 ELSE -20 END::DOUBLE AS log2E
FROM count0 a {join} JOIN count1 b USING (sequences)"""


def _enriched(spark: SparkSession, sf_dir: str, keep_na: bool) -> DataFrame:
    return compare.enrich(*fx.populations(spark, sf_dir), keep_na)


@query(_ENRICHED.format(join="INNER"))
def enrich_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir, False)


@query(_ENRICHED.format(join="FULL"))
def enrich_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir, True)


@query(f"""SELECT min(Enrichment) AS enrichment_min, max(Enrichment) AS enrichment_max, round_even(avg(Enrichment) * 1e6, 0) / 1e6 AS enrichment_mean, median(Enrichment) AS enrichment_median, round_even(stddev_samp(Enrichment) * 1e6, 0) / 1e6 AS enrichment_std,
min(log2E) AS log2e_min, max(log2E) AS log2e_max, round_even(avg(log2E) * 1e6, 0) / 1e6 AS log2e_mean, median(log2E) AS log2e_median, round_even(stddev_samp(log2E) * 1e6, 0) / 1e6 AS log2e_std,
count_if(RPU_b = 0)::BIGINT AS only_a, count_if(RPU_a = 0)::BIGINT AS only_b, count_if(RPU_a > 0 AND RPU_b > 0)::BIGINT AS in_both, count_if(Enrichment > 10)::BIGINT AS highly_enriched, count_if(Enrichment < 0.1)::BIGINT AS highly_depleted FROM ({_ENRICHED.format(join='FULL')})""")
def enrich_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.enrich_stats(_enriched(spark, sf_dir, True))
    return out.withColumns({c: sq.rint_to(F.col(c), 6) for c in out.columns if c.endswith(("_mean", "_std"))})


@query(f"SELECT * FROM ({_ENRICHED.format(join='INNER')}) ORDER BY Enrichment DESC NULLS LAST, sequences LIMIT 50")
def top_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.top_enriched(_enriched(spark, sf_dir, False), 50)


_MATRIX = "(SELECT a.Cluster AS c1, b.Cluster AS c2, CAST(levenshtein(a.sequences, b.sequences) AS INT) AS led FROM cluster0 a, cluster1 b WHERE a.RankInCluster = 1 AND b.RankInCluster = 1)"
_RECLUSTER = f""", candidates AS (SELECT c1, min_by(c2, led * 100000 + c2) AS c2, min(led) AS led FROM {_MATRIX} WHERE led < 7 GROUP BY c1),
claimed AS (SELECT c2, max(c1) AS new FROM candidates GROUP BY c2),
fresh AS (SELECT Cluster AS c2, (SELECT max(Cluster) FROM cluster0) + row_number() OVER (ORDER BY Cluster) AS new FROM (SELECT DISTINCT Cluster FROM cluster1) WHERE Cluster NOT IN (SELECT c2 FROM claimed)),
ids AS (SELECT * FROM claimed UNION ALL SELECT * FROM fresh),
moved AS (SELECT b.* REPLACE (CAST(new AS INT) AS Cluster) FROM cluster1 b JOIN ids ON ids.c2 = b.Cluster),
joined AS (SELECT sequences, a.ID AS ID_a, a.Rank AS Rank_a, a.Reads AS Reads_a, a.RPU AS RPU_a, b.ID AS ID_b, b.Rank AS Rank_b, b.Reads AS Reads_b, b.RPU AS RPU_b, coalesce(a.Cluster, b.Cluster) AS Cluster,
  CASE WHEN a.RPU > 0 THEN round_even(b.RPU / a.RPU * 1000, 0) / 1000 END AS Enrichment, CASE WHEN a.RPU > 0 AND b.RPU > 0 THEN round_even(log2(b.RPU / a.RPU) * 1000, 0) / 1000 END AS log2E
  FROM cluster0 a FULL JOIN moved b USING (sequences)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY Cluster ORDER BY Enrichment DESC NULLS LAST, sequences) AS INT) AS RankInCluster FROM joined),
led AS (SELECT r.*, CAST(levenshtein(r.sequences, s.sequences) AS INT) AS LED FROM ranked r JOIN ranked s ON s.Cluster = r.Cluster AND s.RankInCluster = 1)
"""


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = fx.populations(spark, sf_dir)
    return stored(fx.clustered(a), "a"), stored(fx.clustered(b), "b")


@query(f"SELECT * FROM {_MATRIX}")
def led_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.led_matrix(*_pair(spark, sf_dir))


@query(f"SELECT min(led) AS min, max(led) AS max, avg(led) AS mean, median(led) AS median, round_even(stddev_pop(led) * 1e6, 0) / 1e6 AS std, count_if(led <= 7)::BIGINT AS below_count, count_if(led <= 7) * 100.0::DOUBLE / count(*) AS below_percent FROM {_MATRIX}")
def led_matrix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.led_matrix_stats(compare.led_matrix(*_pair(spark, sf_dir)), 7).withColumn("std", sq.rint_to(F.col("std"), 6))


@query(_RECLUSTER + "SELECT c1, c2, led FROM candidates")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.nearest_clusters(*_pair(spark, sf_dir))


@query(_RECLUSTER + "SELECT *, 1 AS Population FROM cluster0 UNION ALL SELECT *, 2 FROM moved")
def merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark, sf_dir)
    return compare.merge_clusters(a, b, compare.nearest_clusters(a, b))


@query(_RECLUSTER + "SELECT * FROM joined")
def recluster_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.recluster_enrich(merge_clusters(spark, sf_dir))


@query(_RECLUSTER + "SELECT sequences, Cluster, Enrichment, RankInCluster FROM ranked")
def recluster_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.recluster_rank(recluster_enrich(spark, sf_dir)).select("sequences", "Cluster", "Enrichment", "RankInCluster")


@query(_RECLUSTER + "SELECT sequences, Cluster, RankInCluster, LED FROM led")
def recluster_led(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.recluster_led(compare.recluster_rank(recluster_enrich(spark, sf_dir))).select("sequences", "Cluster", "RankInCluster", "LED")


@query(_RECLUSTER + "SELECT * FROM led")
def recluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.recluster(*_pair(spark, sf_dir))


# alignments and profiles


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.reads(spark, sf_dir).select(F.col("aligned").alias("sequences"))


_LONG = "(SELECT seq, p AS Position, substring(seq, p, 1) AS Residue FROM (SELECT aligned AS seq, unnest(range(1, length(aligned) + 1)) AS p FROM reads))"


@query(", ur AS (SELECT ragged AS sequences, count(*) AS Reads FROM reads GROUP BY ragged), " + fx.finished_sql("ur", "countr") + greedy_sql(20, False, "countr").replace("SELECT concat('Rank='", ", g AS (SELECT concat('Rank='") + ") SELECT ID, Cluster, Rank, sequences, 1::BIGINT AS lengths FROM g", recursive=True)
def cluster_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged sequences with 10 reads or more, aligned in their clusters: what each is without gaps, and the number of different lengths in its cluster."""
    c = counts.count(fx.reads(spark, sf_dir).select(F.col("ragged").alias("sequences")))
    out = stored(align.cluster_align(cluster.cluster_led(c, min_reads=10, total_clusters=20, keep_nc=False)), "aligned")
    lengths = out.groupBy("Cluster").agg(F.count_distinct(F.length("sequences")).alias("lengths"))
    return out.join(lengths, "Cluster").select("ID", "Cluster", "Rank", F.replace("sequences", F.lit("-"), F.lit("")).alias("sequences"), "lengths")


@query(""", l AS (SELECT Cluster, p, substring(aligned, p, 1) AS c FROM (SELECT CAST(4 * (instr('ACGT', substring(sequences, 3, 1)) - 1) + instr('ACGT', substring(sequences, 5, 1)) AS INT) AS Cluster, aligned, unnest(range(1, length(aligned) + 1)) AS p FROM reads)),
n AS (SELECT Cluster, p, c, count(*)::DOUBLE AS n FROM l GROUP BY ALL),
pairs AS (SELECT a.Cluster, sum(CASE WHEN a.c = '-' AND b.c = '-' THEN 0 WHEN a.c = '-' OR b.c = '-' THEN -2 * a.n * b.n WHEN a.c = b.c THEN a.n * (a.n - 1) ELSE -a.n * b.n END) AS score
  FROM n a JOIN n b ON b.p = a.p AND b.Cluster = a.Cluster AND a.c <= b.c GROUP BY a.Cluster)
SELECT Cluster, score::DOUBLE AS score FROM pairs""")
def alignment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-of-pairs score of the aligned reads of each cluster."""
    base = lambda k: F.expr(f"instr('ACGT', substring(sequences, {k}, 1))")
    return align.alignment_score(fx.reads(spark, sf_dir).select((4 * (base(3) - 1) + base(5)).cast("int").alias("Cluster"), F.col("aligned").alias("sequences")))


@query("SELECT CAST(4 * (instr('ACGT', substring(sequences, 3, 1)) - 1) + instr('ACGT', substring(sequences, 5, 1)) AS INT) AS Cluster, count(DISTINCT length(ragged)) AS lengths, count(DISTINCT length(ragged)) = 1 AS aligned FROM reads GROUP BY 1")
def msa_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lambda k: F.expr(f"instr('ACGT', substring(sequences, {k}, 1))")
    return align.msa_check(fx.reads(spark, sf_dir).select((4 * (base(3) - 1) + base(5)).cast("int").alias("Cluster"), F.col("ragged").alias("sequences")))


@query(f"SELECT CAST(Position AS INT) AS Position, Residue, count(*) AS n FROM {_LONG} GROUP BY ALL")
def residue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.residue_positions(_aligned(spark, sf_dir)).groupBy("Position", "Residue").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CAST(Position AS INT) AS Position, round_even((ln(sum(n)) - sum(n * ln(n)) / sum(n)) * 1e6, 0) / 1e6 AS entropy FROM (SELECT Position, Residue, count(*)::DOUBLE AS n FROM {_LONG} GROUP BY ALL) GROUP BY Position")
def column_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.column_entropy(_aligned(spark, sf_dir))


@query(""", d AS (SELECT aligned AS seq, count(*)::DOUBLE AS w, row_number() OVER () AS k FROM reads GROUP BY aligned),
l AS (SELECT k, w, p, substring(seq, p, 1) AS c FROM (SELECT k, w, seq, unnest(range(1, length(seq) + 1)) AS p FROM d)),
joint AS (SELECT x.p AS i, y.p AS j, x.c AS a, y.c AS b, sum(x.w) AS n FROM l x JOIN l y USING (k) GROUP BY ALL),
single AS (SELECT p, c, sum(w) AS n FROM l GROUP BY ALL)
SELECT i, j, round_even(sum(joint.n / t * ln(joint.n * t / (s.n * r.n))) * 1e6, 0) / 1e6 AS mi FROM joint JOIN single s ON s.p = i AND s.c = a JOIN single r ON r.p = j AND r.c = b, (SELECT sum(w) AS t FROM d) GROUP BY ALL""")
def column_mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.column_mutual_info(_aligned(spark, sf_dir))


_POSITIONS = _RECLUSTER + """, picked AS (SELECT sequences AS seq, Enrichment FROM led WHERE Cluster = 6 AND Enrichment IS NOT NULL),
chars AS (SELECT p, substring(seq, p, 1) AS c, Enrichment FROM (SELECT seq, Enrichment, unnest(range(1, length(seq) + 1)) AS p FROM picked)),
means AS (SELECT p, c, round_even(avg(Enrichment) * 1000, 0) / 1000 AS e FROM chars GROUP BY ALL),
positions AS (SELECT c AS Residue, CAST(p AS INT) AS Position, e AS AvEnrich FROM (SELECT unnest(['A', 'C', 'G', 'T', '-']) AS c) CROSS JOIN (SELECT unnest(range(1, 33)) AS p) LEFT JOIN means USING (p, c))
"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.position_enrichment(recluster(spark, sf_dir), 6)


@query(_POSITIONS + "SELECT * FROM positions")
def position_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir)


@query(_POSITIONS + "SELECT Residue, " + ", ".join(f'max(CASE WHEN Position = {p} THEN AvEnrich END) AS p{p}' for p in range(1, 33)) + " FROM positions GROUP BY Residue")
def position_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.position_matrix(_positions(spark, sf_dir), 32)
    return out.select("Residue", *[F.col(f"`{p}`").alias(f"p{p}") for p in range(1, 33)])


@query(_POSITIONS + "SELECT min(AvEnrich) AS min, max(AvEnrich) AS max, round_even(avg(AvEnrich) * 1e6, 0) / 1e6 AS mean, median(AvEnrich) AS median, count(DISTINCT Position) AS positions, count(AvEnrich) AS cells FROM positions")
def position_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.position_stats(_positions(spark, sf_dir))


_EMISSIONS = f""", cols AS (SELECT Position AS col, count(*) AS total, count_if(Residue = '-') AS gaps, count_if(Residue <> '-') AS present FROM {_LONG} GROUP BY 1),
matches AS (SELECT *, row_number() OVER (ORDER BY col) AS match_state FROM cols WHERE gaps / total < 0.5),
emitted AS (SELECT CAST(match_state AS INT) AS match_state, CAST(col AS INT) AS col, residue, (coalesce(n, 0) + 1.0) / (present + 5.0) AS p FROM matches CROSS JOIN (SELECT unnest(['a', 'c', 'g', 't', 'n']) AS residue)
  LEFT JOIN (SELECT Position AS col, lower(Residue) AS residue, count(*) AS n FROM {_LONG} GROUP BY 1, 2) USING (col, residue))
"""


@query(_EMISSIONS + "SELECT match_state, col, residue, p::DOUBLE AS p, round_even(p / sum(p) OVER (PARTITION BY match_state) * 1e9, 0) / 1e9 AS p_normalized FROM emitted")
def profile_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_emissions(_aligned(spark, sf_dir)).withColumn("p_normalized", sq.rint_to(F.col("p_normalized"), 9))


@query(_EMISSIONS + """, steps AS (SELECT col AS a, lead(col) OVER (ORDER BY col) AS b FROM matches),
tests AS (SELECT substring(aligned, a, 1) <> '-' AS here, substring(aligned, b, 1) <> '-' AS there, length(replace(substring(aligned, a + 1, b - a - 1), '-', '')) > 0 AS inner_ FROM reads, steps WHERE b IS NOT NULL),
n AS (SELECT count_if(here AND there)::DOUBLE AS x, count_if(here AND NOT there)::DOUBLE AS y, count_if(here AND inner_)::DOUBLE AS z FROM tests)
SELECT x / (x + y + z) AS mm, y / (x + y + z) AS md, z / (x + y + z) AS mi FROM n""")
def profile_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_transitions(_aligned(spark, sf_dir))


@query(_EMISSIONS + "SELECT match_state, col, residue, p::DOUBLE AS p, round_even(p / sum(p) OVER (PARTITION BY match_state) * 1e9, 0) / 1e9 AS p_normalized FROM emitted")
def profile_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions of a fitted profile that was saved and loaded."""
    path = new_path(spark, "profile")
    profile.Profile().fit(_aligned(spark, sf_dir)).save(path)
    return profile.ProfileModel.load(path).emissions.withColumn("p_normalized", sq.rint_to(F.col("p_normalized"), 9))


@query(_EMISSIONS + """, d AS (SELECT aligned AS seq, count(*) AS n FROM reads GROUP BY aligned)
SELECT seq AS sequences, n, round_even(sum(ln(e.p)) * 1e6, 0) / 1e6 AS log_likelihood FROM d, emitted e WHERE lower(substring(seq, e.col, 1)) = e.residue GROUP BY seq, n""")
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of each distinct aligned read under the profile of all."""
    reads = _aligned(spark, sf_dir)
    scored = profile.Profile().fit(reads).transform(reads.groupBy("sequences").agg(F.count(F.lit(1)).alias("n")))
    return scored.withColumn("log_likelihood", sq.rint_to(F.col("log_likelihood"), 6))


@query(_EMISSIONS + "SELECT (SELECT count(*) FROM reads) AS num_sequences, (SELECT count(*) FROM cols) AS alignment_length, (SELECT count(*) FROM matches) AS num_match_states")
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_stats(_aligned(spark, sf_dir))
