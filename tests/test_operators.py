"""Hand-computed micro-tables and invariants."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from oligoflow.functions import sequences as sq
from oligoflow.operators import align, browse, cluster, compare, counts, diversity, kmer, preprocess, profile
from oligoflow.sources import files
from oligoflow.storage import job, numbered, numbered_within


def reads(spark, *seqs):
    return spark.createDataFrame([(s,) for s in seqs], "sequences string")


def table(spark, rows):
    """Counts rows (sequence, reads) as a counts table."""
    return counts.finished(spark.createDataFrame(rows, "sequences string, Reads long"))


def test_count_strips_cr_and_breaks_ties_by_sequence(spark):
    got = counts.count(reads(spark, "CC\r", "CC", "AA", "AA", "acgu", None), scaling=100).orderBy("Rank").collect()
    assert [(r.sequences, r.Reads, r.Rank, r.RPU, r.length) for r in got] == [("AA", 2, 1, 40, 2), ("CC", 2, 2, 40, 2), ("acgu", 1, 3, 20, 4)]
    assert got[0].ID == "Rank=1;Reads=2;RPU=40"


def test_empty_counts(spark):
    assert counts.count(reads(spark, "A").limit(0)).count() == 0
    assert counts.population_totals(table(spark, [("A", 1)]).limit(0)).first().asDict() == {"unique_sequences": 0, "total_reads": 0}


def test_jobs_delete_their_tables(spark, tmp_path):
    import os

    with job(spark) as folder:
        out = numbered(spark.range(50), [F.col("id").desc()], "n")
        assert os.listdir(folder.removeprefix("file://"))
        out.write.parquet(str(tmp_path / "out"))
    assert not os.path.exists(folder.removeprefix("file://")) and spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_numbering_equals_a_window(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 101).alias("a"), "id")
    got = {r.id: r.n for r in numbered(df, [F.col("a").desc(), F.col("id")], "n").collect()}
    want = sorted(got, key=lambda i: (-(i * 7919 % 101), i))
    assert [got[i] for i in want] == list(range(1, 5001))


def test_numbering_within_groups_writes_its_rows_once(spark):
    import os

    df = spark.range(3000).select(F.expr("nullif(id % 7, 3)").alias("g"), (F.col("id") * 7919 % 101).alias("a"), "id")
    with job(spark) as folder:
        got = [tuple(r) for r in numbered_within(df, "g", [F.col("a").desc(), F.col("id")], "n").collect()]
        assert len(os.listdir(folder.removeprefix("file://"))) == 1
    assert len(got) == 3000
    for g in (None, 0, 1, 2, 4, 5, 6):
        mine = sorted((n, -a, i) for h, a, i, n in got if h == g)
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda x: x[1:])


def test_reverse_complement_iupac(spark):
    got = reads(spark, "ACGTURYSWKMBDHVN", "acgn-").select(sq.reverse_complement(F.col("sequences")).alias("x")).collect()
    assert [r.x for r in got] == ["NBDHVKMWSRYAACGT", "-ncgt"]


def test_recount_conserves_reads(spark):
    a, b = table(spark, [("A", 3), ("C", 1)]), table(spark, [("C", 5), ("G", 2)])
    got = {r.sequences: (r.Reads, r.Rank) for r in counts.recount(a, b).collect()}
    assert got == {"C": (6, 1), "A": (3, 2), "G": (2, 3)}


def test_abundance_at_breakpoints(spark):
    df = table(spark, [("A", 1), ("C", 2), ("G", 10), ("T", 100), ("AA", 1000)])
    got = {r.bin: r.unique_count for r in counts.abundance_bins(df).collect()}
    assert got == {"Singleton": 1, "1 < Reads < 10": 1, "10 ≤ Reads < 100": 1, "100 ≤ Reads < 1000": 1, "1000 ≤ Reads": 1}
    assert {r.bin for r in counts.abundance_bins(df, singleton=False).collect()} == {"1 < Reads < 10", "10 ≤ Reads < 100", "100 ≤ Reads < 1000", "1000 ≤ Reads"}


def test_trims(spark):
    df = spark.createDataFrame([("ACGTTACGTATTTTGGATCCTTAA",), ("ACGTTCGTATTTTGGATCCTTAA",), ("TTTT",), ("",)], "sequences string").withColumn("quality", F.expr("repeat('I', length(sequences))"))
    got = preprocess.trim_3p(preprocess.trim_5p(df, "ACGTTACGTA"), "GGATCCTTAA").collect()
    assert [r.sequences for r in got] == ["TTTT", "TTTT", "TTTT", ""]
    assert [len(r.quality) for r in got] == [4, 4, 4, 0]
    assert preprocess.preprocess(df, "ACGTTACGTA", "GGATCCTTAA", least=0).count() == 3  # the empty read has no quality
    best = preprocess.preprocess(df, "ACGTTACGTA", "GGATCCTTAA", least=0, ends="best").collect()
    assert best[0].sequences == "TTTTGGATCCTTAA"


def test_quality_and_excision(spark):
    df = spark.createDataFrame([("AC", "I+"), ("AC", "II")], "sequences string, quality string")
    assert [r.e for r in df.select(sq.mean_error(F.col("quality")).alias("e")).collect()] == pytest.approx([(1e-4 + 0.1) / 2, 1e-4])
    assert preprocess.quality_filter(df).count() == 1
    df = spark.createDataFrame([("TTTTACGTACGTCCCC", "0123456789abcdef"), ("CCCC", "IIII")], "sequences string, quality string")
    got = preprocess.excise_region(df, "ACGTACGT").collect()  # the match may take an edit, so it begins one base early
    assert [(r.sequences, r.quality) for r in got] == [("TTTCCCC", "012cdef"), ("CCCC", "IIII")]


def test_search(spark):
    df = table(spark, [("ACGT", 3), ("GGGG", 12)])
    assert browse.search_any(df, "cg").count() == 1
    assert browse.search_columns(df, {"sequences": "g"}, {"Reads": 12}).count() == 1
    assert browse.page(df, ["Rank"], 2, 1).first().total_pages == 2


def test_clusters_partition_the_input(spark):
    rows = [("A" * 12, 50), ("A" * 11 + "C", 40), ("G" * 12, 30), ("G" * 5 + "A" * 7, 20), ("T" * 12, 11), ("C" * 12, 9)]
    df = table(spark, rows)
    got = {r.sequences: (r.Cluster, r.RankInCluster, r.LED) for r in cluster.cluster_led(df, min_reads=10, max_led=7, total_clusters=2).collect()}
    assert got == {"A" * 12: (1, 1, 0), "A" * 11 + "C": (1, 2, 1), "G" * 12: (2, 1, 0), "G" * 5 + "A" * 7: (1, 3, 5), "T" * 12: (0, 1, 0)}
    assert cluster.cluster_led(df, min_reads=10, total_clusters=2, keep_nc=False).count() == 4
    assert cluster.cluster_led(df.limit(0)).count() == 0


def test_simpson_and_diversity(spark):
    df = spark.createDataFrame([(1, "a", "AC", 2, 20, 1, 0), (1, "b", "AG", 1, 10, 2, 1), (2, "c", "TT", 1, 10, 1, 0)], "Cluster int, ID string, sequences string, Reads long, RPU long, RankInCluster int, LED int")
    got = diversity.cluster_diversity(df).collect()
    assert [(r.Cluster, r.TotalSequences, r.TotalReads, r.AverageLED, r.SID, r.sequences) for r in got] == [(1, 2, 3, 0.5, 0.67, "AC"), (2, 1, 1, 0.0, 0.0, "TT")]


def test_kmers(spark):
    got = {(r.sequences, r.kmer): r.n for r in kmer.kmer_counts(reads(spark, "aaaN", "AC", "AAAA"), 3).collect()}
    assert got == {("aaaN", "AAA"): 1, ("AAAA", "AAA"): 2}
    with pytest.raises(ValueError):
        kmer.kmer_counts(reads(spark, "A"), 9)


def test_pca_explains(spark):
    df = reads(spark, "ACGTACGT", "ACGTTTTT", "GGGGACGT", "CCCCCCCC", "ACACACAC")
    got = kmer.kmer_pca(df, 2).collect()
    assert len(got) == 5 and abs(sum(r.PC1 for r in got)) < 1e-9 and got[0].explained1 >= got[0].explained2 > 0


@pytest.mark.parametrize("limit", [1024, 0])
def test_pca_against_numpy(spark, monkeypatch, limit):
    import itertools
    import random

    import numpy as np

    monkeypatch.setattr(kmer, "COVARIANCE_COLUMNS", limit)
    rng = random.Random(9)
    seqs = ["".join(rng.choice("AC" if k % 3 else "GT") for _ in range(30)) + "ACGT" for k in range(60)]
    got = {r.sequences: r for r in kmer.kmer_pca(reads(spark, *seqs), 2).collect()}
    words = ["".join(w) for w in itertools.product("ATGC", repeat=2)]
    x = np.array([[sum(s[i : i + 2] == w for i in range(len(s) - 1)) for w in words] for s in seqs], float)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    values, vectors = np.linalg.eigh(z.T @ z)
    for c in (0, 1):
        v = vectors[:, -1 - c] * np.sign(vectors[np.abs(vectors[:, -1 - c]).argmax(), -1 - c])
        assert [got[s][f"PC{c + 1}"] for s in seqs] == pytest.approx((z @ v).tolist(), abs=1e-4)
        assert got[seqs[0]][f"explained{c + 1}"] == pytest.approx(100 * values[-1 - c] / values.sum(), abs=0.02)


def test_neighbours(spark, monkeypatch):
    import random

    monkeypatch.setattr(kmer, "BLOCK_ROWS", 7)
    rng = random.Random(4)
    seqs = sorted({"".join(rng.choice("ACGT") for _ in range(20)) for _ in range(60)})
    df = reads(spark, *seqs).repartition(3)
    exact = kmer.kmer_neighbors(reads(spark, *seqs[:5]), df, neighbors=6, exact=True).collect()
    assert len(exact) == 30 and all(r.query != r.neighbor for r in exact)
    near = kmer.kmer_neighbors(reads(spark, *seqs[:5]), df, neighbors=6).collect()
    alike = {(r.query, r.neighbor) for r in exact} & {(r.query, r.neighbor) for r in near}
    assert len(near) == 30 and len(alike) >= 27
    none = kmer.kmer_neighbors(reads(spark, *seqs[:5]), df, neighbors=6, reach=1e-3).collect()  # nothing in reach: compared with all
    assert {tuple(r) for r in none} == {tuple(r) for r in exact}


def test_enrichment_zeros(spark):
    a = table(spark, [("A", 4), ("C", 6)])
    b = table(spark, [("C", 3), ("G", 7)]).withColumn("RPU", F.when(F.col("sequences") == "C", 0).otherwise(F.col("RPU")).cast("long"))
    got = {r.sequences: (r.Enrichment, r.log2E) for r in compare.enrich(a, b, keep_na=True).collect()}
    assert got == {"A": (0.0, -20.0), "C": (0.0, -20.0), "G": (999.999, 20.0)}
    assert compare.enrich_stats(compare.enrich(a, b, True).limit(0)).first().enrichment_mean == 0.0


def test_merge_ties_and_conflicts(spark):
    m = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (2, 1, 2), (2, 2, 9), (3, 1, 7)], "c1 int, c2 int, led int")
    got = sorted((r.c1, r.c2) for r in compare.merge_candidates(m, 7).collect())
    assert got == [(1, 1), (2, 1)]
    assert compare.led_matrix_stats(m, 7).first().below_count == 4
    one = lambda seqs: cluster.with_ids(spark.createDataFrame([(s, c, 1, 1, 5, 5, 0) for s, c in seqs], "sequences string, Cluster int, RankInCluster int, Rank long, Reads long, RPU long, LED int"))
    a, b = one([("AAAA", 1), ("CCCC", 2)]), one([("CCCC", 1), ("GGGG", 5)])
    merged = compare.merge_clusters(a, b, compare.merge_candidates(m, 7))
    assert {(r.sequences, r.Cluster) for r in merged.where("Population = 2").collect()} == {("CCCC", 2), ("GGGG", 3)}


def test_alignment_degaps_to_input(spark):
    seqs = ["ACGTACGTAC", "ACGTCGTAC", "ACGTTACGTAC", "ACGTACGAC"]
    df = spark.createDataFrame([(s, 1, k + 1, k + 1) for k, s in enumerate(seqs)], "sequences string, Cluster int, RankInCluster int, Rank int")
    got = [r.sequences for r in align.cluster_align(df).collect()]
    assert [g.replace("-", "") for g in got] == seqs
    assert len({len(g) for g in got}) == 1
    assert align.msa_check(df).first().aligned is False
    with pytest.raises(ValueError):
        align.require_aligned(df)


def test_entropy_and_information(spark):
    df = reads(spark, "AC-", "AG-", "AC-", "AG-")
    assert [r.entropy for r in align.column_entropy(df).collect()] == [0.0, round(math.log(2), 6), 0.0]
    mi = {(r.i, r.j): r.mi for r in align.column_mutual_info(reads(spark, "AC", "CA", "AC", "CA")).collect()}
    assert mi == {k: round(math.log(2), 6) for k in [(1, 1), (1, 2), (2, 1), (2, 2)]}


def test_ragged_positions(spark):
    df = spark.createDataFrame([("ACGU", 1, 2.0), ("ACG", 1, 1.0), ("ACGN", 1, 9.0), ("ACGT", 2, 9.0), ("ACGA", 1, None)], "sequences string, Cluster int, Enrichment double")
    got = {(r.Residue, r.Position): r.AvEnrich for r in align.position_enrichment(df, 1).collect() if r.AvEnrich is not None}
    assert got == {("A", 1): 1.5, ("C", 2): 1.5, ("G", 3): 1.5, ("T", 4): 2.0, ("-", 4): 1.0}
    with pytest.raises(ValueError):
        align.position_enrichment(df, 7)
    top = {(r.Residue, r.Position): r.AvEnrich for r in align.position_enrichment(df, 1, max_sequences=1).collect() if r.AvEnrich is not None}
    assert top == {("A", 1): 2.0, ("C", 2): 2.0, ("G", 3): 2.0, ("T", 4): 2.0}


def test_profile(spark):
    df = reads(spark, "A-C", "A-C", "AGC", "--C")
    got = {(r.match_state, r.residue): r.p for r in profile.profile_emissions(df, "none").collect()}
    assert got[1, "a"] == 1.0 and got[2, "c"] == 1.0 and len(got) == 10
    t = profile.profile_transitions(df).first()
    assert (t.mm, t.md, t.mi) == (0.75, 0.0, 0.25)
    assert profile.profile_transitions(reads(spark, "A")).first().mm == 0.9
    assert profile.profile_stats(df).first().asDict() == {"num_sequences": 4, "alignment_length": 3, "num_match_states": 2}


def test_profile_is_fitted_saved_and_loaded(spark, tmp_path):
    df = reads(spark, "A-C", "A-C", "AGC", "--C")
    model = profile.Profile(method="none").fit(df.withColumn("p", F.lit("clash")).unionByName(df.limit(1).withColumns({"sequences": F.lit(None).cast("string"), "p": F.lit("x")})))
    model.save(str(tmp_path / "m"))
    with pytest.raises(Exception, match="exist"):
        model.save(str(tmp_path / "m"))
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = profile.ProfileModel.load(str(tmp_path / "m"))
    assert loaded.uid == model.uid and loaded.getOrDefault("method") == "none"
    for name in ("emissions", "transitions", "stats"):
        assert sorted(map(tuple, getattr(loaded, name).collect())) == sorted(map(tuple, getattr(model, name).collect()))
    got = {r.sequences: r.log_likelihood for r in loaded.transform(reads(spark, "A-C", "a-G", "---", "AAC")).collect()}
    assert got == {"A-C": 0.0, "a-G": -math.inf, "---": None, "AAC": 0.0}
    laplace = profile.Profile().fit(df).transform(reads(spark, "A-C")).first().log_likelihood
    assert laplace == pytest.approx(math.log(4 / 8) + math.log(5 / 9))
    with pytest.raises(ValueError, match="not aligned"):
        profile.Profile().fit(reads(spark, "AC", "A"))
    files.write_profile(model.emissions, model.transitions, str(tmp_path / "json"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "json/transitions")).select("md", "mi", "mm").collect()] == [tuple(r) for r in model.transitions.select("md", "mi", "mm").collect()]


def test_pages_of_a_table_sorted_once(spark):
    df = spark.createDataFrame([(k * 37 % 101, f"s{k}") for k in range(101)], "total_pages int, `a.b` string")
    pages = browse.Pages(df.withColumnRenamed("total_pages", "k"), [F.col("k").desc()])
    for number in (1, 2, 5, 11, 12):
        got = pages.page(number, 10)
        assert [r.k for r in got.collect()] == [100 - x for x in range((number - 1) * 10, min(number * 10, 101))]
        assert all(r.total_pages == 11 for r in got.collect())
    plan = pages.page(5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan or "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(pages.ranges) > 1 and browse.Pages(df.limit(0), ["total_pages"]).page(1).collect() == []


def test_fastq_ranges(spark, tmp_path):
    path = tmp_path / "x.fastq"
    rows = [(f"r{k}", "ACGT"[k % 4] * (5 + k % 7), ("@+I"[k % 3]) * (5 + k % 7)) for k in range(400)]
    text = "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in rows)
    path.write_text(text + "\n")
    try:
        for size in (100, 500, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 10)
            assert sorted(tuple(r) for r in files.read_fastq(spark, str(path)).collect()) == sorted(rows)
            (tmp_path / f"cut{size}.fq").write_text(text[:-10])
            with pytest.raises(Exception, match="cut short"):
                files.read_fastq(spark, str(tmp_path / f"cut{size}.fq")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    with gzip.open(tmp_path / "y.fq.gz", "wt") as f:
        f.write(text)
    assert files.read_sequences(spark, str(tmp_path / "y.fq.gz")).count() == 400
    (tmp_path / "odd.fq").write_text("\n@a\r\nAC\r\n+\r\nII\r\n\n\n@b\n\n+\n\n@c\nG\n+c\n@\n\n")
    assert [tuple(r) for r in files.read_fastq(spark, str(tmp_path / "odd.fq")).collect()] == [("a", "AC", "II"), ("b", "", ""), ("c", "G", "@")]
    (tmp_path / "empty.fastq").write_text("")
    assert files.read_fastq(spark, str(tmp_path / "empty.fastq")).count() == 0
    with pytest.raises(ValueError, match="no records"):
        files.read_sequences(spark, str(tmp_path / "empty.fastq"))


def test_fasta_headers(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">Rank=2;Reads=5;RPU=1.5;other=x\nAC\nGT\n>plain\r\nTTTT\r\n")
    got = sorted(files.read_sequences(spark, str(tmp_path / "a.fasta")).collect(), key=lambda r: r.sequences)
    assert [(r.sequences, r.Rank, r.Reads, r.RPU, r.Cluster) for r in got] == [("ACGT", 2, 5, 1.5, None), ("TTTT", 2, 0, 0.0, None)]
    (tmp_path / "c.fasta").write_text(">rank=3;READS=4;Rpu=2\nA\n")
    assert [(r.Rank, r.Reads, r.RPU) for r in files.read_fasta(spark, str(tmp_path / "c.fasta")).collect()] == [(3, 4, 2.0)]
    (tmp_path / "b.fasta").write_text("")
    with pytest.raises(ValueError):
        files.read_sequences(spark, str(tmp_path / "b.fasta"))
    with pytest.raises(ValueError):
        files.read_sequences(spark, "x.bam")


def test_csv_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,SEQUENCES,reads\n"x,1",ACGT,7\n')
    r = files.read_sequences(spark, str(tmp_path / "a.csv")).first()
    assert (r.ID, r.sequences, r.Reads, r.Rank, r.length) == ("x,1", "ACGT", 7, 1, 4)


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("inf",), ("NaN",), (None,)], "t string")
    assert [r.v for r in df.select(sq.to_number(F.col("t")).alias("v")).collect()] == [1.5, None, None, None, None]


def test_clusters_of_greedy_clustering_reach_positions(spark):
    """cluster_led -> recluster -> position_enrichment on real clusters, by hand."""
    a = table(spark, [("ACGTACGTAC", 50), ("ACGTACGTAA", 20), ("GGGGGTTTTT", 30)])
    b = table(spark, [("ACGTACGTAC", 20), ("ACGTACGTAA", 60), ("CCCCCCCCCC", 20)])
    one, two = (cluster.cluster_led(x, min_reads=1, max_led=3, total_clusters=5) for x in (a, b))
    got = {r.sequences: (r.Cluster, r.Enrichment) for r in compare.recluster(one, two).collect()}
    assert got == {"ACGTACGTAC": (1, 0.4), "ACGTACGTAA": (1, 3.0), "GGGGGTTTTT": (2, None), "CCCCCCCCCC": (3, None)}
    means = {(r.Residue, r.Position): r.AvEnrich for r in align.position_enrichment(compare.recluster(one, two), 1).collect() if r.AvEnrich is not None}
    assert means[("A", 1)] == 1.7 and means[("C", 10)] == 0.4 and means[("A", 10)] == 3.0


def test_profile_splits_distinct_sequences_once(spark, monkeypatch):
    df = spark.createDataFrame([(s,) for s in ("AC-T", "AC-T", "ACGT", "A-GN", None) for _ in range(3)], "sequences string")
    seen, split = [], profile.residue_positions
    monkeypatch.setattr(profile, "residue_positions", lambda rows: seen.append(rows.count()) or split(rows))
    model = profile.Profile().fit(df)
    assert seen == [3]  # was three times all 12 rows
    got = {(r.col, r.residue): r.p for r in model.emissions.collect()}
    assert got[1, "a"] == 13 / 17 and got[2, "c"] == 10 / 14 and got[4, "n"] == 4 / 17 and model.stats.first()["num_sequences"] == 12


def test_fasta_places_in_file_order_without_a_sort(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nAC\n\n>\n\n>y;Rank=9\nGG\n" + "".join(f">a{k}\nA\n" for k in range(200)))
    (tmp_path / "b.fa").write_text("".join(f">b{k}\nT\n" for k in range(100)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = files.read_fasta(spark, str(tmp_path))
        rows = {r.ID: r.Rank for r in got.collect()}
        assert rows == {"x": 1, "y;Rank=9": 9} | {f"a{k}": k + 3 for k in range(200)} | {f"b{k}": k + 203 for k in range(100)}
        assert "_part" not in got._jdf.queryExecution().analyzed().toString()  # the columns of a sorted numbering
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
