"""The queries opN_<name> of this subpackage, each over its whole table, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oligoflow.storage import new_path

from . import base, decontam, fingerprints, mixing, near_dedup, oracles, quality, search, secrets, suffixes, token_counts, toxicity, trie, warc, windows


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_toxicity(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 80 % of their 4-word shingles."""
    return near_dedup.near_duplicates(base.table(spark, sf_dir, "documents"), n=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram of all documents with suffix sums."""
    return token_counts.with_sums(token_counts.length_histogram(base.table(spark, sf_dir, "documents")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without windows of 35 words that also start elsewhere."""
    return windows.remove_repeats(base.table(spark, sf_dir, "documents"), width=35, texts=False)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without strings of 400 bytes that also start elsewhere."""
    return suffixes.remove_repeats(base.table(spark, sf_dir, "documents"), width=400, texts=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return decontam.contamination(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.secret_report(base.table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.quality_report(base.table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated so that every source has an equal share, in a global random order."""
    out = mixing.mix_sources(base.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "copy_no", "shuffle_key", "text")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page: .warc.gz files written to the shared folder, read back and verified."""
    path = new_path(spark, "warc")
    warc.save_archives(base.table(spark, sf_dir, "pages"), path, archive_bytes=16 << 20)
    return warc.load_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of every document and of its edited text, and their likenesses."""
    return fingerprints.compare_to_next(base.table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, with totals of every subtree."""
    return trie.conversation_trie(base.table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item among all documents."""
    return search.search(base.table(spark, sf_dir, "benchmark"), base.table(spark, sf_dir, "documents"), best=50)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_near_duplicates, op3_token_counts, op4_substring_dedup, op5_suffix_dedup,
    op6_decontaminate, op7_secret_scan, op8_quality_rules, op9_mix_sources, op10_warc, op11_fingerprints, op12_conversation_trie, op13_ranked_search,
)}
ORACLES = {
    "op2_near_duplicates": oracles.NEAR_DUPLICATES, "op4_substring_dedup": oracles.SUBSTRING_DEDUP, "op5_suffix_dedup": oracles.SUFFIX_DEDUP, "op6_decontaminate": oracles.DECONTAMINATE,
    "op8_quality_rules": oracles.QUALITY, "op9_mix_sources": oracles.MIX_SOURCES, "op10_warc": oracles.WARC,
    "op12_conversation_trie": oracles.CONVERSATION_TRIE, "op13_ranked_search": oracles.RANKED_SEARCH,
}
