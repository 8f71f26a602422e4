"""Toxicity by class-conditional Kneser-Ney models (operator 1).

Two models, one of toxic and one of ordinary labelled texts, give the probability of a word as that of its
stem (its first bytes) times that of the word after the stem.  As in Kneser-Ney smoothing, what is counted is
not how often an expression occurs but in how many different contexts: here, texts.  A word that one text
repeats a hundred times is a word of one context.  Counts are discounted and backed off to the
continuation counts that both classes share, in the Pitman-Yor form of interpolated smoothing,

    p_c(x | h) = (max(n_c(hx) - D, 0) + (s + D t_c(h)) p(x | h)) / (n_c(h) + s),    s = m / p(x | h),

where n_c(hx) is the number of texts of class c with x after h, p(x | h) comes from the counts of both classes,
t_c(h) is how many different x follow h in class c, and the strength s lends every expression m counts of the
shared backoff: what one class has hardly seen costs it no more than that.

A text's score compares its two mean log-likelihoods, toxic less ordinary, over all its words; evidence for either
class counts.  Of each word's difference the first MARGIN nats are taken off (towards 0), which is about what chance
and a text's language alone bring about.  A logistic curve, fitted on labelled texts that the counts left out,
makes a score of the mean difference.

Counts are made by Spark over labelled texts and kept as tables keyed by the full 64-bit hash of the word or
stem, so no two share an entry however many there are.  Each word's difference is computed there once.  Up to
HELD entries the differences are broadcast; beyond, the words of the texts are joined with them.  Both ways
give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import hashing as hs
from . import sieve
from .base import stored

#: Words and stems, together, whose differences are broadcast (12 bytes each) and not joined.
HELD = 8_000_000
STEM_BYTES = 6
#: D, m, and the part of a word's difference that is taken off.
DISCOUNT, LENT, MARGIN = 0.75, 3.0, 0.75
#: Labelled texts used to fit the logistic curve (two numbers), at most.
CALIBRATION_ROWS = 20_000

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, stem hash, word hash) of every word; A-Z lower-cased, white space and ASCII punctuation separate."""
    raw, offsets = hs.utf8(texts)
    start, end, rows = hs.words(raw, offsets, _SEPARATOR)
    stem = hs.word_hashes(raw, start, np.minimum(end, start + STEM_BYTES), lower=True)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(rows)), stem, hs.word_hashes(raw, start, end, lower=True)


def count_words(labelled: DataFrame) -> DataFrame:
    """(whole, key, stem, n0, n1): for each distinct word (whole) and each stem, its hash, the stem's, and how many texts of either class have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            for whole in (True, False):
                key, stem, y = (np.concatenate(x) for x in zip(*[h[1:] for h in held if h[0] == whole], strict=True))
                first, n = _runs(order := np.argsort(key, kind="stable"), key)
                n1 = np.add.reduceat(y[order], first)
                at = order[first]
                yield pa.RecordBatch.from_arrays([pa.array([whole] * len(at)), pa.array(key[at].view(np.int64)), pa.array(stem[at].view(np.int64)), pa.array(n - n1), pa.array(n1)], ["whole", "key", "stem", "n0", "n1"])

        for piece in hs.pieces(batches, "text"):
            row, stem, word = _words(piece.column(0))
            y = piece.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for whole, key in ((True, word), (False, stem)):  # once for each text
                order = np.lexsort((key, row))
                at = order[np.append(True, (row[order[1:]] != row[order[:-1]]) | (key[order[1:]] != key[order[:-1]]))[: len(order)]]
                held.append((whole, key[at], stem[at], y[row[at]]))
                size += len(at)
            if size > 2_000_000:
                yield from rows()
                held, size = [], 0
        if size:
            yield from rows()

    found = labelled.select("text", "toxic").mapInArrow(run, "whole boolean, key long, stem long, n0 long, n1 long")
    return found.groupBy("whole", "key").agg(F.min("stem").alias("stem"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _runs(order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys in sorted order."""
    first = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]])[: len(key)])
    return first, np.diff(np.append(first, len(key)))


def _step(count: list, before: list, kinds: list) -> Column:
    """Toxic less ordinary log(p_c(x | h) / p(x | h)) from the classes' n(hx), n(h) and t(h); what neither has seen says nothing."""
    shared = F.least((count[0] + count[1]) / F.greatest(before[0] + before[1], F.lit(1)), F.lit(1.0))  # p(x | h)
    ratio = [(F.greatest(n - DISCOUNT, F.lit(0.0)) + LENT + DISCOUNT * t * shared) / (h * shared + LENT) for n, h, t in zip(count, before, kinds, strict=True)]
    return F.when(count[0] + count[1] > 0, F.log(ratio[1]) - F.log(ratio[0])).otherwise(0.0)


def _shrunk(step: Column) -> Column:
    """A difference without its first MARGIN nats."""
    return (F.signum(step) * F.greatest(F.abs(step) - MARGIN, F.lit(0.0))).cast("float")


class Held:
    """Differences by hash, in memory: those of words, and those of stems for words that were not counted."""

    def __init__(self, words: DataFrame, stems: DataFrame):
        self.tables = []
        for df in (words, stems):
            found = df.toArrow()
            key, step = (found.column(k).to_numpy() for k in (0, 1))
            order = np.argsort(key)
            self.tables.append((key[order], step[order]))

    def steps(self, stem: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Toxic less ordinary log-probability of each word."""
        words, at, back = np.unique(word, return_index=True, return_inverse=True)
        out, open_ = np.zeros(len(words), np.float32), np.arange(len(words))
        for (key, step), sought in zip(self.tables, (words, stem[at]), strict=True):
            if len(key) == 0 or len(open_) == 0:
                continue
            wanted = sought[open_].view(np.int64)
            place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            same = key[place] == wanted
            out[open_[same]] = step[place[same]]
            open_ = open_[~same]
        return out[back].astype(np.float64)


@dataclass
class Model:
    """Differences of all words (word, step) and stems (stem, step), and the logistic curve."""

    words: DataFrame
    stems: DataFrame
    held: Broadcast | None  # of Held; None if there are too many
    slope: float = 1.0
    middle: float = 0.0


def _mean(row: np.ndarray, step: np.ndarray, texts: int) -> np.ndarray:
    """Mean difference of the words of each of so many texts (0 without words)."""
    return np.bincount(row, weights=step, minlength=texts) / np.maximum(np.bincount(row, minlength=texts), 1)


def differences(docs: DataFrame, model: Model) -> DataFrame:
    """``difference`` of the text of each row of ``docs`` in place of its last column, ``text``."""
    kept = docs.drop("text")
    schema = StructType([*kept.schema, StructField("difference", DoubleType())])
    held = model.held
    if held is None:
        return _joined_differences(docs, model, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text"):
            row, stem, word = _words(piece.column(piece.num_columns - 1))
            found = _mean(row, held.value.steps(stem, word), piece.num_rows)
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(found)], schema.names)

    return docs.mapInArrow(run, schema)


def _joined_differences(docs: DataFrame, model: Model, schema: StructType) -> DataFrame:
    """:func:`differences` by joining the distinct words of each text with the tables and gathering them by text."""
    names = schema.names[:-1]
    marked = docs.select(*names, F.monotonically_increasing_id().alias("_row"), "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text"):
            row, stem, word = _words(piece.column(piece.num_columns - 1))
            bare = np.setdiff1d(np.arange(piece.num_rows), row)  # texts without words stay by an entry that counts 0 times
            order = np.lexsort((word, row))
            row, stem, word = row[order], stem[order], word[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (word[1:] != word[:-1]))[: len(row)])
            times = np.append(np.diff(np.append(first, len(row))), np.zeros(len(bare), np.int64))
            spread = hs.mix(bare.astype(np.uint64))
            key = [pa.array(np.append(x[first], spread).view(np.int64)) for x in (stem, word)]
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(np.append(row[first], bare))) for c in piece.columns[:-1]], *key, pa.array(times)], [*names, "_row", "_stem", "_word", "_times"])

    found = marked.mapInArrow(words, StructType([*marked.schema[:-1], *[StructField(x, LongType()) for x in ("_stem", "_word", "_times")]]))
    by_word, by_stem = model.words.toDF("_word", "_of_word").hint("merge"), model.stems.toDF("_stem", "_of_stem").hint("merge")
    found = found.join(by_word, "_word", "left").join(by_stem, "_stem", "left")
    step = F.coalesce("_of_word", "_of_stem", F.lit(0.0).cast("float")).cast("double")
    mean = F.sum(step * F.col("_times")) / F.greatest(F.sum("_times"), F.lit(1))
    return found.groupBy(*names, "_row").agg(mean.alias("difference")).select(*schema.names)


def fit_counts(labelled: DataFrame) -> Model:
    """Both models from all rows of ``labelled`` (text, toxic 0 or 1)."""
    found = stored(count_words(labelled), "words")
    counts = found.where("whole").select(F.col("key").alias("word"), "stem", "n0", "n1")
    kinds = [F.sum(F.expr(f"cast(n{c} > 0 AS long)")).alias(f"t{c}") for c in (0, 1)]
    after = counts.groupBy("stem").agg(F.sum("n0").alias("h0"), F.sum("n1").alias("h1"), *kinds)
    stems = stored(found.where("NOT whole").select("stem", F.col("n0").alias("s0"), F.col("n1").alias("s1")).join(after.hint("merge"), "stem"), "stems")
    sums = [F.coalesce(F.sum(F.expr(x)), F.lit(0)) for x in ("s0", "s1", "cast(s0 > 0 AS long)", "cast(s1 > 0 AS long)")]
    *total, distinct = stems.agg(*sums, F.count("*")).first()
    total = [F.lit(float(x)) for x in total]
    n, s, h, t = ([F.col(f"{x}{c}") for c in (0, 1)] for x in "nsht")
    of_stem = _step(s, total[:2], total[2:])
    words = counts.join(stems.hint("merge"), "stem").select("word", _shrunk(of_stem + _step(n, h, t)).alias("step"))
    words, stems = stored(words, "word-steps"), stems.select("stem", _shrunk(of_stem).alias("step"))
    held = None
    if distinct + words.count() <= HELD:
        held = labelled.sparkSession.sparkContext.broadcast(Held(words, stems))
    return Model(words, stems, held)


def calibrate(model: Model, frame: pd.DataFrame) -> None:
    """Fit slope and middle to (difference, toxic) by Newton's method on the logistic loss, with a weak pull to keep it finite."""
    x, y = frame["difference"].to_numpy(float), frame["toxic"].to_numpy(float)
    if len(x) == 0 or y.min() == y.max():
        model.slope, model.middle = 10.0, 0.0
        return
    mean, scale = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(beta[0], 1e-6) / scale
    model.slope, model.middle = slope, mean - beta[1] / slope


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A calibrated model.  Labels of held-out ids are never read; null texts and null labels are left out;
    of several labels of one id the larger counts.

    Of the ids whose remainder is 4, those with the smallest crc32 fit the logistic curve (CALIBRATION_ROWS
    rows at most); all other ids are counted.
    """
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").withColumn("fold", remainder).where("fold <> 0").groupBy("doc_id", "fold").agg(F.max("toxic").cast("long").alias("toxic"))
    known = stored(known, "labels")
    # by sorting at every size: labels grow with the documents
    texts = sieve.sieved(docs.select("doc_id", "text").where("text IS NOT NULL"), F.col("doc_id").cast("long"), sieve.sieve(known.select(F.col("doc_id").cast("long"))))
    labelled = texts.join(known.hint("merge"), "doc_id")
    labelled = stored(labelled, "labelled")
    hashed = F.crc32(F.col("doc_id").cast("string"))
    first = labelled.where("fold = 4").select(hashed.alias("hash"), "doc_id").orderBy("hash", "doc_id").limit(CALIBRATION_ROWS)
    last = first.agg(F.max(F.struct("hash", "doc_id"))).first()[0]
    aside = (F.col("fold") == 4) & ((hashed < last[0]) | (hashed == last[0]) & (F.col("doc_id") <= last[1])) if last else F.lit(False)
    model = fit_counts(labelled.where(~aside))
    judged = differences(labelled.where(aside).select("doc_id", "toxic", "text"), model)
    frame = judged.orderBy(hashed, "doc_id").limit(CALIBRATION_ROWS).toPandas()
    calibrate(model, frame)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text; other columns are not read).

    Null, empty and wordless texts have no likelihoods; their score is that of a difference of 0.  A null
    id is not held out; rows that repeat an id are scored by their own texts.  An empty table gives an empty
    result.  A text of any length is scored whole, by a task that holds it; a score of exactly 0.5 predicts 1.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    found = differences(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), model)
    x = model.slope * (F.col("difference") - model.middle)
    found = found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0)))))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels that are not held out and score every text."""
    return score(docs, train(docs, labels))
