"""Quality rules by repetition coverage (operator 8).

Rolling hashes of several n-gram lengths find the n-grams and lines that a text repeats; the measure
is how many of its word characters lie inside them.  Everything is row-wise: texts are hashed in numpy
in slices of a few MB, so no shuffle is needed and no group can grow hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing as hs

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Largest percentages of the word characters that may lie inside n-grams of this many words found twice or more in the text (all places
#: counted), and inside lines that occur twice or more: in a text of MIN_WORDS words, and in one without end.  Between them a limit
#: falls with 1 / words, so it has no step: one repeated sentence is a large share of a short text only.
NGRAM_PERCENT = {5: (50, 30), 8: (45, 25), 12: (40, 20)}
LINE_PERCENT = (50, 25)
#: Largest percentage of symbol characters to word characters.
SYMBOL_PERCENT = 10

_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_PERCENT)
)
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _twice(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of two or more equal (owner, hash), not the first of its group) for each entry; owner is sorted."""
    key = hs.mix(owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + h)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), dtype=bool)
    equal = key[order][1:] == key[order][:-1]
    later = np.zeros(len(key), dtype=bool)
    later[order[1:][equal]] = True
    same[order[1:][equal]] = True
    same[order[:-1][equal]] = True
    return same, later


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of a slice of texts, one array entry for each text."""
    start, end, rows = hs.words(raw, offsets)
    n_words = np.diff(rows)
    point = (raw & 0xC0) != 0x80
    points = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(point, out=points[1:])
    word_points = points[end] - points[start]
    out = {"n_words": n_words, "word_chars": hs.sums_by_row(word_points, rows), "n_symbols": hs.sums_by_row(_IS_SYMBOL[raw], offsets)}

    # lines: between line feeds and text borders, with at least one word
    feed = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([offsets[:-1], feed + 1]))
    begin = begin[begin < len(raw)]
    stop = np.concatenate([begin[1:], [len(raw)]]) if len(begin) else begin
    stop = np.where(raw[stop - 1] == 10, stop - 1, stop) if len(begin) else stop
    first = np.searchsorted(start, begin)
    has = np.searchsorted(start, stop) > first
    begin, stop = begin[has], stop[has]
    owner = np.searchsorted(offsets, begin, side="right") - 1
    line_hash = hs.ranges(hs.prefix(hs.BYTE_VALUE[raw], "byte"), begin, stop, "byte")
    same, later = _twice(owner, line_hash)
    n = len(offsets) - 1
    out["n_dup_lines"] = np.bincount(owner[later], minlength=n)
    total = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(word_points, out=total[1:])
    line_chars = total[np.searchsorted(start, stop)] - total[np.searchsorted(start, begin)]
    out["dup_line_chars"] = np.bincount(owner[same], weights=line_chars[same], minlength=n).astype(np.int64)

    # n-grams, shortest first: a longer n-gram can only repeat where the shorter one at its start does
    word_hash = hs.word_hashes(raw, start, end)
    word_sums = hs.prefix(word_hash, "word")
    row_of = np.repeat(np.arange(n), n_words)
    row_end = np.repeat(rows[1:], n_words)
    at = np.arange(len(start))
    for k in sorted({3, *NGRAM_PERCENT}):
        at = at[at + k <= row_end[at]]
        same, _ = _twice(row_of[at], hs.ranges(word_sums, at, at + k, "word"))
        at = at[same]
        inside = hs.covered(at, k, len(start))
        if k == 3:
            out["n_repeat_words"] = hs.sums_by_row(inside, rows)
        if k in NGRAM_PERCENT:
            out[f"dup_{k}gram_chars"] = hs.sums_by_row(inside * word_points, rows)
    failed = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * n_words)
    chars = np.maximum(out["word_chars"], 1)
    good = 100 * out["n_symbols"] <= SYMBOL_PERCENT * chars
    for measured, (short, long) in [("dup_line_chars", LINE_PERCENT), *((f"dup_{k}gram_chars", x) for k, x in NGRAM_PERCENT.items())]:
        good &= 100 * out[measured] * n_words <= (long * n_words + (short - long) * MIN_WORDS) * chars
    return out | {"base_failed": failed, "kept": ~failed & good}


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures and the verdict for each row of ``docs``.

    Null and empty texts have no words and fail; repeated ids give one row each; a null id stays null;
    other columns of ``docs`` are not read; an empty table gives an empty result.  A share exactly at its limit passes.  A text of any
    length is measured whole, by a task that holds it.
    """
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text", hs.SMALL_SLICE):
            m = measure(*hs.utf8(piece.column(1)))
            yield pa.RecordBatch.from_arrays([piece.column(0)] + [pa.array(m[x] if m[x].dtype == bool else m[x].astype(np.int64)) for x in names[1:]], names)

    return docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, _SCHEMA)


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns (whatever their names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, text_col, hs.SMALL_SLICE):
            m = measure(*hs.utf8(piece.column(piece.schema.get_field_index(text_col))))
            yield piece.filter(pa.array(m["kept"]))

    return docs.mapInArrow(run, docs.schema)
