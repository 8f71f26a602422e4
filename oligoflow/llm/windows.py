"""Substring de-duplication by Rabin-Karp hashes of fixed-length word windows (operator 4).

Every window's rolling hash is counted in Spark (packed, see :mod:`repeats`); windows that occur twice or
more anywhere are merged into maximal intervals of words, which are removed from each text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as hs
from . import repeats

_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) of ``docs``, null texts as empty ones.  The 16-byte key is a digest of id and text, so that copies of a
    text have keys of their own and no join by key has a hot one; rows that are equal in both share a key and a result.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.unhex(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), text))).alias("key"), text.alias("text"))


def repeated_words(rows: DataFrame, width: int) -> DataFrame:
    """(key, spans) of :func:`keyed` rows: maximal intervals of words covered by windows of ``width`` words that start anywhere else too."""

    def entries(piece: pa.RecordBatch) -> Iterator[tuple]:
        raw, offsets = hs.utf8(piece.column(1))
        start, end, rows = hs.words(raw, offsets)
        at, h = hs.windows(hs.word_hashes(raw, start, end), rows, width)
        yield piece.column(0).to_pylist(), rows[:-1], int(rows[-1]), at, h, None, len(raw)

    n_bytes = repeats.text_bytes(rows)
    return repeats.intervals(repeats.matched(repeats.packed(rows.select("key", "text"), "text", entries, n_bytes), n_bytes), 0, width)


def remove_repeats(docs: DataFrame, width: int = 35, texts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) without repeated windows of ``width`` words.

    Gives (doc_id, n_words, n_removed, kept_sha256) and, with ``texts``, kept_text: the kept words joined by
    one space.  Words are runs without white space, taken as they are.  All rows are judged on the input.
    Null, empty, blank texts and texts of fewer than ``width`` words keep all they have.  Rows that repeat an
    id or have a null one are rows of their own; equal texts of ``width`` words or more vanish all together.
    Other columns are not read; an empty table gives an empty result.  A text of any length is hashed and cut whole, by a
    task that holds it.  Two different windows are taken for equal with a chance of 2**-64 for each pair.
    """
    names = [x.split()[0] for x in _DIGEST.split(", ")] + ["kept_text"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in hs.pieces(batches, "text"):
            out: list[list] = [[] for _ in names]
            for doc_id, text, spans in zip(piece.column(0), piece.column(1), piece.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split()  # the six ASCII separators
                kept, at = [], 0
                for lo, hi in repeats.spans_of(spans.as_py()).tolist():
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                plain = b" ".join(kept)
                for column, x in zip(out, (doc_id.as_py(), len(words), len(words) - len(kept), hashlib.sha256(plain).hexdigest(), plain), strict=False):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(out, types, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns[:4], *(x.cast(pa.string()) for x in columns[4:])], names)

    rows = keyed(docs)
    joined = rows.join(repeated_words(rows, width), "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, _DIGEST + ", kept_text string" * texts)
