"""FASTQ records of any number of lines, read in parallel blocks.

A record is a line that begins with @, lines of sequence, a line that begins with + and lines of quality, as many symbols as the
sequence has.  Quality may begin with @ or +, so no line tells by itself where a record begins.  A task takes the first line of
its block from which several records in a row parse; it keeps the lines before it and after its last whole record.  These few
lines of all blocks of a file are then parsed in order, from the state that the block before left.  If a block's first record
isn't where the lines before it end, the file is parsed again by one task, so a lucky parse never counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import partitions, stored
from .bgzf import read_text

#: Records in a row that must parse before a line counts as the beginning of one.
SURE = 4
_SCANNED = "id string, sequences string, quality string, path string, start long, side int, lines array<string>, sure boolean"


class Grammar:
    """Parses lines one by one; ``ready`` is true between records."""

    def __init__(self) -> None:
        self.head: str | None = None
        self.plus, self.sequence, self.quality, self.need = False, [], [], 0

    @property
    def ready(self) -> bool:
        return self.head is None

    def feed(self, line: str) -> tuple[str, str, str] | None:
        """The record that this line completes, if it does; ValueError if no record has such a line here."""
        if self.head is None:
            if not line.strip():
                return None
            if not line.startswith("@"):
                raise ValueError(f"not the first line of a FASTQ record: {line[:40]!r}")
            self.head, self.plus, self.sequence, self.quality, self.need = line[1:], False, [], [], 0
            return None
        if not self.plus:
            if not line.startswith("+"):
                if line.startswith("@"):
                    raise ValueError(f"record {self.head!r} has no line that begins with +")
                self.sequence.append(line)
                self.need += len(line)
                return None
            self.plus = True
        else:
            self.quality.append(line)
            self.need -= len(line)
        if self.need < 0:
            raise ValueError(f"record {self.head!r} has more quality symbols than bases")
        if self.need:
            return None
        out, self.head = (self.head, "".join(self.sequence), "".join(self.quality)), None
        return out


def _first(lines: list[str], end: bool) -> int | None:
    """The first line from which SURE records parse (at the ``end`` of a block fewer, if all lines do); None if it isn't in sight."""
    for k, line in enumerate(lines):
        if not line.startswith("@"):
            continue
        grammar, whole = Grammar(), 0
        try:
            for x in lines[k:]:
                whole += grammar.feed(x) is not None
                if whole == SURE:
                    return k
        except ValueError:
            continue
        if not end:
            return None  # more lines decide
        if whole:
            return k
    return None


def _columns(records: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, pa.string()) for x in zip(*records, strict=True)] if records else [pa.array([], pa.string())] * 3


def _shape(lines: list[str]) -> tuple[int, int] | None:
    """How many lines of sequence and of quality the first record has; None if it isn't whole or has none of them."""
    grammar = Grammar()
    try:
        for k, line in enumerate(lines):
            if grammar.feed(line):
                bases, marks = len(grammar.sequence), len(grammar.quality)
                return (bases, marks) if bases and marks else None
    except ValueError:
        pass
    return None


def _regular(lines: pa.Array, bases: int, marks: int) -> list[pa.Array] | None:
    """Columns of records of ``bases`` lines of sequence and ``marks`` of quality each, if all of ``lines`` are such."""
    at = np.arange(0, len(lines), bases + marks + 2)
    part = [lines.take(pa.array(at + k)) for k in range(bases + marks + 2)]
    sequence, quality = part[1 : bases + 1], part[bases + 2 :]
    if not all(pc.all(x, min_count=0).as_py() for x in (pc.starts_with(part[0], "@"), pc.starts_with(part[bases + 1], "+"))):
        return None
    if any(pc.any(pc.starts_with(x, c)).as_py() for x in sequence for c in "@+"):
        return None
    need = sum(pc.utf8_length(x).to_numpy().astype(np.int64) for x in sequence)
    for k, x in enumerate(quality):  # the last line brings as many symbols as there are bases, none before does
        need = need - pc.utf8_length(x).to_numpy()
        if not ((need > 0) if k < marks - 1 else (need == 0)).all():
            return None
    joined = [x[0] if len(x) == 1 else pc.binary_join_element_wise(*x, "") for x in (sequence, quality)]
    return [pc.utf8_slice_codeunits(part[0], 1), *joined]


class Block:
    """Lines of one block of a file, in Arrow arrays as they come."""

    def __init__(self, path: str, start: int) -> None:
        self.path, self.start, self.grammar = path, start, Grammar()
        self.sure, self.wrong, self.held, self.open, self.rest = start == 0, False, [], [], pa.array([], pa.string())
        self.shape = 1, 1

    def take(self, lines: pa.Array, end: bool) -> Iterator[pa.RecordBatch]:
        """Records and pieces that these lines complete."""
        if self.wrong:
            return
        if not self.sure:
            self.held += lines.to_pylist()
            few = len(self.held) < 64 and not end
            at = None if few else _first(self.held, end)
            if at is None:
                if end and self.held:
                    yield self.piece(0, self.held, False)  # no record begins here
                return
            if at:
                yield self.piece(0, self.held[:at], True)
            else:
                yield self.piece(0, [], True)
            self.sure, lines, self.held = True, pa.array(self.held[at:], pa.string()), []
        records = []
        if not self.open:  # whole records of as many lines each, as almost all files have them
            lines = pa.concat_arrays([self.rest, lines])
            for learn in (False, True):
                self.shape = learn and _shape(lines.slice(0, 4096).to_pylist()) or self.shape
                n = len(lines) // (sum(self.shape) + 2) * (sum(self.shape) + 2)
                columns = _regular(lines.slice(0, n), *self.shape)
                if columns is not None:
                    break
            if columns is not None:
                if n:
                    yield self.batch(columns)
                lines = lines.slice(n)
                if not end:
                    self.rest = lines
                    return
            self.rest = lines.slice(0, 0)
        try:
            for line in lines.to_pylist():
                record = self.grammar.feed(line)
                if record:
                    records.append(record)
                    self.open = []
                elif not self.grammar.ready:
                    self.open.append(line)
        except ValueError:
            if self.start == 0:
                raise
            self.wrong = True
            yield self.piece(1, [], False)
            return
        if records:
            yield self.batch(_columns(records))
        if end and self.open:
            yield self.piece(1, self.open, True)

    def piece(self, side: int, lines: list[str], sure: bool) -> pa.RecordBatch:
        return self.batch([pa.array([None], pa.string())] * 3, side, lines, sure)

    def batch(self, columns: list[pa.Array], side: int | None = None, lines: list[str] | None = None, sure: bool | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        more = [pa.array([self.path] * n, pa.string()), pa.array([self.start] * n, pa.int64()), pa.array([side] * n, pa.int32()), pa.array([lines] * n, pa.list_(pa.string())), pa.array([sure] * n, pa.bool_())]
        return pa.RecordBatch.from_arrays([*columns, *more], [c.split()[0] for c in _SCANNED.split(", ")])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the blocks of a task, and of each block the lines before its first and after its last whole record."""
    block = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lines, path, start = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        new = np.flatnonzero((start[1:] != start[:-1]) | pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False)) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if block is None or (block.path, block.start) != (path[lo].as_py(), int(start[lo])):
                if block is not None:
                    yield from block.take(pa.array([], pa.string()), True)
                block = Block(path[lo].as_py(), int(start[lo]))
            yield from block.take(lines.slice(lo, hi - lo), False)
    if block is not None:
        yield from block.take(pa.array([], pa.string()), True)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie across blocks, from the pieces of each file in order; a row of ``wrong`` True if they don't meet."""
    path, grammar, records, wrong = None, Grammar(), [], False

    def done() -> Iterator[pa.RecordBatch]:
        if path is not None and (wrong or not grammar.ready):
            yield pa.RecordBatch.from_arrays([*[pa.array([None], pa.string())] * 3, pa.array([path]), pa.array([True])], ["id", "sequences", "quality", "path", "wrong"])
        elif records:
            n = len(records)
            yield pa.RecordBatch.from_arrays([*_columns(records), pa.array([path] * n), pa.array([False] * n)], ["id", "sequences", "quality", "path", "wrong"])

    for batch in batches:
        for this, side, lines, sure in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if this != path:
                yield from done()
                path, grammar, records, wrong = this, Grammar(), [], False
            if wrong:
                continue
            try:
                found = [r for r in map(grammar.feed, lines) if r]
                wrong = side == 0 and sure and not grammar.ready or side == 1 and not sure
                records += found
            except ValueError:
                wrong = True
    yield from done()


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole files, each read from its beginning by this task; ValueError if one isn't FASTQ."""
    path, grammar = None, Grammar()
    for batch in batches:
        records = []
        for line, this in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if this != path:
                if not grammar.ready:
                    raise ValueError(f"{path}: the last record is cut short")
                path, grammar = this, Grammar()
            record = grammar.feed(line)
            if record:
                records.append(record)
        yield pa.RecordBatch.from_arrays(_columns(records), ["id", "sequences", "quality"])
    if not grammar.ready:
        raise ValueError(f"{path}: the last record is cut short")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequences, quality) of FASTQ files, records wrapped or not, in any store that Spark reads; a .gz is read by one task unless it is
    block-compressed.

    Lines of a record are joined; blank lines between records are passed over.  An empty file has no records.  A file
    with a record that is cut short or has more quality symbols than bases is refused (ValueError at the call).  Files are parsed once, at
    the call; records are stored, so the lines at the ends of blocks and the records between them come from the same blocks.
    """
    raw = read_text(spark, path)
    found = stored(raw.mapInArrow(_scanned, _SCANNED), "scanned")
    # ends of files of one block too: a record that is cut short
    pieces = found.where("lines IS NOT NULL").select("path", "side", "lines", "sure", "start").repartition(partitions(spark), "path").sortWithinPartitions("path", "start", "side")
    met = stored(pieces.select("path", "side", "lines", "sure").mapInArrow(_stitched, "id string, sequences string, quality string, path string, wrong boolean"), "stitched")
    wrong = [r["path"] for r in met.where("wrong").select("path").collect()]
    out = ["id", "sequences", "quality"]
    whole = found.where("lines IS NULL")
    if not wrong:
        return whole.select(out).unionByName(met.select(out))
    again = raw.where(F.col("path").isin(wrong)).withColumn("n", F.monotonically_increasing_id())
    again = again.repartition(len(wrong), "path").sortWithinPartitions("path", "start", "n").select("value", "path")
    kept = whole.where(~F.col("path").isin(wrong)).select(out).unionByName(met.where("NOT wrong").select(out))
    return kept.unionByName(again.mapInArrow(_in_order, "id string, sequences string, quality string"))
