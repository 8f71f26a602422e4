"""Block-compressed gzip files (a series of small gzip members with their sizes in a header field), read by several tasks.

Any gzip reader can read such a file from its beginning; the sizes make it possible to begin elsewhere.  A partition is a range of
the compressed bytes.  Its task takes the first member that begins there, which it knows by a chain of headers that lead to each
other, and reads to the first separator behind its range; the text before its own first separator belongs to the task before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAGIC = b"\x1f\x8b\x08\x04"
#: Largest member (its size is a number of 16 bits), headers that must follow each other, text sent on at a time.
_MOST, _CHAIN, _BATCH = 1 << 16, 4, 4 << 20


def member_size(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(size, bytes of the header) of the member whose header begins at ``at``; None if there is no such header."""
    if data[at : at + 4] != _MAGIC or len(data) < at + 18:
        return None
    extra = int.from_bytes(data[at + 10 : at + 12], "little")
    k, end = at + 12, at + 12 + extra
    while k + 6 <= end and k + 6 <= len(data):
        length = int.from_bytes(data[k + 2 : k + 4], "little")
        if data[k : k + 2] == b"BC" and length == 2:
            return int.from_bytes(data[k + 4 : k + 6], "little") + 1, 12 + extra
        k += 4 + length
    return None


def _first_member(file: pa.NativeFile, start: int, size: int) -> int:
    """Where the first member at or behind ``start`` begins (``size`` if none does)."""
    if start == 0:
        return 0
    data = file.read_at(min(size - start, (_CHAIN + 2) * _MOST), start)
    at = data.find(_MAGIC)
    while at >= 0:
        k = at
        for _ in range(_CHAIN):
            found = member_size(data, k)
            if found is None:
                break
            k += found[0]
            if start + k == size:
                return start + at
        else:
            return start + at
        at = data.find(_MAGIC, at + 1)
    return size


def _inflated(file: pa.NativeFile, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of all members from ``at`` on."""
    held, base = b"", at
    while at < size:
        if at - base + _MOST > len(held) and base + len(held) < size:
            held, base = file.read_at(min(size - at, 16 * _MOST), at), at
        found = member_size(held, at - base)
        if found is None:
            raise ValueError(f"no member begins at byte {at}")
        member = held[at - base : at - base + found[0]]
        text = zlib.decompress(member[found[1] : -8], -15)
        if len(member) != found[0] or zlib.crc32(text) != int.from_bytes(member[-8:-4], "little"):
            raise ValueError(f"the member at byte {at} is damaged")
        yield at, text
        at += found[0]


def pieces(file: pa.NativeFile, start: int, end: int, separator: bytes) -> Iterator[bytes]:
    """The stretches between separators that begin behind the first separator of the range (from byte 0: at once), up to the first in a later range.

    Ranges are all as long as this one and begin at its multiples.
    """
    size = file.size()
    at = _first_member(file, start, size)
    if at >= min(end, size):
        return
    text, skip, border, other, width = b"", start > 0, 0, None, end - start
    for place, more in _inflated(file, at, size):
        if place >= end:  # of a later range: up to the first separator inside of one, at which that range's task begins
            if skip:
                return
            if place // width != other:
                border, other = len(text), place // width
            text += more
            cut = text.find(separator, border)
            if cut >= 0:
                yield from text[:cut].split(separator)  # separators across borders are ours
                return
            continue
        text += more
        if skip:
            cut = text.find(separator)
            if cut < 0:
                text = text[len(text) - len(separator) + 1 :]
                continue
            text, skip = text[cut + len(separator) :], False
        *whole, text = text.split(separator)
        yield from whole
    if text and not skip:
        yield from text.split(separator)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.uri, self.bytes, self.separator = options["path"], int(options["rangeBytes"]), options["separator"].encode().decode("unicode_escape").encode()
        self.names = options["names"].split("\n")

    def partitions(self) -> list[Range]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        return [Range(f.path, at, at + self.bytes) for f in store.get_file_info(self.names) for at in range(0, max(f.size, 1), self.bytes)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string()), pa.array([partition.path] * n, pa.string()), pa.array([partition.start] * n, pa.int64())], ["value", "path", "start"])

        with store.open_input_file(partition.path) as file:
            for piece in pieces(file, partition.start, partition.end, self.separator):
                rows.append(piece)
                held += len(piece)
                if held > _BATCH or len(rows) >= 10_000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class BlockGzip(DataSource):
    """Text between separators in block-compressed files."""

    @classmethod
    def name(cls) -> str:
        return "oligoflow_bgzf"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("value", T.StringType()), T.StructField("path", T.StringType()), T.StructField("start", T.LongType())])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options)


def _block_files(path: str) -> tuple[str, list[str], list[str]] | None:
    """(uri, block-compressed files, other files) of a path; None if Arrow's file systems don't reach it or nothing there is block-compressed."""
    uri = path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:")
    try:
        store, name = fs.FileSystem.from_uri(uri)
        info = store.get_file_info(name)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, recursive=True))
    except (pa.ArrowInvalid, OSError):
        return None
    found = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    blocks = []
    for f in found:
        if f.base_name.endswith((".gz", ".bgz")):
            with store.open_input_file(f.path) as file:
                if member_size(file.read(1 << 10)):
                    blocks.append(f.path)
    return (uri, blocks, [f.path for f in found if f.path not in blocks]) if blocks else None


def read_text(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(value, path, start, split) of the text between separators in all files of a path; ``start`` tells the ranges of a file apart, in order.

    Block-compressed .gz and .bgz files are read in ranges of spark.sql.files.maxPartitionBytes, others by Spark's text source, a plain .gz by one
    task.  Where Arrow's file systems don't reach, all are read by Spark.
    """
    def plain(where) -> DataFrame:
        raw = spark.read if separator == "\n" else spark.read.option("lineSep", separator)
        return raw.text(where).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    found = _block_files(path)
    if found is None:
        return plain(path)
    uri, blocks, others = found
    spark.dataSource.register(BlockGzip)
    size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    options = {"rangeBytes": size, "separator": separator.encode("unicode_escape").decode(), "names": "\n".join(blocks)}
    out = spark.read.format("oligoflow_bgzf").options(**options).load(uri)
    if separator == "\n":
        out = out.withColumn("value", F.regexp_replace("value", "\r$", ""))
    scheme = uri.partition("://")[0] + "://" if "://" in uri else ""
    return out.unionByName(plain([scheme + x for x in others])) if others else out
