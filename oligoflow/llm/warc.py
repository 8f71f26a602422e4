"""WARC archives: one gzip member per record, and a sequential reader (operator 10).

Archives are files, written and read by tasks as streams: :func:`save_archives` is a Spark sink of .warc.gz files of
about ARCHIVE_BYTES, :func:`load_archives` a Spark source with a partition for each file.  The reader inflates step by step,
frames records by Content-Length and verifies the digests that a record states.  It reads archives of any origin.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 1 << 30
_STEP = 64 << 10
_RECORD_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
    ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("date", pa.string()), ("archive", pa.string()),
])


def base32_sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1, as WARC digests have it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A urn:uuid that holds the page's id in its low 64 bits (bit 64 is set if there is one)."""
    number = 0x6F6C69676F008000 << 64 if page_id is None else (0x6F6C69676F008001 << 64) | (page_id & (2**64 - 1))
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(identifier: str | None) -> int | None:
    """The page id that :func:`record_id` put into an identifier; None for identifiers of other writers."""
    try:
        number = uuid.UUID((identifier or "").strip()[10:-1]).int
    except ValueError:
        return None
    low = number & (2**64 - 1)
    return None if number >> 64 != 0x6F6C69676F008001 else low - 2**64 if low >= 2**63 else low


def digest_matches(said: str, found: dict[str, bytes]) -> bool:
    """Whether a stated digest (algorithm:value, base 32 or base 16) is the one found; ``found`` holds the data's digests by algorithm.
    Algorithms that are not at hand are not judged."""
    name, _, value = said.partition(":")
    if name.lower() not in found:
        return True
    raw = found[name.lower()]
    return value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=") or value.lower() == binascii.hexlify(raw).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One gzip member with a response record, or with a revisit record that has HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in url or "about:blank" if c not in "\r\n")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    plain = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(plain) + z.flush()


class Inflater:
    """The plain bytes of a series of gzip members, inflated a step at a time as they are read; a source that isn't gzip is passed on."""

    def __init__(self, source) -> None:
        self.source, self.z, self.rest, self.plain, self.seen, self.zipped = source, zlib.decompressobj(31), b"", bytearray(), False, None

    def fill(self) -> bool:
        """Inflate one more step; False at the end of the source."""
        data = self.rest or self.source.read(_STEP)
        self.rest = b""
        if not data:
            if self.seen:
                raise ValueError("the archive ends inside a gzip member")
            return False
        if self.zipped is None:
            self.zipped = data[:2] == b"\x1f\x8b"
        if not self.zipped:
            self.plain += data
            return True
        self.seen = True
        self.plain += self.z.decompress(data, 4 * _STEP)
        if self.z.eof:
            self.rest, self.z, self.seen = self.z.unused_data, zlib.decompressobj(31), False
        else:
            self.rest = self.z.unconsumed_tail
        return True

    def some(self, most: int) -> bytes:
        """The next bytes, up to so many; not none."""
        while not self.plain:
            if not self.fill():
                raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.plain[:most])
        del self.plain[:most]
        return out

    def take(self, n: int) -> bytes:
        """Exactly ``n`` bytes."""
        out = bytearray()
        while len(out) < n:
            out += self.some(n - len(out))
        return bytes(out)

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        while (k := self.plain.find(b"\n")) < 0:
            if not self.fill():
                if self.plain.strip(b"\r\n\0"):
                    raise ValueError("the archive ends inside a header line")
                return None
        return self.take(k + 1).rstrip(b"\r\n")


class Hashes:
    """Digests of a stream of bytes, and its length."""

    def __init__(self) -> None:
        self.all, self.size = {x: hashlib.new(x) for x in ("sha1",)}, 0

    def update(self, data: bytes) -> None:
        self.size += len(data)
        for h in self.all.values():
            h.update(data)

    def found(self) -> dict[str, bytes]:
        return {name: h.digest() for name, h in self.all.items()}


def _http_length(head: bytes) -> int | None:
    """Content-Length of an HTTP head, if it has one."""
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def read_records(source, payloads: bool = True) -> Iterator[dict]:
    """Response, revisit and resource records of one archive in order, as dicts of _RECORD_SCHEMA without ``archive``.

    Other kinds (warcinfo, request, metadata, ...) are framed, verified and passed over.  Digests are optional; those that are
    stated with SHA-1 are verified.  An HTTP head may lack a length.  Without ``payloads`` a payload is read in steps and never held,
    so its length doesn't matter; with them a record must fit in memory.  Raises ValueError on bad framing or a digest that doesn't match.
    """
    stream = Inflater(source)
    while True:
        first = stream.line()
        while first == b"":  # blank lines between records
            first = stream.line()
        if first is None:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head: dict[str, str] = {}
        while line := stream.line():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                head[name.strip().lower()] = value.strip()
        if not head.get("content-length", "").isdigit():
            raise ValueError(f"record {head.get('warc-record-id')} has no Content-Length")
        kind, left = head.get("warc-type", "").lower(), int(head["content-length"])
        http = head.get("content-type", "").lower().startswith("application/http")
        block, payload, kept, start = Hashes(), Hashes(), [], bytearray() if http else None
        while left:
            data = stream.some(min(left, _STEP))
            left -= len(data)
            block.update(data)
            if start is not None:  # still in the HTTP head
                since = max(len(start) - 3, 0)
                start += data
                if (at := start.find(b"\r\n\r\n", since)) < 0:
                    continue
                http_head, data, start = bytes(start[:at]), bytes(start[at + 4 :]), None
            payload.update(data)
            if payloads:
                kept.append(data)
        if start is not None:
            http_head = bytes(start)
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")
        if not digest_matches(head.get("warc-block-digest", ""), block.found()):
            raise ValueError(f"block digest of {head.get('warc-record-id')} doesn't match")
        if kind not in ("response", "revisit", "resource"):
            continue
        revisit, said = kind == "revisit", head.get("warc-payload-digest")
        chunked = http and b"transfer-encoding: chunked" in http_head.lower()
        if not revisit and not chunked and not digest_matches(said or "", payload.found()):
            raise ValueError(f"payload digest of {head.get('warc-record-id')} doesn't match")
        length = (_http_length(http_head) if http else None) if revisit else payload.size
        said = said.partition(":")[2] if said and said.lower().startswith("sha1:") else None if revisit else base64.b32encode(payload.found()["sha1"]).decode()
        yield {
            "page_id": page_of(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": kind, "payload_bytes": length, "payload_digest": said,
            "refers_to": page_of(head.get("warc-refers-to")) if revisit else None, "payload": b"".join(kept) if payloads and not revisit else None,
            "record_id": head.get("warc-record-id"), "refers_to_id": head.get("warc-refers-to"), "date": head.get("warc-date"),
        }


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to) of all pages; refers_to is set for those that revisit another one.

    Of pages with equal payloads of at least ``min_bytes`` bytes the largest page_id answers; a null id
    is smaller than any.  The aggregate is partial on each task, so thousands of copies send a row each
    task; the join back is one that Spark can split if a payload is hot.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("_key"))
    p = p.withColumn("_key", F.when(F.octet_length("html") >= min_bytes, F.col("_key")))
    best = p.where("_key IS NOT NULL").groupBy("_key").agg(F.max("page_id").alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    revisit = F.col("_best").isNotNull() & ~F.col("_best").eqNullSafe(F.col("page_id"))
    return p.join(best, "_key", "left").select("page_id", "url", "html", F.when(revisit, F.col("_best")).alias("refers_to"))


@dataclass
class Written(WriterCommitMessage):
    """Names of the files of a task that succeeded."""

    files: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Writes files of a task under names that no other attempt has; those of this job's attempts that didn't count are removed at the end.

    Every name begins with the job's id.  Files of other names, earlier archives above all, are never touched.
    """

    def __init__(self, options) -> None:
        self.path, self.bytes, self.date, self.job = options["path"], int(options["archiveBytes"]), options["date"], options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder)
        name, files, out, size = f"{self.job}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], None, 0
        for batch in iterator:
            for page_id, url, html, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    files.append(f"{name}-{len(files):04d}.warc.gz")
                    out, size = store.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                record = write_record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers.as_py(), refers.is_valid, self.date)
                out.write(record)
                size += len(record)
                if size >= self.bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder)
        counted = {x for m in messages if m for x in m.files}
        for f in store.get_file_info(fs.FileSelector(folder)):
            if f.base_name.startswith(f"{self.job}-") and f.base_name not in counted:
                store.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        self.commit([])


class ArchiveFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ArchiveReader(DataSourceReader):
    """A partition for each archive, read from its beginning to its end."""

    def __init__(self, options) -> None:
        self.path, self.payloads = options["path"], options.get("payloads", "true").lower() == "true"

    def partitions(self) -> list[ArchiveFile]:
        store, folder = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(folder)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder, recursive=True))
        return [ArchiveFile(f.path) for f in found if f.type == fs.FileType.File and f.base_name.endswith((".warc.gz", ".warc"))]

    def read(self, partition: ArchiveFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in for no partitions
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.path, compression=None) as f:
            yield from _batches(read_records(f, self.payloads), partition.path)


def _batches(records: Iterator[dict], archive: str) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for r in records:
        rows.append(r | {"archive": archive})
        held += len(r["payload"] or b"")
        if len(rows) >= 2000 or held > 8 << 20:
            yield pa.RecordBatch.from_pylist(rows, _RECORD_SCHEMA)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _RECORD_SCHEMA)


class Archives(DataSource):
    """.warc.gz files of a folder in a store that Arrow's file systems reach (file, hdfs, s3, gs, abfs)."""

    @classmethod
    def name(cls) -> str:
        return "oligoflow_warc"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, {pa.int64(): T.LongType(), pa.binary(): T.BinaryType()}.get(f.type, T.StringType())) for f in _RECORD_SCHEMA])

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def _uri(path: str) -> str:
    return path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:")


def save_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, append: bool = False) -> None:
    """Write ``pages`` (page_id, url, html) to .warc.gz files in a folder, one gzip member for each row.

    The folder must be new or empty (FileExistsError); with ``append`` files are added to what it holds.  A write that fails removes its own
    files; if the driver is killed they stay, and their names all begin with that job's id.

    Null html is an empty payload; rows that repeat a page_id get a record each (equal payloads of the
    largest id are all responses); a null id is smaller than any; other columns of ``pages`` are not read; no pages, no archives.
    A payload must fit in a task's memory, an archive needn't.  Tasks write under names of their own attempt, so a lost executor costs
    its tasks only.
    """
    uri = _uri(path)
    if not append:
        store, folder = fs.FileSystem.from_uri(uri)
        if store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            raise FileExistsError(f"{path} is not empty")
    pages.sparkSession.dataSource.register(Archives)
    options = {"archiveBytes": archive_bytes, "date": date, "job": f"part-{uuid.uuid4().hex}"}
    plan_revisits(pages, min_bytes).write.format("oligoflow_warc").options(**options).mode("append").save(uri)


def load_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Page records of the .warc.gz and .warc files under ``path``, read as streams and verified; ``payloads`` False leaves those null.

    ``page_id`` and ``refers_to`` are null for records of other writers; ``record_id`` and ``refers_to_id`` are always there.
    """
    spark.dataSource.register(Archives)
    return spark.read.format("oligoflow_warc").option("payloads", payloads).load(_uri(path))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The same of whole archives as rows (archive, content), for stores that only Spark's binaryFile source reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches(read_records(io.BytesIO(content.as_buffer()), payloads), name.as_py())

    return archives.select("archive", "content").mapInArrow(run, Archives({}).schema())
