"""Block-compressed files read by several tasks against the same text in plain files."""

import gzip
import io
import random
import zlib

import pyarrow as pa
import pytest

from oligoflow.sources import bgzf, files


def blocked(data: bytes, rng: random.Random, most: int = 300) -> bytes:
    """``data`` as members of random sizes with their sizes in the header, and the empty member at the end."""
    out = io.BytesIO()
    at = 0
    while at <= len(data):
        part = data[at : at + rng.randrange(1, most)] if at < len(data) else b""
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.write(b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
        at += max(len(part), 1)
    return out.getvalue()


@pytest.mark.parametrize("separator", [b"\n", b"\n>"])
def test_ranges_give_each_stretch_once(separator):
    rng = random.Random(1)
    for text in (b"", b"\n", b"one", b"a\nb\n\nc", b"\n".join(bytes(rng.choice(b"ACG>") for _ in range(rng.randrange(60))) for _ in range(200)), b">long" + b"x" * 5000 + b"\n>y\n"):
        for most in (3, 40, 3000):
            data = blocked(text, rng, most)
            assert gzip.decompress(data) == text
            file = pa.PythonFile(io.BytesIO(data), mode="r")
            want = text.split(separator)
            want = want[:-1] if want[-1] == b"" else want
            for step in (7, 60, 500, 1 << 20):
                got = [x for at in range(0, max(len(data), 1), step) for x in bgzf.pieces(file, at, at + step, separator)]
                assert got == want


def test_magic_inside_data_is_no_member():
    rng = random.Random(2)
    inner = b"\x1f\x8b\x08\x04" + bytes(6) + b"\x06\x00BC\x02\x00\x10\x00" + bytes(40)
    text = (inner + rng.randbytes(50) + b"\n") * 60
    parts = []
    for k in range(0, len(text), 900):  # stored, not deflated: the magic stands in the file as it is
        part = text[k : k + 900]
        body = b"\x01" + len(part).to_bytes(2, "little") + (len(part) ^ 0xFFFF).to_bytes(2, "little") + part
        parts.append(b"\x1f\x8b\x08\x04" + bytes(6) + b"\x06\x00BC\x02\x00" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
    data = b"".join(parts)
    assert gzip.decompress(data) == text
    file = pa.PythonFile(io.BytesIO(data), mode="r")
    for step in (10, 333, 5000):
        assert b"\n".join(x for at in range(0, len(data), step) for x in bgzf.pieces(file, at, at + step, b"\n")) + b"\n" == text


def test_files_are_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    fastq = "".join(f"@r{k}\n{s}\n+\n{'@' * len(s)}\n" for k, s in enumerate(seqs)).encode()
    fasta = "".join(f">Rank={k + 1};Reads={k}\n{s[:40]}\n{s[40:]}\n" for k, s in enumerate(seqs)).encode()
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.fq.gz").write_bytes(blocked(fastq, rng))
    (folder / "b.fq.gz").write_bytes(gzip.compress(b"@plain\r\nAC\r\n+\r\nII\r\n"))
    (folder / "c.fq").write_bytes(b"@text\nAG\n+\nII\n")
    (tmp_path / "x.fasta.gz").write_bytes(blocked(fasta, rng))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        text = bgzf.read_text(spark, str(folder / "a.fq.gz"))
        assert text.rdd.getNumPartitions() > 3 and text.select("start").distinct().count() > 3
        want = [(f"r{k}", s, "@" * len(s)) for k, s in enumerate(seqs)]
        assert sorted(map(tuple, files.read_sequences(spark, str(folder / "a.fq.gz")).collect())) == sorted(want)
        assert sorted(map(tuple, files.read_fastq(spark, str(folder)).collect())) == sorted([*want, ("plain", "AC", "II"), ("text", "AG", "II")])
        got = files.read_sequences(spark, str(tmp_path / "x.fasta.gz")).orderBy("Rank").collect()
        assert [(r.Rank, r.Reads, r.sequences) for r in got] == [(k + 1, k, s) for k, s in enumerate(seqs)]
        damaged = bytearray(blocked(fastq, rng))
        damaged[len(damaged) // 2] ^= 255
        (tmp_path / "d.fq.gz").write_bytes(damaged)
        with pytest.raises(Exception, match="damaged|member|Error"):
            files.read_fastq(spark, str(tmp_path / "d.fq.gz")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
