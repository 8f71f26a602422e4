"""FASTQ records of one or many lines in files of one or many blocks."""

import gzip
import random

import pyarrow as pa
import pytest

from oligoflow.sources import fastq, files


def made(rng: random.Random, n: int, wrap: int | None) -> tuple[list[tuple], str]:
    """Records, and their text with lines of at most ``wrap`` characters.  Quality lines begin with @ or + as often as can be."""
    rows, lines = [], []
    for k in range(n):
        size = rng.choice([1, 3, 8, 30, 61])
        row = (f"r{k} x", "".join(rng.choice("ACGTN") for _ in range(size)), "".join(rng.choice("@+@+I#") for _ in range(size)))
        rows.append(row)
        step = wrap or size
        lines += [f"@{row[0]}", *[row[1][at : at + step] for at in range(0, size, step)], "+" + rng.choice(["", row[0]]), *[row[2][at : at + step] for at in range(0, size, step)]]
    return rows, "\n".join(lines) + "\n"


@pytest.mark.parametrize("wrap", [None, 7, 1, 60])
def test_wrapped_records_in_many_blocks(spark, tmp_path, wrap):
    for size in (64, 300, 4096, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rng = random.Random(size)
            folder = tmp_path / f"{size}"
            folder.mkdir()
            want = []
            for name in ("a.fq", "b.fq"):
                rows, text = made(rng, 40 if size < 4096 else 400, wrap)
                (folder / name).write_text(text)
                want += rows
            rows, text = made(rng, 50, wrap)
            (folder / "c.fq.gz").write_bytes(gzip.compress(text.encode()))
            got = fastq.read_fastq(spark, str(folder))
            assert sorted(map(tuple, got.collect())) == sorted(want + rows)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lucky_parses_don_t_count(spark, tmp_path):
    """Quality that looks like whole records: a block that begins inside it parses, and is found out."""
    fake = ["@f", "ACGT", "+", "IIII"]
    rows = [(f"r{k}", "A" * sum(map(len, fake * 30)), "".join(fake * 30)) for k in range(4)]
    text = "".join("\n".join([f"@{i}", s, "+", *fake * 30]) + "\n" for i, s, _ in rows)
    (tmp_path / "x.fq").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = fastq.read_fastq(spark, str(tmp_path / "x.fq"))
        assert sorted(map(tuple, got.collect())) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", ["@a\nACGT\n+\nII\n", "@a\nACGT\n+\nIIIII\n", "ACGT\n", "@a\nACGT\n@b\nAC\n+\nII\n", "@a\nAC\n+\nII\n@b\n"])
def test_broken_files_are_refused(spark, tmp_path, text):
    (tmp_path / "x.fq").write_text(text)
    with pytest.raises(Exception, match="quality|record|cut short"):
        fastq.read_fastq(spark, str(tmp_path / "x.fq")).collect()


def test_odd_lines(spark, tmp_path):
    (tmp_path / "x.fq").write_bytes(b"\r\n\n@a\r\nAC\r\nGT\r\n+a\r\n@+\r\nII\r\n\n@b\r\n\r\n+\r\n\r\n@c d\nG\n+\n@")
    assert sorted(map(tuple, files.read_sequences(spark, str(tmp_path / "x.fq")).collect())) == [("a", "ACGT", "@+II"), ("b", "", ""), ("c d", "G", "@")]


def test_wrapped_records_are_parsed_by_columns(monkeypatch):
    """Records of as many lines each don't go through the grammar line by line, but for the first."""
    rows = [(f"r{k}", "ACGTACGTAC"[k % 2 :] + "GGTTA", "@+I#IIIIII"[k % 2 :] + "+@III") for k in range(1000)]
    lines = [x for i, s, q in rows for x in (f"@{i}", s[:10], s[10:], "+", q[:10], q[10:])]
    fed, feed = [], fastq.Grammar.feed
    monkeypatch.setattr(fastq.Grammar, "feed", lambda self, line: fed.append(line) or feed(self, line))
    block = fastq.Block("x", 0)
    batches = [b for lo in range(0, len(lines), 700) for b in block.take(pa.array(lines[lo : lo + 700]), False)] + list(block.take(pa.array([], pa.string()), True))
    assert [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)] == rows and len(fed) < 20


def test_records_are_parsed_once(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nAC\n+\nII\n")
    got = fastq.read_fastq(spark, str(tmp_path / "x.fq"))
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString() and [tuple(r) for r in got.collect()] == [("a", "AC", "II")]
