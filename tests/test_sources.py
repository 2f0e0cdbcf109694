from __future__ import annotations

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from seqframe import cli
from seqframe.errors import SeqIOError, SeqValueError
from seqframe.sources import bgzf, fasta, fastq
from seqframe.streaming import streams
from tests.test_functions import HBB


def random_reads(n: int, seed: int = 3, low: int = 1, high: int = 90) -> list[tuple[str, str, str]]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        m = rng.randint(low, high)
        # '@' and '+' are quality letters too
        out.append((f"read {i}", "".join(rng.choice("ACGTN") for _ in range(m)), "".join(rng.choice("!+@5I") for _ in range(m))))
    return out


def as_fastq(reads) -> str:
    return "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in reads)


def got(df) -> list[tuple]:
    return [(r["header"], r["seq"], r["qual"]) for r in df.orderBy("read_id").collect()]


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_fastq_does_not_depend_on_splits(tmp_path, split):
    reads = random_reads(40)
    path = tmp_path / "x.fastq"
    path.write_text(as_fastq(reads))
    rows = [r for part in fastq.plan(str(path), split) for batch in fastq.read_range(part) for r in batch.to_pylist()]
    assert [(r["header"], r["seq"], r["qual"]) for r in rows] == reads


@pytest.mark.parametrize("split", [1, 1 << 20])
def test_block_gzip_does_not_depend_on_splits(tmp_path, monkeypatch, split):
    monkeypatch.setattr(bgzf, "BLOCK_DATA", 97)
    reads = random_reads(60)
    path = tmp_path / "x.fastq.gz"
    path.write_bytes(bgzf.compress_bytes(as_fastq(reads).encode()))
    parts = fastq.plan(str(path), split)
    assert len(parts) > 5 or split > 1
    rows = [r for part in parts for batch in fastq.read_range(part) for r in batch.to_pylist()]
    assert [(r["header"], r["seq"], r["qual"]) for r in rows] == reads
    assert [r["read_id"] for r in rows] == sorted({r["read_id"] for r in rows})


def test_fastq_in_spark(spark, tmp_path):
    reads = random_reads(300)
    (tmp_path / "a.fastq").write_text(as_fastq(reads))
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(as_fastq(reads[:150]).encode()) + gzip.compress(as_fastq(reads[150:]).encode()))
    (tmp_path / "c.fastq.gz").write_bytes(bgzf.compress_bytes(as_fastq(reads).encode()))
    for name in "abc":
        assert got(fastq.read_fastq(spark, str(next(tmp_path.glob(f"{name}.*"))), 2000)) == reads
    assert fastq.read_fastq(spark, str(tmp_path)).count() == 900
    assert fastq.read_any(spark, str(tmp_path / "a.fastq")).count() == 300


def test_malformed_fastq(spark, tmp_path):
    path = tmp_path / "x.fastq"
    path.write_text("\n@a\nACGT\n+\nII\n\n@empty\n\n+\n\n@b\r\nacgu\r\n+\r\nIIIIII\r\n")
    rows = fastq.read_fastq(spark, str(path)).orderBy("read_id").collect()
    assert [(r["header"], r["seq"], r["qual"], r["malformed"]) for r in rows] == [("a", "ACGT", "II!!", True), ("b", "ACGT", "IIII", True)]
    (tmp_path / "none.fastq").write_text("")
    assert fastq.read_fastq(spark, str(tmp_path / "none.fastq")).count() == 0
    with pytest.raises(SeqIOError):
        fastq.plan(str(tmp_path / "missing.fastq"), 10)
    (tmp_path / "x.fa").write_text(">a\nACGT\n")
    with pytest.raises(SeqIOError):
        list(fastq.read_range(fastq.plan(str(tmp_path / "x.fa"), 10)[0]))


@pytest.mark.parametrize("chunk", [5, 64, 1000])
@pytest.mark.parametrize("kind", ["plain", "gzip", "blocks"])
def test_irregular_records_are_read_as_a_line_reader_would(tmp_path, monkeypatch, chunk, kind):
    """Blank lines, carriage returns, short qualities, empty and cut-off records, odd bytes, in chunks of any size."""
    monkeypatch.setattr(fastq, "CHUNK", chunk)
    monkeypatch.setattr(bgzf, "BLOCK_DATA", 50)
    raw = b"".join(f"@{h}\n{s}\n+\n{q}\n".encode() for h, s, q in random_reads(8)) + b"@ caf\xe9 \r\nac gu.n\r\n+x\r\nI\x01II\r\n\n@none\n\n+\n\n" + b"".join(f"@{h}\n{s}\n+\n{q}\n".encode() for h, s, q in random_reads(5, 4)) + b"lost\n@last\nACGT\n+"
    path = tmp_path / "x"
    path.write_bytes(raw if kind == "plain" else gzip.compress(raw[:200]) + gzip.compress(raw[200:]) if kind == "gzip" else bgzf.compress_bytes(raw))
    expected, lines, at = [], raw.split(b"\n"), 0
    while at < len(lines):
        if not lines[at].startswith(b"@"):
            at += 1
            continue
        head, seq, _, qual = (lines[at : at + 4] + [b""] * 3)[:4]
        at += 4
        seq, qual = seq.strip(), bytes(min(max(c, 33), 126) for c in qual.strip())
        if seq:
            text = "".join({"U": "T", ".": "-"}.get(c, c) if c in "ACGT-U." else "N" for c in seq.decode("latin-1").upper())
            expected.append((head[1:].strip().decode("utf-8", "replace"), text, qual.decode()[: len(text)].ljust(len(text), "!"), len(qual) != len(text)))
    rows = [r for part in fastq.plan(str(path), 1 << 20) for batch in fastq.read_range(part) for r in batch.to_pylist()]
    assert [(r["header"], r["seq"], r["qual"], r["malformed"]) for r in rows] == expected
    assert [r["read_id"] for r in rows] == sorted({r["read_id"] for r in rows})


def test_files_that_land_later_are_read_whatever_their_names(spark, tmp_path):
    reads = random_reads(60)
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()

    def run():
        (spark.readStream.format("fastq").load(str(folder)).select("header").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
        return sorted(r["header"] for r in spark.read.schema("header string").parquet(str(tmp_path / "out")).collect())

    fastq.register(spark)
    (folder / "m.fastq").write_text(as_fastq(reads[:20]))
    assert run() == sorted(h for h, _, _ in reads[:20])
    (folder / "a.fastq").write_text(as_fastq(reads[20:40]))
    (folder / "z.fastq").write_text(as_fastq(reads[40:]))
    assert run() == sorted(h for h, _, _ in reads)
    assert run() == sorted(h for h, _, _ in reads)


def test_format_is_told_by_the_first_file_with_data(spark, tmp_path):
    reads = random_reads(20)
    (tmp_path / "part-0.txt.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "part-1.txt").write_bytes(b"")
    (tmp_path / "part-2.txt").write_bytes(b"\n" * 5000)
    assert fastq.sniff(str(tmp_path)) == "fasta"
    (tmp_path / "part-3.txt.gz").write_bytes(gzip.compress(as_fastq(reads).encode()))
    assert fastq.sniff(str(tmp_path)) == "fastq"
    assert fastq.read_any(spark, str(tmp_path)).count() == len(reads)


def test_fasta_text(spark):
    text = "lost\n>a one\nacg\n;note\n u \n>empty\n>b\r\nMKE*\r\n"
    rows = fasta.parse_fasta(spark.createDataFrame([(7, text)], "id int, text string"), "text", "id").orderBy("seq_id").collect()
    assert [(r["id"], r["header"], r["seq_type"], r["seq"]) for r in rows] == [(7, "a one", "nucleotide", "ACGT"), (7, "b", "protein", "MKE*")]
    forced = fasta.parse_fasta(spark.createDataFrame([(">a\nACG",)], "text string"), force_type="protein").first()
    assert forced["seq_type"] == "protein"
    assert fasta.parse_fasta(spark.createDataFrame([("no mark",), ("",), (None,)], "text string")).count() == 0
    with pytest.raises(SeqValueError):
        fasta.parse_fasta(spark.createDataFrame([("",)], "text string"), force_type="x")


def test_fasta_lines_with_blanks_and_notes(spark, tmp_path):
    rng = random.Random(9)
    records = [("".join(rng.choices("ab \t", k=5)), ["".join(rng.choices("ACGTé; \t", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 5))]) for _ in range(300)]
    for end in ("\n", "\r\n"):
        text = "".join(f">{h}{end}" + "".join(x + end for x in lines) for h, lines in records)
        cleaned = [(h.rstrip("\t ").strip(" "), "".join(y for y in (x.strip("\t ") for x in lines) if not y.startswith(";"))) for h, lines in records]
        expected = [(h, re.sub("[^ACGT]", "N", x)) for h, x in cleaned if x]
        parsed = fasta.parse_fasta(spark.createDataFrame([(text,)], "text string"))
        assert [(r["header"], r["seq"]) for r in parsed.orderBy("seq_id").collect()] == expected
        (tmp_path / "x.fa").write_bytes(text.encode())
        assert [(r["header"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("seq_id").collect()] == expected


def test_a_fasta_record_is_worked_out_once(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACGT\n")
    for df in (fasta.read_fasta(spark, str(tmp_path / "x.fa")), fasta.parse_fasta(spark.createDataFrame([(">a\nA",)], "text string"))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("substring_index") == 1


@pytest.mark.parametrize("most", ["1m", "300"])
def test_fasta_file(spark, tmp_path, most):
    rng = random.Random(5)
    records = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 200)))) for i in range(200)]
    path = tmp_path / "x.fa"
    path.write_text("".join(f">{h}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for h, s in records))
    (tmp_path / "x.fa.gz").write_bytes(gzip.compress(path.read_bytes()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    try:
        for name in (path, tmp_path / "x.fa.gz"):
            # in the order of the file, however it is split
            assert [(r["header"], r["seq"]) for r in fasta.read_fasta(spark, str(name)).orderBy("seq_id").collect()] == records
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    fasta.write_fasta(fasta.read_fasta(spark, str(path)), str(tmp_path / "out"), 50)
    assert sorted((r["header"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()) == sorted(records)


def test_block_gzip(tmp_path):
    rng = random.Random(1)
    for data in (b"", b"x", rng.randbytes(200_000), b"ACGT" * 50_000):
        packed = bgzf.compress_bytes(data)
        assert gzip.decompress(packed) == data == bgzf.inflate(packed) and packed.endswith(bgzf.END)
    path = tmp_path / "x.txt"
    path.write_bytes(b"hello" * 30_000)
    out = bgzf.compress_file(str(path))
    assert gzip.open(out).read() == b"hello" * 30_000
    with open(out, "rb") as f:
        sizes = list(bgzf.block_sizes(f))
    assert len(sizes) == 4 and sum(n for _, n in sizes) == len(open(out, "rb").read())
    with pytest.raises(ValueError):
        bgzf.compress_file(str(path), str(path))
    with pytest.raises(SeqValueError):
        bgzf.compress_bytes(b"x", 13)
    with pytest.raises(OSError):
        bgzf.compress_file(str(tmp_path / "none"))


def test_block_gzip_files_replace_older_ones(spark, tmp_path):
    lines = spark.range(100).selectExpr("cast(id as string) as v")
    bgzf.write_block_gzip(lines.repartition(6), str(tmp_path / "o"))
    names = bgzf.write_block_gzip(lines.limit(10).coalesce(1), str(tmp_path / "o"))
    assert sorted(str(x) for x in (tmp_path / "o").glob("*.gz")) == names
    assert sorted(gzip.open(names[0]).read().split()) == sorted(str(i).encode() for i in range(10))


def test_streams(spark, tmp_path):
    (tmp_path / "fa").mkdir()
    (tmp_path / "fa" / "x.fa").write_text(">a\nACGT\nAC\n>b\nGGG\n")
    table = streams.run_once(streams.running_spectrum(streams.stream_fasta(spark, str(tmp_path / "fa")), 2), "fa_counts")
    assert {r["kmer"]: r["n"] for r in table.collect()} == {"AC": 2, "CG": 1, "GT": 1, "TA": 1, "GG": 2}
    (tmp_path / "fq").mkdir()
    reads = random_reads(50)
    (tmp_path / "fq" / "1.fastq").write_text(as_fastq(reads))
    table = streams.run_once(streams.stream_fastq(spark, str(tmp_path / "fq")).groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("n_symbols").alias("bases")), "fq_counts")
    assert tuple(table.first()) == (50, sum(len(s) for _, s, _ in reads))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(f">normal\n{HBB}\n")
    (tmp_path / "b.fa").write_text(f">sickle\n{HBB[:19]}T{HBB[20:]}\n")
    (tmp_path / "r.fastq").write_text(as_fastq(random_reads(20)))
    assert cli.main(["mutations", str(tmp_path / "a.fa"), str(tmp_path / "b.fa"), "--out", str(tmp_path / "report")]) == 0
    assert "Glu to Val" in (tmp_path / "report").read_text()
    assert cli.main(["qc", str(tmp_path / "r.fastq")]) == 0 and "reads 20" in capsys.readouterr().out
    assert cli.main(["bgzip", str(tmp_path / "r.fastq")]) == 0 and (tmp_path / "r.fastq.gz").exists()
    assert cli.main(["qc", str(tmp_path / "none.fastq")]) == 1
    assert cli.main(["bgzip", str(tmp_path / "r.fastq"), "--level", "99"]) == 1
