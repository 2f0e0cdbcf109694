from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqframe import errors
from seqframe.functions import alphabet as al
from seqframe.functions import buffers
from seqframe.functions import sequences as sq
from seqframe.functions import sql as sqlfunctions
from seqframe.operators import frames, kmers, records

HBB = "ATGGTGCACCTGACTCCTGAGGAGAAGTCTGCCGTTACTGCCCTGTGGGGCAAGGTGAACGTGGATGAAGTTGGTGGTGAGGCCCTGGGCAGGCTGCTGGTGGTCTACCCTTGGACCCAGAGGTTCTTTGAGTAA"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_canonical_and_types(spark):
    s = F.col("s")
    assert one(spark, al.canonical_nucleotides(s), s="acgUu-.nRy") == "ACGTT--NNN"
    assert one(spark, al.canonical_protein(s), s="acdBzJ*-. ") == "ACDXXX*-XX"
    assert one(spark, al.detect_type(s), s="ACGTNRYK") == "nucleotide"
    for c in "EFILPQefilpq*":
        assert one(spark, al.detect_type(s), s=f"ACG{c}") == "protein"
    assert one(spark, al.codes(s), s="ACGTN-") == [0, 1, 2, 3, 31, 25]
    assert one(spark, al.codes(s, protein=True), s="ACY*-X") == [4, 5, 23, 24, 25, 31]
    assert one(spark, al.letters(al.codes(s, protein=True), protein=True), s="ACY*-X") == "ACY*-X"
    assert one(spark, al.codes(s), s="") == []


def test_reverse_complement_twice_is_itself(spark):
    rows = spark.range(200).select(F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGTNACG-TACGTAC").alias("s"))
    assert rows.where(al.reverse_complement(al.reverse_complement(F.col("s"))) != F.col("s")).isEmpty()
    assert one(spark, al.reverse_complement(F.col("s")), s="AACN-T") == "A-NGTT"


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text("ACGTN-", max_size=60)), max_size=12), st.sampled_from([1, 7, 1 << 20]))
def test_packing_round_trip(seqs, most):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sq, "row_blocks", lambda bounds: buffers.row_blocks(bounds, most))
        packed = sq.pack_column(pa.array(seqs, pa.string()), al.NUCLEOTIDE_CODES, al.UNKNOWN)
        for s, raw in zip(seqs, packed.to_pylist(), strict=True):
            if s is None:
                assert raw is None
                continue
            assert len(raw) == (5 * len(s) + 7) // 8
            bits = "".join(f"{al.NUCLEOTIDE_CODES[c]:05b}" for c in s)
            assert "".join(f"{b:08b}" for b in raw).rstrip("0") == bits.rstrip("0")
        sizes = pa.array([None if s is None else len(s) for s in seqs], pa.int32())
        assert sq.unpack_column(packed, sizes, al.NUCLEOTIDE_CODES).to_pylist() == seqs


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text("ACGTNé", max_size=40)), max_size=12), st.booleans(), st.sampled_from(["strict", "alias"]), st.sampled_from([1, 1 << 20]))
def test_translation_against_plain_python(seqs, to_stop, ambiguous, most):
    def plain(s):
        out = ""
        for i in range(0, len(s) - 2, 3):
            place = [al.NUCLEOTIDE_CODES.get(c, al.UNKNOWN) for c in s[i : i + 3]]
            at = 16 * place[0] + 4 * place[1] + place[2]
            known = at < 64 if ambiguous == "alias" else max(place) < 4
            out += sq.GENETIC_CODE[at] if known else "X"
        return out.split("*")[0] if to_stop else out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sq, "row_blocks", lambda bounds: buffers.row_blocks(bounds, most))
        got = sq.translate_column(pa.array(seqs, pa.string()), ambiguous, to_stop).to_pylist()
    assert got == [None if s is None else plain(s) for s in seqs]


def test_proteins_are_guarded(spark):
    rows = spark.createDataFrame([("ACGTACG",), ("MKACGTWEF",), ("",)], "seq string")
    assert [r[0] for r in rows.select(sq.gc_content(F.col("seq"), strict=False)).collect()] == [4 / 7, None, 0.0]
    assert {r["kmer"]: r["n"] for r in kmers.spectrum(rows, 3, strict=False).collect()} == {"ACG": 2, "CGT": 1, "GTA": 1, "TAC": 1}
    for df in (rows.select(sq.gc_content(F.col("seq"))), kmers.spectrum(rows, 3), kmers.dense_spectrum(rows, 2), kmers.kmer_set(rows, 4)):
        with pytest.raises(Exception, match="a protein where only nucleotide"):
            df.collect()
    typed = spark.createDataFrame([("MKV", "protein"), ("GGC", "nucleotide")], "seq string, seq_type string")
    assert [r[0] for r in typed.select(sq.gc_content(F.col("seq"), F.col("seq_type"), strict=False)).collect()] == [None, 1.0]


def test_offsets_and_access(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i % 5) for i in range(101)], "id long, n int")
    got = records.offsets(rows, "id", F.col("n"), chunks=9).orderBy("id").collect()
    total = 0
    for r in got:
        assert (r["start"], r["stop"]) == (total, total + r["n"])
        total += r["n"]
    assert len(got) == 101 and records.offsets(rows.limit(0), "id", F.col("n")).count() == 0
    for i in (0, 5, 100, -1, -101):
        assert records.record_at(rows, "id", i).first()["id"] == list(range(101))[i]
    assert records.record_at(rows, "id", 101).isEmpty() and records.record_at(rows, "id", -102).isEmpty()


def test_packing_in_spark(spark):
    assert one(spark, sq.unpack_protein(sq.pack_protein("s"), F.lit(6)), s="MKV*-X") == "MKV*-X"
    with pytest.raises(ValueError):
        sq.unpack_column(pa.array([b"\0"]), pa.array([2]), al.NUCLEOTIDE_CODES)
    with pytest.raises(errors.SeqError):
        sq.unpack_column(pa.array([b"\0"]), pa.array([-1]), al.NUCLEOTIDE_CODES)
    assert one(spark, sq.packed_size(F.col("n")), n=13) == 9
    assert one(spark, sq.memory_ratio(F.col("s")), s="") == 1.0


def test_slices_match_python(spark):
    text = "ACGTTGCAAC"
    bounds = [None, -12, -3, 0, 2, 7, 15]
    cases = [(a, b, c) for a in bounds for b in bounds for c in (1, 2, 3, -1, -2)]
    row = spark.createDataFrame([(text,)], "s string").select(*(sq.slice_sequence(F.col("s"), *c).alias(f"x{i}") for i, c in enumerate(cases))).first()
    for i, (a, b, c) in enumerate(cases):
        assert row[i] == text[a:b:c], (a, b, c)
    with pytest.raises(errors.SeqValueError):
        sq.slice_sequence(F.col("s"), step=0)


def test_symbol_at(spark):
    s = F.col("s")
    assert [one(spark, sq.symbol_at(s, i), s="ACG") for i in (0, 2, -1, -3, 3, -4)] == ["A", "G", "G", "A", None, None]
    with pytest.raises(Exception, match="out of range"):
        one(spark, sq.symbol_at(s, 3, strict=True), s="ACG")


def test_metrics(spark):
    assert one(spark, sq.gc_content(F.col("s")), s="GGCN") == 0.75
    assert one(spark, sq.gc_content(F.col("s")), s="") == 0.0
    assert one(spark, sq.mean_quality(F.col("q")), q="I5!") == 20.0
    assert one(spark, sq.mean_quality(F.col("q")), q="") == 0.0
    assert one(spark, sq.mean_quality(F.col("q")), q=None) is None
    many = spark.createDataFrame([("I" * i + "€" * (i % 2),) for i in range(50)], "q string")
    assert many.where(sq.quality_sum("q") != F.aggregate(sq.quality_scores(F.col("q")), F.lit(0).cast("long"), lambda t, x: t + x)).isEmpty()
    assert one(spark, sq.quality_scores(F.col("q")), q="!I\x7f") == [0, 40, 93]
    assert one(spark, sq.passes_quality(F.col("q"), 20), q="I5!") is True
    assert one(spark, sq.composition(F.col("s")), s="AACN") == {"A": 2, "C": 1, "N": 1}
    stats = one(spark, sq.sequence_stats(F.col("s")), s="AACN")
    assert (stats["n_symbols"], stats["n_packed_bytes"], stats["compression_pct"]) == (4, 3, 25.0)


def test_every_codon(spark):
    codons = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]
    got = one(spark, sq.translate_codons(F.col("s")), s="".join(codons))
    assert got == sq.GENETIC_CODE
    assert got.count("*") == 3
    assert got[codons.index("ATG")] == "M" and got[codons.index("TGG")] == "W"


def test_translation(spark):
    s = F.col("s")
    assert one(spark, sq.translate_orf(s), s=HBB) == "MVHLTPEEKSAVTALWGKVNVDEVGGEALGRLLVVYPWTQRFFE"
    assert one(spark, sq.translate_orf(s), s="CCATGAAAT") == "MK"
    assert one(spark, sq.translate_orf(s), s="ATGTAA") == "M"
    assert one(spark, sq.translate_orf(s), s="CCC") is None
    assert one(spark, sq.find_orf(s), s="CCATG") == 2 and one(spark, sq.find_orf(s), s="CC") == -1
    for bad, message in (("ATGEE", "protein"), ("AT", "three"), ("CCCC", "start")):
        with pytest.raises(Exception, match=message):
            one(spark, sq.translate_strict(s), s=bad)


def test_ambiguous_codons(spark):
    s = F.col("s")
    strict = {c: one(spark, sq.translate_codons(s), s=c) for c in ("AAN", "ACN", "NNN", "A-C")}
    assert set(strict.values()) == {"X"}
    alias = {"AAN": "L", "ACN": "D", "CTN": "C", "GAN": "F", "GCN": "X", "AGN": "A", "CAN": "V", "AA-": "R", "GC-": "F", "NAA": "X"}
    for codon, residue in alias.items():
        assert one(spark, sq.translate_codons(s, "alias"), s=codon) == residue, codon
    with pytest.raises(errors.SeqValueError):
        sq.translate_codons(s, "other")


def test_codon_trace(spark):
    got = one(spark, sq.codon_trace(F.col("s")), s="CATGAAATAGC")
    assert [(r["codon"], r["residue"]) for r in got] == [("ATG", "M"), ("AAA", "K"), ("TAG", "*")]
    assert one(spark, sq.codon_trace(F.col("s")), s="CCC") is None


@pytest.mark.parametrize(
    "seq, expected",
    [
        ("ATGAAATAA", {"+1": (0, "MK")}),
        ("TTACATCAT", {"-1": (0, "MM"), "-2": (3, "M"), "-3": (3, "M")}),
        ("ATGAAATAACATATG", {"+1": (0, "MK"), "+2": (12, "M"), "+3": (12, "M"), "-1": (3, "MLFH"), "-2": (3, "MLFH"), "-3": (3, "MLFH")}),
    ],
)
def test_six_frames(spark, seq, expected):
    rows = frames.six_frames(spark.createDataFrame([(1, seq)], "id int, seq string")).collect()
    assert {r["frame"]: (r["orf"], r["protein"]) for r in rows} == expected


def test_frame_locked_starts_lie_on_codon_borders(spark):
    rows = frames.six_frames(spark.createDataFrame([(1, "CATGCATGAAATGACC")], "id int, seq string"), frame_locked=True).collect()
    assert rows and all((r["orf"] - int(r["frame"][1]) + 1) % 3 == 0 for r in rows)
    forward = {r["frame"]: r["orf"] for r in rows if r["frame"][0] == "+"}
    assert forward == {"+2": 1, "+3": 5} or forward.get("+2") == 1


def test_impact_and_names(spark):
    impact = lambda a, b: one(spark, sq.change_impact(F.col("a"), F.col("b")), a=a, b=b)
    assert all(impact(*p) == "conservative" for p in ("ED", "KR", "LV", "FY", "ST", "NQ"))
    assert all(impact(*p) == "radical" for p in ("EV", "GW", "KD", "AF"))
    assert one(spark, sq.residue_name(F.col("a")), a="E") == "Glu" and one(spark, sq.base_name(F.col("a")), a="G") == "guanine"


def test_sql_functions(spark):
    assert "seq_kmers" in sqlfunctions.register(spark)
    row = spark.sql("select seq_canonical('acgu') c, seq_gc('GGAT') g, seq_mean_quality('I5!') q, seq_orf('CATG') o, seq_revcomp('AAC') r, seq_packed_size(8) p, seq_type('MK*') t").first()
    assert tuple(row) == ("ACGT", 0.5, 20.0, 1, "GTT", 5, "protein")
    assert [r["kmer"] for r in spark.sql("select * from values ('ACGNAC') v(s), lateral seq_kmers(s, 2) order by place").collect()] == ["AC", "CG", "AC"]


def test_error_family():
    for kind, builtin in ((errors.SeqTypeError, TypeError), (errors.SeqValueError, ValueError), (errors.SeqIOError, OSError), (errors.EngineError, RuntimeError), (errors.TranslationError, ValueError), (errors.AlignmentError, ValueError)):
        assert issubclass(kind, errors.SeqError) and issubclass(kind, builtin)
    assert np.issubdtype(np.int16, np.integer)
