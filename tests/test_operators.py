from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqframe import report
from seqframe.errors import AlignmentError, SeqError, SeqValueError
from seqframe.operators import alignment as an
from seqframe.operators import kmers, mutations
from seqframe.operators import quality_control as qc
from seqframe.plans.views import spread
from tests.test_functions import HBB

SICKLE = HBB[:19] + "T" + HBB[20:]


def slow_score(a: str, b: str, mode: str = "global", band: int | None = None) -> int | None:
    """The classic recurrence, a cell at a time."""
    free, never = mode != "global", -(10**9)
    h = [[never] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if band is not None and abs(i - j) > band:
                continue
            if i == 0 or j == 0:
                h[i][j] = 0 if free else -2 * (i + j)
                continue
            h[i][j] = max(h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 2, h[i][j - 1] - 2)
            if mode == "local":
                h[i][j] = max(0, h[i][j])
    if mode == "global":
        return h[-1][-1]
    return max(map(max, h)) if mode == "local" else max(*h[-1], *(r[-1] for r in h))


def rescored(r: dict) -> int:
    return sum(-2 if "-" in (x, y) else 2 if x == y else -1 for x, y in zip(r["aligned_a"], r["aligned_b"], strict=True))


dna = st.text("ACGT", min_size=1, max_size=40)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(dna, dna), min_size=1, max_size=6), st.sampled_from(["global", "semi-global", "local"]))
def test_batches_match_the_classic_recurrence(pairs, mode):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for x, y, r in zip(a, b, an.align_batch(a, b, mode), strict=True):
        assert r["score"] == slow_score(x, y, mode) == rescored(r)
        assert r["aligned_a"].replace("-", "") == x[r["a_start"] : r["a_end"]]
        assert r["aligned_b"].replace("-", "") == y[r["b_start"] : r["b_end"]]
        assert r["n_matches"] + r["n_mismatches"] + r["n_gaps"] == len(r["aligned_a"])
        assert len(r["mutations"]) == r["n_mismatches"] + r["n_gaps"]
        for m in r["mutations"]:
            if m["kind"] != "insertion":
                assert x[m["pos_a"]] == m["sym_a"]
            if m["kind"] != "deletion":
                assert y[m["pos_b"]] == m["sym_b"]


edits = st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["", "A", "C", "AC", "CAA"]), st.integers(0, 3)), max_size=5)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("AC", min_size=12, max_size=60), edits), min_size=1, max_size=6))
def test_like_pairs_are_aligned_as_by_the_whole_matrix(pairs):
    """Ties, too: with two letters there are many."""
    a, b = [x for x, _ in pairs], []
    for x, changes in pairs:
        for at, put, lost in changes:
            x = x[:at] + put + x[at + lost :]
        b.append(x or "A")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(an, "_reaches", lambda x, y, good: ([], good))
        whole = an.align_batch(a, b)
    assert an.align_batch(a, b) == whole


def test_like_pairs_fill_no_whole_matrix(monkeypatch):
    monkeypatch.setattr(an, "fill", None)
    x = HBB[:102]
    got = an.align_batch([x, x, x, x], [x, x[:50] + "T" + x[51:], x[:20] + x[21:], x[:30] + "GGG" + x[33:]])
    assert [r["score"] for r in got] == [slow_score(x, y) for y in (x, x[:50] + "T" + x[51:], x[:20] + x[21:], x[:30] + "GGG" + x[33:])]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(dna, dna), min_size=1, max_size=5), st.integers(1, 12))
def test_banded(pairs, band):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for x, y, r in zip(a, b, an.align_batch(a, b, band=band), strict=True):
        if abs(len(x) - len(y)) > band:
            assert r["score"] is None and "band" in r["problem"]
        else:
            assert r["score"] == slow_score(x, y, band=band) == rescored(r)


@settings(max_examples=30, deadline=None)
@given(dna)
def test_self_alignment(s):
    (r,) = an.align_batch([s], [s])
    assert r["score"] == 2 * len(s) and r["identity"] == 1.0 and not r["mutations"]


def test_known_alignments():
    ref = HBB[:30]
    (r,) = an.align_batch([ref], [ref[:19] + "T" + ref[20:]])
    assert (r["score"], r["n_matches"], r["n_mismatches"], r["n_gaps"]) == (57, 29, 1, 0)
    assert r["mutations"] == [{"kind": "substitution", "pos_a": 19, "pos_b": 19, "sym_a": "A", "sym_b": "T"}]
    (r,) = an.align_batch(["ATGGTGCACCTGACTGAA"], ["ATGGTGCACCTGACTCCCGAA"])
    assert r["score"] == 30 and r["aligned_a"] == "ATGGTGCACCTGACT---GAA"
    (r,) = an.align_batch([HBB], [SICKLE])
    assert r["score"] == 267 and round(r["identity"], 6) == 0.992593
    (r,) = an.align_batch(["ACGT"], ["TGCA"])
    assert r["score"] == -4
    (r,) = an.align_batch(["AAAAAATGCATGCAAAAAA"], ["TTTTTTATGCATGCTTTTT"], "local")
    assert (r["score"], r["aligned_a"], r["a_start"], r["a_end"], r["b_start"], r["b_end"]) == (16, "ATGCATGC", 5, 13, 6, 14)
    (r,) = an.align_batch([ref], ["CCTGAGGAG"], "semi-global")
    assert (r["score"], r["n_matches"], r["a_start"], r["a_end"]) == (18, 9, 15, 24)


def test_alignment_problems(spark):
    got = [r["problem"] for r in an.align_batch([None, "", "A-C", "A" * 20], ["A", "A", "A", "A" * 20], most=10)]
    assert got[0].startswith("missing") and got[1].startswith("empty") and "gap" in got[2] and "longer" in got[3]
    with pytest.raises(AlignmentError):
        an.align_batch([""], ["A"], strict=True)
    with pytest.raises(AlignmentError):
        an.align_batch(["A"], ["A"], "other")
    with pytest.raises(AlignmentError):
        an.align_batch(["A"], ["A"], band=0)
    with pytest.raises(ValueError):
        an.format_alignment(F.col("a"), F.col("b"), 0)
    row = an.align_pairs(spark.createDataFrame([("ACGT", None)], "a string, b string")).first()["alignment"]
    assert row["score"] is None and row["problem"] == "missing sequence"


def test_long_pairs_go_in_several_calls(monkeypatch):
    monkeypatch.setattr(an, "CELLS", 500)
    a = ["ACGT" * k for k in range(1, 9)]
    assert [r["score"] for r in an.align_batch(a, a)] == [8 * k for k in range(1, 9)]


def test_format(spark):
    row = spark.createDataFrame([("ACGT-A", "AC-TTC")], "a string, b string").select(an.format_alignment(F.col("a"), F.col("b"), 4).alias("x")).first()
    assert row["x"] == "ACGT\n|| |\nAC-T\n\n-A\n X\nTC"


def test_mutation_pipeline(spark):
    synonymous = HBB[:17] + "C" + HBB[18:]
    pairs = spark.createDataFrame([(0, HBB, HBB), (1, HBB, SICKLE), (2, HBB, synonymous), (3, "MKVE", "MKVQ"), (4, HBB, "MKVE")], "id int, a string, b string")
    rows = {r["id"]: r.asDict(recursive=True) for r in mutations.mutation_pipeline(pairs).collect()}
    assert rows[1]["protein"]["mutations"] == [{"kind": "substitution", "pos_a": 6, "pos_b": 6, "sym_a": "E", "sym_b": "V"}]
    assert rows[1]["protein"]["score"] == 85 and not rows[1]["silent"] and rows[2]["silent"] and not rows[0]["silent"]
    assert rows[3]["effective_mode"] == "protein" and rows[3]["dna"] is None and rows[3]["protein"]["score"] == 5
    assert rows[4]["effective_mode"] is None and rows[4]["dna"] is None and rows[4]["protein"] is None
    text = report.mutation_text(rows[1])
    assert "7: Glu to Val" in text and "radical 1" in text and "20: adenine to thymine" in text
    assert "leave the protein as it is" in report.mutation_text(rows[2])
    dna_only = mutations.mutation_pipeline(pairs.where("id = 1"), "dna").first()
    assert dna_only["protein"] is None and dna_only["dna"]["score"] == 267
    with pytest.raises(SeqValueError):
        mutations.mutation_pipeline(pairs, "x")
    with pytest.raises(Exception, match="unlike"):
        mutations.mutation_pipeline(pairs.where("id = 4"), strict=True).collect()


def test_mutations_from_strings_equal_those_of_the_kernel(spark):
    pairs = spark.createDataFrame([(0, "ACGTACGT", "ACTACGGT"), (1, "AACC", "AAGCC")], "id int, a string, b string")
    aligned = an.align_pairs(pairs)
    kernel = mutations.explode_mutations(aligned, "id").drop("ordinal")
    strings = mutations.mutations_from_strings(aligned.select("id", "alignment.aligned_a", "alignment.aligned_b"), "id")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, kernel.collect())) == sorted(map(key, strings.collect()))
    total = mutations.rollup_mutations(mutations.with_impact(kernel), "id", "kind").where("id is null").first()["n"]
    assert total == kernel.count()


def test_kmers(spark):
    reads = spark.createDataFrame([("ACGNACGT",), ("A",), ("",)], "seq string")
    got = {r["kmer"]: r["n"] for r in kmers.spectrum(reads, 2).collect()}
    assert got == {"AC": 2, "CG": 2, "GT": 1}
    dense = kmers.dense_spectrum(reads, 2).orderBy("kmer_id").collect()
    assert len(dense) == 16 and sum(r["n"] for r in dense) == 5 and dense[1]["kmer"] == "AC"
    with pytest.raises(SeqError):
        kmers.spectrum(reads, 0)


@pytest.mark.parametrize("k", [3, 8, 31, 33])
def test_seed_candidates_by_brute_force(spark, k):
    rng = random.Random(k)
    texts = [None, "", "ACGN" * 12] + ["".join(rng.choices("ACGTNé", (30, 30, 30, 30, 1, 1), k=rng.randint(0, 70))) for _ in range(40)]
    texts += [(t or "")[5:] for t in texts]
    sets = [{t[i : i + k] for i in range(len(t or "") - k + 1) if set(t[i : i + k]) <= set("ACGT")} if t else set() for t in texts]
    left = spark.createDataFrame(list(enumerate(texts)), "a long, seq string")
    pairs = kmers.seed_candidates(left, left.withColumnRenamed("a", "b"), k, id_left="a", id_right="b", least=2, salts=3, frequent=5)
    assert {tuple(r) for r in pairs.collect()} == {(i, j, len(x & y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(x & y) >= 2}


@pytest.mark.parametrize("k", [1, 5, 13, 31, 32])
def test_kmer_sets_by_brute_force(spark, k):
    rng = random.Random(k)
    texts = [None, "", "A" * 50] + ["".join(rng.choices("ACGTNé", (30, 30, 30, 30, 1, 1), k=rng.randint(0, 90))) for _ in range(40)]
    found = kmers.kmer_set(spark.createDataFrame([(t,) for t in texts], "seq string").repartition(3), k)
    assert sorted(r["kmer"] for r in found.collect()) == sorted({t[i : i + k] for t in texts if t for i in range(len(t) - k + 1) if set(t[i : i + k]) <= set("ACGT")})
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString() or k > 31  # no row for each window


def test_seeds_are_never_broadcast(spark):
    """Spark takes k-mers for as few as their sequences, and sent all of them to every worker."""
    reads = spark.range(100).selectExpr("id as a", "repeat('ACGT', 10) as seq")
    plan = kmers.seed_candidates(reads, reads.withColumnRenamed("a", "b"), 12, id_left="a", id_right="b")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [kmer" in plan and not re.search(r"BroadcastHashJoin \[kmer#\d+L?, __s", plan)


def test_first_of_each_file(spark):
    rows = [("x", 5, "a"), ("x", 2, "b"), ("y", 7, "c"), ("z", 1, "d"), ("z", None, "e"), (None, 3, "f"), (None, 1, "g")]
    found = mutations.first_of_each_file(spark.createDataFrame(rows, "file string, seq_id long, header string").repartition(4))
    assert found.columns == ["file", "seq_id", "header"]
    assert {r["file"]: r["header"] for r in found.collect()} == {"x": "b", "y": "c", "z": "e", None: "g"}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()  # which would bring all records of a file to one task


def test_no_part_of_a_spread_table_grows(spark, tmp_path):
    spark.range(1000).repartition(11).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        table = spark.read.parquet(str(tmp_path / "t"))
        assert spread(table).rdd.getNumPartitions() >= table.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quality_control(spark):
    reads = spark.createDataFrame([(0, "ACGT", "IIII"), (1, "GGCC", "5555"), (2, "ATAT", "????")], "read_id int, seq string, qual string")
    r = qc.report(reads)
    s = r.scalars
    assert (s["n_reads"], s["total_bases"], s["gc"], s["mean_q"], s["pct_q20"]) == (3, 12, 0.5, 30.0, 100.0) and round(s["pct_q30"], 1) == 66.7
    assert r.quality_histogram == {40: 1, 20: 1, 30: 1} and r.gc_histogram == {50: 1, 100: 1, 0: 1}
    assert [p["mean_q"] for p in r.positions] == [30.0] * 4 and r.bases[0]["a"] == 2
    text = report.quality_text(r)
    assert "reads 3, bases 12" in text and "good quality" in text
    with pytest.raises(ValueError):
        qc.report(reads.limit(0))
    assert report.sparkline([]) == "" and len(report.sparkline(list(range(500)))) == 60
    assert qc.filter_reads(reads, 30).count() == 2
    buckets = {x["lo"]: x["n"] for x in qc.rebucket(spark.createDataFrame([(3, 1), (47, 2), (63, 4)], "bin int, n long"), 0, 45, 5).collect()}
    assert buckets == {0: 1, 45: 6}
