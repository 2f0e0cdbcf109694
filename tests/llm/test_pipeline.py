from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from seqframe.llm import common, queries
from seqframe.llm.common import materialize, work_path
from tests.llm.conftest import SF


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near duplicates", "repeated passages", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, None
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = materialize(stage(spark, docs, SF), work_path(spark, "test"))
        if i < 4:
            assert docs.columns == columns
            ids = {r["doc_id"] for r in docs.collect()}
            assert seen is None or ids <= seen
            seen = ids
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"]) for r in df.collect())
    assert key(docs) == key(cp.run(spark, SF))


def test_planted_cases(spark, make):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    passage, near = prose(60), prose(120).split()
    rows = [(i, prose(100)) for i in range(50)]
    rows += [(100, prose(50) + " " + passage + " " + prose(50)), (101, prose(50) + " " + passage + " " + prose(50))]
    rows += [(200, rows[3][1]), (201, " ".join(near)), (202, " ".join([*near[:60], "edited", *near[61:]]))]
    rows += [(300, prose(40) + " " + item.upper() + " " + prose(40)), (400, "too short")]
    docs = make(rows, clashes=False)
    after = []
    for _, stage in cp.STAGES[:4]:
        docs = materialize(stage(spark, docs, SF), work_path(spark, "test"))
        after.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(after[0]) == {i for i, _ in rows} - {400}
    assert set(after[0]) - set(after[1]) == {200, 202}
    assert passage in after[2][100] and passage not in after[2][101] and len(after[2][101]) < len(rows[51][1]) - 250
    assert set(after[2]) - set(after[3]) == {300}


def test_rows_without_or_of_one_id_stand_on_their_own(spark, make):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    a, b, c, d = (prose(100) for _ in range(4))
    leak = prose(60) + " " + item + " " + prose(60)
    texts = lambda df: sorted((r["doc_id"] or -1, r["text"]) for r in df.collect())
    plain = [(100 + i, prose(100)) for i in range(20)]
    rows = [(None, a), (None, b), (7, c), (7, d), *plain]
    clean = sorted((i or -1, t) for i, t in rows)
    assert texts(cp.quality_rules(spark, make([*rows, (None, "too short"), (7, "short too")], clashes=False), SF)) == clean
    assert texts(cp.decontamination(spark, make([*rows, (None, leak), (7, leak)], clashes=False), SF)) == clean
    near = a.split()
    near = " ".join([*near[:50], "edited", *near[51:]])
    assert texts(cp.near_duplicates(spark, make([*rows, (None, b), (7, c), (8, d)], clashes=False), SF)) == clean
    left = texts(cp.near_duplicates(spark, make([*rows, (None, near)], clashes=False), SF))
    assert len(left) == len(clean) and set(left) < {*clean, (-1, near)}


@pytest.mark.parametrize("stage", range(4))
def test_each_stage_with_odd_rows(spark, make, stage):
    """Null, empty, blank and very long texts, null and repeated ids, repeated rows, clashing names, an empty table."""
    rng = random.Random(stage)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    plain, long, twice = prose(80), prose(40_000), prose(90)
    more = [(1000 + i, prose(100)) for i in range(30)]
    rows = [(1, plain), (2, None), (3, ""), (4, " \t\n"), (None, None), (5, long), (6, twice), (6, twice), (None, prose(70)), *more]
    rows = [(*r, "en") for r in rows]
    name, apply = cp.STAGES[stage]
    df = make(rows)
    out = apply(spark, df, SF)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    flat = out.toDF(*(f"c{i}" for i in range(len(out.columns)))).collect()
    texts = sorted((str(r[0]), str(r[1])) for r in flat)
    whole = sorted((str(i), str(t)) for i, t, _ in rows)
    assert all(r[c] == "x" for r in flat for c in range(5, len(df.columns)))
    if name == "quality rules":
        assert texts == sorted(x for x in whole if len(x[1].split()) >= 20)
    elif name == "near duplicates":
        assert texts == sorted([*(x for x in whole if x[0] != "6"), ("6", twice)])
    elif name == "repeated passages":
        assert texts == sorted([*(x for x in whole if x[0] != "6"), ("6", twice), ("6", "")])
        assert all(r[4] == len(r[1] or "") for r in flat)
    else:
        assert texts == whole
    assert apply(spark, make([]), SF).count() == 0


def test_packing_stage_with_odd_rows(spark, make, odd):
    got = cp.packed_sequences(spark, make(odd), SF).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in odd}
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert cp.packed_sequences(spark, make([]), SF).count() == 0


def test_work_tables_are_removed(spark):
    import os

    shared = common.shared_dir(spark).removeprefix("file://")
    listed = lambda: set(os.listdir(shared)) if os.path.isdir(shared) else set()
    start, before = len(common.made), listed()
    cp.run(spark, SF).count()
    left = {d: os.listdir(f"{shared}/{d}") for d in listed() - before}
    assert sorted(k.split("-")[1] for k in left) == ["pieces", "pipeline"] and [v for k, v in left.items() if "pipeline" in k] == [["3"]]
    common.sweep(spark, start)
    assert listed() <= before


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    table = "pages" if name.startswith(("op5", "op10")) else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    rows = queries.QUERIES[name](spark, SF).collect()
    key = "page_id" if table == "pages" else "doc_id"
    if name.startswith("op9"):
        assert rows
    else:
        assert len({r[key] for r in rows}) == n
        assert name.startswith("op8") or len(rows) == n


def test_no_query_of_the_rest_needs_this_package():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "seqframe"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), f
