from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from seqframe.llm.sharding import assign_shards, jump_shard


def published(key: int, n: int) -> int:
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 1000])
def test_recurrence(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(100, 180), *(7**k for k in range(5, 22))]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_shard(F.col("k"), n).alias("s")).collect()
    assert all(r["s"] == published(r["k"], n) for r in rows)
    with pytest.raises(ValueError):
        jump_shard(F.col("k"), 0)


def test_odd_rows(make, odd):
    rows = assign_shards(make(odd), 8, chunks=3).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert r["shard"] == published(r["doc_id"] or 0, 8) and r["grown_shard"] in (r["shard"], 8)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    by = {i: t for i, t in odd if i is not None}
    for r in rows:
        if r["doc_id"] is not None:
            t = by[r["doc_id"]]
            assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    assert assign_shards(make([]), 8).count() == 0


def test_few_rows_move(spark):
    keys = spark.range(20_000).select(jump_shard(F.col("id"), 8).alias("a"), jump_shard(F.col("id"), 9).alias("b"))
    moved = keys.where("a <> b")
    assert moved.where("b <> 8").isEmpty() and abs(moved.count() / 20_000 - 1 / 9) < 0.01


def test_native_plan(make):
    plan = assign_shards(make([(1, "a")]), 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
