from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqframe.llm import suffix_dedup as sd
from seqframe.llm.induced import Scratch, suffixes_down
from tests.llm.conftest import SF


def agree(b: bytes, i: int, j: int, depth: int) -> int:
    k = 0
    while k < depth and i + k < len(b) and j + k < len(b) and b[i + k] == b[j + k]:
        k += 1
    return k


def check(b: bytes, depth: int, **options) -> None:
    got = list(suffixes_down(np.frombuffer(b, np.uint8), 256, depth, **options))
    at, common = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
    assert sorted(at.tolist()) == list(range(len(b)))
    for k in range(1, len(at)):
        assert b[at[k - 1] :][:depth] >= b[at[k] :][:depth]
        assert common[k] == agree(b, at[k - 1], at[k], depth)


@settings(max_examples=400, deadline=None)
@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x % 4 + 1 for x in b)), st.sampled_from([1, 2, 5, 8, 9, 100]), st.sampled_from([1, 64, 600, 1500, 1 << 20]))
def test_order_and_common_prefixes(b, depth, memory):
    """memory 1: all arrays and tuples go to disk, pieces have 8 elements, and recursion goes down to one symbol."""
    check(b, depth, memory=memory)
    check((b * 7)[:150], depth, memory=memory)


def test_long_runs():
    for memory in (10, 2000, 1 << 20):
        check(b"\x05" * 700 + b"\x03" + b"\x05" * 300 + b"\x09" + b"\x05" * 150, 50, memory=memory)
        check(b"\x01" * 300, 20, memory=memory)
        check(b"\x01\x02" * 200 + b"\x01\x03" * 60 + b"\x01\x02" * 150, 60, memory=memory)


def test_text_above_the_memory_bound():
    """Recursion over several levels, queues that spill and mapped arrays, against sorting the suffixes themselves."""
    rng = random.Random(6)
    words = [bytes(rng.randint(1, 12) for _ in range(rng.randint(2, 30))) for _ in range(60)]
    b = b"".join(rng.choice(words) for _ in range(2500))
    scratch = Scratch(20_000)
    got = list(suffixes_down(np.frombuffer(b, np.uint8), 256, 100, scratch=scratch))
    assert scratch.levels >= 2 and scratch.spilled > len(b) and scratch.mapped > 8 * len(b) / 4
    assert max(len(x[0]) for x in got) <= scratch.piece
    at, common = np.concatenate([x[0] for x in got]).tolist(), np.concatenate([x[1] for x in got]).tolist()
    cut = [b[k : k + 100] for k in range(len(b))]
    assert sorted(at) == list(range(len(b))) and [cut[k] for k in at] == sorted(cut, reverse=True)
    assert all(common[k] == agree(b, at[k - 1], at[k], 100) for k in range(1, len(at)))


def brute(rows: list[tuple[int | None, str | None]], length: int) -> dict:
    seen, out = set(), {}
    for i, text in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        gone = bytearray(len(text))
        for k in range(len(text) - length + 1):
            w = text[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.setdefault(i, []).append((len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def compare(df, rows, length):
    got: dict = {}
    for r in sd.digest_report(df, length=length).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute(rows, length).items()}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(make, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    rows = []
    for i in rng.sample(range(-50, 400), 120):
        text = "".join(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 7)))
        rows.append((i, text))
    compare(make(rows).repartition(7), rows, 30)


def test_self_overlap_and_runs(make):
    rows = [(1, "ab" * 100), (2, "x" * 500), (3, "x" * 99 + "y"), (4, "abc" * 40 + "ab" * 60), (5, "ab" * 15)]
    compare(make(rows), rows, 24)


def test_odd_rows(make, odd):
    single = [r for r in odd if r[0] not in (2, None)] + [(None, odd[0][1]), (2, odd[0][1])]
    compare(make(single), single, 40)
    report = {r["doc_id"]: r for r in sd.digest_report(make(odd), length=40).collect()}
    assert report[1]["n_removed"] == 0 and report[3]["n_bytes"] == 0 and report[4]["n_spans"] == 0
    twice = sorted(r["n_removed"] for r in sd.digest_report(make([(2, "z" * 10 + odd[0][1]), (2, "z" * 10 + odd[0][1])]), length=40).collect())
    assert twice[0] == 0 and twice[1] == len(odd[0][1]) + 10
    assert sd.digest_report(make([]), length=40).count() == 0
    with pytest.raises(ValueError):
        sd.digest_report(make([]), length=10)


def settled(texts, length, memory, shards, batch=7):
    """Bytes to go of the texts of one part, in one process, with shards of little memory."""
    import pyarrow as pa

    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array([t.encode() for t in texts], pa.binary())})
    rows = [r for b in sd._sent(0, docs, np.zeros(0, np.uint64), length, shards) for r in b.to_pylist()]
    blobs = [r["content"] for r in rows if r["kind"] == 0]
    rows = sorted((r for r in rows if r["kind"] == 1), key=lambda r: (r["bucket"], r["digest"], r["doc_id"], r["row"], r["start"]))
    fields = [f for f in sd._SENT if f.name not in ("kind", "anchor")]
    batches = [pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in fields} for r in rows[k : k + batch]], schema=pa.schema(fields)) for k in range(0, len(rows), batch)]
    blobs += [x for b in sd._sorted_shards(iter(batches), length, memory) for x in b.column(1).to_pylist()]
    spans = pa.concat_tables([sd._load(x) for x in blobs] or [sd._SPANS.empty_table()])
    row, lo, hi = sd._union(*(spans.column(i).to_numpy() for i in range(3)))
    return [sum(int(y - x) for r, x, y in zip(row, lo, hi, strict=True) if r == k) for k in range(len(texts))]


@pytest.mark.parametrize("memory", [64, 3000, 1 << 22])
def test_shards_above_the_memory_bound(monkeypatch, memory):
    """Texts that are cut into steps; one shard or several, whose texts, arrays and queues go to disk."""
    monkeypatch.setattr(sd, "STEP_BYTES", 64)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd") for _ in range(400)) for _ in range(3)]
    texts.append(texts[0][50:300] + texts[1][10:200])
    texts += ["x" * 300, "ab" * 200, "x" * 90 + texts[2][:100] + "ab" * 60]
    expected = [v[0][1] for _, v in sorted(brute(list(enumerate(texts)), 40).items())]
    for shards in (1, 5):
        assert settled(texts, 40, memory, shards) == expected


def test_the_sort_of_a_shard_recurses_and_spills():
    """With the production path's own bound, scaled to a text some times as large."""
    rng = random.Random(5)
    parts = [bytes(rng.randint(97, 105) for _ in range(rng.randint(100, 180))) for _ in range(120)]
    contents = [rng.choice(parts)[: rng.randint(60, 180)] + bytes([97 + k % 9, 97 + k // 9 % 9, 97 + k // 81]) for k in range(500)]
    text = np.frombuffer(b"".join(c + bytes([sd.GAP]) for c in contents), np.uint8) + np.uint8(1)
    sizes = np.array([len(c) for c in contents])
    scratch = Scratch(len(text) // 4)
    spans = [x for s in sd._repeats(text, sizes, np.arange(500), np.zeros(500, np.int64), 50, 0, scratch) for x in zip(*(c.tolist() for c in map(np.atleast_1d, s)), strict=True)]
    assert scratch.levels >= 1 and scratch.spilled > 0 and scratch.mapped > 0
    seen, expected = set(), []
    for k, c in enumerate(contents):
        gone = [False] * len(c)
        for at in range(len(c) - 49):
            if c[at : at + 50] in seen:
                gone[at : at + 50] = [True] * 50
            seen.add(c[at : at + 50])
        edges = [x for x in range(len(c) + 1) if (x < len(c) and gone[x]) != (x > 0 and gone[x - 1])]
        expected += [(k, a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    assert sorted(spans) == expected


def test_core_classes_cover_all_windows_alike():
    """Each window lies in one class, and equal windows get equal cores, wherever their fragments begin and end."""
    rng = random.Random(1)
    length = 60
    for _ in range(200):
        text = bytes(rng.randint(97, 100) for _ in range(400))
        anchor = rng.randint(100, 250)
        cores: dict[int, bytes] = {}
        for _ in range(3):
            lo, hi = sorted(rng.sample(range(anchor - (length - sd.ANCHOR), anchor + 1), 2))
            got = []
            for a, b, core in sd.core_classes(hi - 1 - lo + length, anchor - lo, length):
                for w in range(a, b):
                    assert w <= core[0] and core[1] <= w + length
                    content = text[lo + core[0] : lo + core[1]]
                    assert cores.setdefault(lo + w, content) == content
                    got.append(w)
            assert got == sorted(got) or sorted(got) == list(range(hi - lo))
            assert sorted(got) == list(range(hi - lo))


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_anchors(make, monkeypatch, hot):
    """A passage in most documents, with other surroundings in each: its windows are dealt by content."""
    rng = random.Random(hot)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    text = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
    rows = [(i, text() + passage[: rng.choice([60, 130])] + text() + rng.choice(["", passage[20:]])) for i in range(70)]
    rows += [(None, passage), (100, None), (101, ""), (102, passage + passage)]
    got: dict = {}
    df = make(rows).repartition(6)
    monkeypatch.setattr(sd.removed_spans, "__kwdefaults__", sd.removed_spans.__kwdefaults__ | {"hot": hot, "memory": 500})
    for r in sd.digest_report(df, length=40).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert got == brute(rows, 40)


def test_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    compare(docs, [(r["doc_id"], r["text"]) for r in docs.collect()], 100)


def test_cut_texts_keeps_columns_and_characters(make):
    passage = "".join(chr(0x100 + i) for i in range(60))
    df = make([(1, "a" + passage + "b"), (2, "cc" + passage + "d"), (3, None)])
    out = {r["doc_id"]: r for r in sd.cut_texts(df, length=100).collect()}
    assert out[1]["text"] == "a" + passage + "b" and out[3]["text"] is None and sd.cut_texts(df, length=100).columns == df.columns
    assert out[2]["text"].startswith("cc") and out[2]["text"].endswith("d") and len(out[2]["text"]) < 10 and out[2]["shard"] == "x"
