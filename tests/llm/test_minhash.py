from __future__ import annotations

import random
import re

import numpy as np
import pytest

from seqframe.llm import minhash as mh
from seqframe.llm.components import connected_components
from tests.llm.conftest import SF


def brute(rows, width, threshold):
    num, den = threshold
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def compare(df, rows, width, threshold):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in mh.near_duplicates(df, width=width, threshold=threshold).collect()}
    assert got == brute(rows, width, threshold)


def families(seed: int, groups: int, size: int, edits: tuple[int, int]):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(40, 90))]
        for _ in range(size):
            copy = base[:]
            for _ in range(rng.randint(*edits)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("edits", [(0, 2), (1, 5), (3, 9)])
def test_against_brute_force(make, edits):
    rows = families(sum(edits), 12, 12, edits)
    compare(make(rows), rows, 3, (80, 100))


def test_buckets_in_several_blocks(make, monkeypatch):
    """A family whose copies hardly link with each other, in blocks of few classes."""
    monkeypatch.setattr(mh, "BLOCK", 7)
    monkeypatch.setattr(mh, "PER_HUB", 3)
    rows = families(9, 2, 45, (2, 4))
    compare(make(rows), rows, 3, (82, 100))


def test_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    compare(docs, rows, 3, (85, 100))


def test_odd_rows(make, odd):
    rows = mh.near_duplicates(make(odd), width=3).collect()
    assert len(rows) == len(odd)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] and by[i]["component_id"] == i for i in (3, 4, 5))
    assert by[10]["component_id"] == 9 and by[6]["n_shingles"] == 1
    assert mh.near_duplicates(make([])).count() == 0
    assert mh.near_duplicates(make([(1, None), (2, "")])).count() == 2
    with pytest.raises(ValueError):
        mh.near_duplicates(make([]), threshold=(0, 1))
    kept = mh.deduplicate(make(odd), width=3)
    assert kept.columns == make(odd).columns and {r["doc_id"] for r in kept.collect()} == {1, None, 3, 4, 5, 6, 7, 8, 9}


def test_near_duplicates_without_ids(make):
    rows = families(2, 1, 12, (0, 1))
    got = mh.near_duplicates(make([(None, t) for _, t in rows])).collect()
    assert len(got) == 12 and all(r["component_id"] is None and r["kept"] for r in got)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        common = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, (2000 - len(common)) // 2, dtype=np.uint64)]) for _ in range(2))
        same = np.mean(mh.signature(a, 512) == mh.signature(b, 512))
        assert abs(same - share) < 0.08
    assert mh.bands_needed(0.85) == 22


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 100), (7, 7)]
    labels = {r["id"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {labels[i] for i in range(61)} == {0} and {labels[i] for i in (100, 101, 102, 200)} == {100}
    more = connected_components(spark.createDataFrame([(60, 200), (500, 501)], "a long, b long"), spark.createDataFrame(list(labels.items()), "id long, label long"))
    got = {r["id"]: r["label"] for r in more.collect()}
    assert {got[i] for i in (*range(61), 100, 200)} == {0} and got[501] == 500
