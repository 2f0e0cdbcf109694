from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqframe.llm import decontaminate as dc


def distance(item: str, text: str) -> int:
    """The least edits to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=20), st.text("abc", max_size=60))
def test_bit_parallel_distance(item, text):
    part = dc.Part(0, item, 0, 0, None)
    assert dc.myers(part.masks, len(item), text)[0] == distance(item, text)


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice((text[:k] + text[k + 1 :], text[:k] + rng.choice("abcxyz") + text[k:], text[:k] + rng.choice("abcxyz") + text[k + 1 :]))
    return text


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.15])
def test_no_occurrence_is_lost(rate):
    rng = random.Random(int(rate * 100))
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, words(rng.randint(4, 20))) for i in range(30)]
    matcher = dc.Matcher(items, rate, 12)
    for _ in range(150):
        i, item = rng.choice(items)
        text = f"{words(15)} {edited(rng, item, rng.randint(0, int(len(item) * rate * 1.5)))} {words(15)}"
        got = {x[0]: x[1] for x in matcher.find(text)}
        folded = dc.fold(text)
        for k, t in items:
            form = dc.fold(t)
            best = distance(form, folded)
            assert (k in got) == (best <= int(len(form) * rate) and len(form) >= 12)
            if k in got:
                assert got[k] >= best
        assert got.get(i, 0) <= len(item)


def test_all_pieces_of_many_texts_are_found():
    """The hashed look-up against a plain search, in blocks of texts, with pieces longer than the hash covers."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(40)]
    for rate in (0.0, 0.02, 0.1):
        matcher = dc.Matcher(items, rate, 12)
        texts = [" ".join(word() for _ in range(60)) + " " + rng.choice(items)[1] for _ in range(20)] + ["", items[3][1]]
        whole = "\n".join(map(dc.fold, texts))
        expected = set()
        for k, (_, text, budget) in enumerate(matcher.items):
            for part in dc.pieces(k, text, budget):
                at = whole.find(part.text)
                while at >= 0:
                    expected.add((at, k, part.start, len(part.text)))
                    at = whole.find(part.text, at + 1)
        found = list(matcher.hits(whole))
        exact = {h for h in found if whole.startswith(matcher.items[h[1]][1][h[2] : h[2] + h[3]], h[0])}
        assert exact == expected and [h[0] for h in found] == sorted(h[0] for h in found)
        assert matcher.find_all(texts) == [matcher.find(t) for t in texts]


def test_short_items_match_whole_and_on_word_borders():
    matcher = dc.Matcher([(1, "What is pi?"), (2, "pi"), (3, "法国的首都是哪里？"), (4, " -- "), (5, "수도는 어디"), (6, "long enough to have a budget")], 0.1, 12)
    found = lambda text: sorted(x[:3] for x in matcher.find(text))
    assert found("so WHAT  is, pi") == [(1, 0, 13), (2, 0, 13)] and found("what is pie") == [] and found("spin") == [] and found("Whatis pi") == [(2, 0, 9)]
    assert found("问题法国的首都是哪里呢") == [(3, 0, 10)] and found("法国的首都是那里") == []
    assert found("한국의 수도는 어디?") == [(5, 0, 10)] and found("수도는 어디에") == []
    assert [x[0] for x in matcher.find("long enough to hve a budget")] == [6]


def test_pieces_cover_the_item():
    for n in (5, 12, 100):
        for budget in range(0, n, 3):
            parts = sorted(dc.pieces(0, "x" * n, budget), key=lambda p: p.start)
            assert len(parts) == budget + 1 and sum(len(p.text) for p in parts) == n


def test_odd_rows(make, odd, spark):
    items = spark.createDataFrame([(1, "The QUICK brown fox -- jumps over the lazy dog!"), (1, "The QUICK brown fox -- jumps over the lazy dog!"), (2, None), (3, "tiny"), (4, ""), (None, "runs away from all of the other animals"), (5, "absent words that never occur here")], "item_id long, text string")
    rows = dc.find_items(make(odd), items).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in rows) == sorted((d, i) for d in (1, 2, 2, -1) for i in (1, 1, -1))
    assert all(r["distance"] <= r["budget"] for r in rows)
    assert dc.find_items(make([]), items).count() == 0 and dc.find_items(make(odd), items.limit(0)).count() == 0
    blocks = dc.find_items(make(odd), items, block_bytes=40)
    assert sorted(map(tuple, ((r["doc_id"] or -1, r["item_id"] or -1) for r in blocks.collect()))) == sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in rows)
    kept = dc.drop_contaminated(make(odd), items)
    assert kept.columns == make(odd).columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9, 10}
    with pytest.raises(ValueError):
        dc.find_items(make([]), items, rate=1.0)
