from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from seqframe.llm.language_id import BUCKETS, INDEPENDENT, Model, codewords, identify, trigrams
from tests.llm.conftest import SF


def test_codewords_differ_in_many_bits():
    for n in (2, 4, 7, 12, 40):
        code = codewords(n)
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(n, dtype=int) * 999
        assert apart.min() >= (1 if n == 2 else (1 << (n - 2)) // 1 if n <= 7 else 10)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF[:-3]}01/documents.parquet") if SF.endswith("001") else spark.read.parquet(f"{SF}/documents.parquet")
    found = identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_the_id_and_tags_of_held_out_rows_play_no_part(make, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    swapped = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in identify(df).collect())
    assert key(docs) == key(swapped)


def test_odd_rows(make, odd):
    rows = identify(make([*odd, (11, "123 456 !!"), *((i, "bonjour le monde et la mer", "fr") for i in range(20, 40))])).collect()
    assert len(rows) == len(odd) + 21
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {3, 4, 5, 11} <= und and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in rows} <= {"en", "fr", "und"}
    assert identify(make([])).count() == 0
    assert {r["lang_pred"] for r in identify(make([(1, "abc", None)])).collect()} == {"und"}
    assert {r["lang_pred"] for r in identify(make([(i, "only one here", "de") for i in range(9)])).collect()} == {"de"}


def plain_trigrams(text):
    raw = [c if ord("a") <= c <= ord("z") or c > 127 else 0x20 for c in f" {text.lower()} ".encode()]
    out = []
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        if b != 0x20:
            mixed = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
            out.append((mixed * 0x27D4EB2F & 0xFFFFFFFF) >> 17)
    return out


TEXTS = ["the cat sat on the mat", "", "Größe & Maß über alles!", "x", "le chat est sur la table", " a b ", "ñandú 東京", "1 2 3", "zz" * 300]


def test_trigrams_in_parts_against_plain_python():
    for step in (1, 2, 3, 7, 64, 1 << 20):
        got = [[] for _ in TEXTS]
        for grams, owner in trigrams(TEXTS, step):
            for g, o in zip(grams.tolist(), owner.tolist(), strict=True):
                got[o].append(g)
        assert got == [plain_trigrams(t) for t in TEXTS], step


def test_decoding_against_plain_python():
    learn = {"en": ["the cat sat on the mat", "a dog and the cat"], "fr": ["le chat est sur la table", "un chien et le chat"], "de": ["die Katze sitzt auf der Matte", "ein Hund über der Katze"]}
    model = Model({x: np.bincount(np.concatenate([plain_trigrams(t) for t in ts]), minlength=BUCKETS) for x, ts in learn.items()})
    for text, (lang, score, _) in zip(TEXTS, model.predict(TEXTS), strict=True):
        grams = plain_trigrams(text)
        if not grams:
            assert (lang, score) == ("und", 0.0)
            continue
        loss = []
        for word in model.code:
            total = 0.0
            for k, bit in enumerate(word):
                margin = sum(float(model.odds[g, k]) for g in grams) / len(grams) * math.sqrt(len(grams) / (1 + len(grams) / INDEPENDENT))
                total += model.weight[k] * math.log1p(math.exp(-margin * int(bit)))
            loss.append(total)
        chance = [math.exp(-(x - min(loss))) for x in loss]
        assert lang == model.langs[int(np.argmin(loss))]
        assert abs(score - max(chance) / sum(chance)) < 1e-6


def test_many_languages_and_a_long_text():
    rng = np.random.default_rng(1)
    model = Model({f"l{i}": rng.integers(0, 50, BUCKETS) for i in range(60)})
    found = model.predict(["the cat " * 40_000, "the cat"])
    assert len(found) == 2 and all(x.startswith("l") and 0 <= s <= 1 for x, s, _ in found)
