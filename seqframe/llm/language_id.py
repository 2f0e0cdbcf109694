"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary classifier on hashed byte trigrams that tells the
languages with a one from those with a zero (log odds of the two sides' mean trigram distributions,
so a common language outweighs no other). A text's margins are compared with every codeword by a
logistic loss in which a bit weighs as much as it separates its sides; the least loss names the
language. ``ambiguous`` marks texts whose two best languages lie close together.

Training: per language, a sample of about TRAIN_DOCS documents (all, if there are fewer): those whose
hashed ids lie below the share that TRAIN_DOCS is of the language's documents. It does not depend on
partitioning, and no language's rows meet in one task. The model has languages x BUCKETS counts,
whatever the corpus.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text where
nothing could be learned; with one learned language that language is predicted; repeated rows get equal
results; an empty table gives an empty result; extra columns are ignored; whole texts are read, a long one in parts
whose sums are carried on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, pick, text_views

#: Documented bound of the training sample, per language (to within the chance of hashing).
TRAIN_DOCS = 3000
BUCKETS = 1 << 15
#: A text's trigrams, however many, are worth less than so many independent ones: what the score tends to.
INDEPENDENT = 400
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1: all different splits for up to 7 languages; else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        rows = [np.zeros(len(bits), np.int64)] + [(bits >> i) & 1 for i in range(n - 1)]
        return (np.array(rows) * 2 - 1).astype(np.int8)
    rng = np.random.default_rng(5)
    width = math.ceil(15 * math.log2(n))
    best, most = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (n, width)) * 2 - 1
        code = code[:, (code.max(axis=0) == 1) & (code.min(axis=0) == -1)]
        apart = (code.shape[1] - code @ code.T) // 2 + np.eye(n, dtype=np.int64) * width
        if apart.min() > most:
            best, most = code, apart.min()
    return best.astype(np.int8)


def trigrams(texts: list[str], step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the trigrams of all texts, one after the other, and the texts that they belong to, in parts of ``step`` bytes.

    Trigrams around a gap are left out, and so are those that would reach from one text into the next.
    """
    flat, bounds = text_views(pa.array([f" {t.lower()} " for t in texts], pa.large_string()))
    ends = bounds[1:]
    for start in range(0, len(flat) - 2, step):
        part = _FOLD[flat[start : start + step + 2]]
        wide = part.astype(np.uint32)
        grams = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(17)
        use = part[1:-1] != 0x20
        for off in (1, 2):  # the last two places of a text begin no trigram of its own
            at = ends - off - start
            use[at[(at >= 0) & (at < len(use))]] = False
        place = np.flatnonzero(use)
        yield grams[place].astype(np.int64), np.searchsorted(ends, place + start, side="right")


def count_trigrams(sample: DataFrame) -> DataFrame:
    """(lang, bucket, n) of rows (lang, text); each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in blocks(batch, "text"):
                by: dict[str, list[str]] = {}
                for lang, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    for grams, _ in trigrams(texts):
                        sums[lang] = sums.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    return sample.mapInArrow(lean(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        if not self.langs:
            return
        p = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in self.langs])
        odds = []
        for bit in self.code.T:
            ones = p[bit > 0].mean(axis=0) if (bit > 0).any() else np.full(BUCKETS, 1 / BUCKETS)
            zeros = p[bit < 0].mean(axis=0) if (bit < 0).any() else np.full(BUCKETS, 1 / BUCKETS)
            odds.append(np.clip(np.log(ones / zeros), -4, 4))
        self.odds = np.ascontiguousarray(np.array(odds).T, np.float32)
        apart = (p @ self.odds * self.code).min(axis=0)  # how far the worst language lies on its side
        weight = np.maximum(apart, 0.02)
        self.weight = weight / weight.mean()

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log odds per text and bit, and the number of trigrams; a part of the trigrams at a time, whatever the length of a text."""
        bits = self.odds.shape[1]
        sums, n = np.zeros((len(texts), bits)), np.zeros(len(texts), np.int64)
        for grams, owner in trigrams(texts, max(1 << 12, (16 << 20) // (4 * bits))):
            if len(grams):
                first = np.flatnonzero(np.append(True, np.diff(owner) != 0))
                sums[owner[first]] += np.add.reduceat(self.odds[grams], first, axis=0, dtype=np.float64)
                n += np.bincount(owner, minlength=len(texts))
        return sums, n

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        sums, n = self.margins(texts)
        # the mean, as sure as so many trigrams make it: they are not independent of each other
        sure = np.sqrt(n / (1 + n / INDEPENDENT))
        margins = sums / np.maximum(n, 1)[:, None] * sure[:, None]
        out: list[tuple[str, float, bool]] = []
        loss = np.stack([(np.logaddexp(0, -margins * word) * self.weight).sum(axis=1) for word in self.code], axis=1)
        chance = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        order = np.sort(chance, axis=1)
        close = order[:, -1] - order[:, -2] < 0.2 if len(self.langs) > 1 else np.zeros(len(texts), bool)
        best = loss.argmin(axis=1)
        for i in range(len(texts)):
            out.append((self.langs[best[i]], float(chance[i, best[i]]), bool(close[i])) if n[i] else ("und", 0.0, True))
        return out


def train(rows: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """rows: (doc_id, lang, text) to learn from."""
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))  # one row per language
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") * F.col("docs") < F.lit(float(train_docs << 30))
    sample = rows.join(F.broadcast(sizes), "lang").where(share).select("lang", "text")
    counts: dict[str, np.ndarray] = {}
    table = count_trigrams(sample).toArrow()  # languages x BUCKETS rows at most
    lang = table.column(0).combine_chunks().dictionary_encode()
    code, bucket, n = lang.indices.to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy()
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(lang.dictionary) + 1))
    for k, x in enumerate(lang.dictionary.to_pylist()):
        here = order[cuts[k] : cuts[k + 1]]
        counts[x] = np.bincount(bucket[here], weights=n[here], minlength=BUCKETS)
    return Model(counts)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id's text mod 3 is 1: never learned from), lang_pred, score, ambiguous."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = rows.withColumn("held_out", held)
    model = rows.sparkSession.sparkContext.broadcast(train(rows.where("not held_out and lang is not null and text is not null").select("doc_id", "lang", "text"), train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                texts = [t or "" for t in block.column(2).to_pylist()]
                found = [x if _LETTER.search(t) else ("und", 0.0, True) for t, x in zip(texts, model.value.predict(texts), strict=True)]
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
