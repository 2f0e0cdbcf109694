"""Quality rules: base counts of words and lines, and tokeniser fertility.

Fertility: a public vocabulary with byte fallback encodes each whole text. Its characters per
token, its share of byte-fallback tokens and the entropy of its tokens are held against bands per
language (or, where a document names none, per main script). The entropy is taken over runs of 64
tokens, as a share of what such a run can reach, so that it does not depend on the text's length.
A band is the median of all documents of the language that pass the base rules, less or plus a
multiple of the spread between their 5th and 95th percentile; it widens for texts of few tokens,
whose figures scatter. Prose lies well inside; tables, decorated or encoded text do not.

A band of few documents is drawn towards the pool of its main script (of all documents, where it has no
letters): the pool counts as ``prior_docs`` documents. The spread is that of both together, with the
distance of their medians in it, so that a small language unlike the rest of its script still fits. So
every document meets a band, and its verdict does not jump with the number of its neighbours. Where a
script has one language only, the pool is that language itself.

Edge cases: a null text has no words; it and an empty text fail the base rules; their fertility
figures are null; repeated rows get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoders
from .common import SEPARATORS, blocks, lean, materialize, pick, shingle_hashes, text_views, word_table, work_path

METRICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, band string, script string, n_tokens long, chars_per_token double, fallback_share double, token_entropy double"

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

#: First code points of blocks whose letters name a script; what lies between belongs to the one before.
_BLOCKS = ((0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))
_STARTS = np.array([0, *(a for a, _ in _BLOCKS)])
_NAMES = ["none", *(b for _, b in _BLOCKS)]


def main_script(text: str) -> str:
    """The script of most letters; 'none' without any."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    low = points < 0x80
    points = points[(~low & (points >= 0xAA)) | (low & ((points | 32) >= 97) & ((points | 32) <= 122))]
    if len(points) == 0:
        return "none"
    counts = np.bincount(np.searchsorted(_STARTS, points, side="right") - 1, minlength=len(_NAMES))
    return _NAMES[int(counts.argmax())]


def _repeated(hashes: np.ndarray, text: bytes) -> np.ndarray:
    """Windows of 8 words found twice or more: those whose hashes are, once the words themselves have been compared."""
    _, first, back, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[back] > 1)
    if len(at) == 0:
        return at
    known: dict[bytes, int] = {}
    words = np.array([known.setdefault(w, len(known)) for w in text.split()])  # bytes part at the same six characters
    windows = np.lib.stride_tricks.sliding_window_view(words, 8)
    if (windows[at] == windows[first[back[at]]]).all():
        return at
    _, back, n = np.unique(windows, axis=0, return_inverse=True, return_counts=True)  # some hashes are alike by chance
    return np.flatnonzero(n[back.reshape(-1)] > 1)


def base_counts(flat: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    rows = len(bounds) - 1
    starts, _, hashes = word_table(flat, bounds)
    first = np.searchsorted(starts, bounds)
    chars = np.concatenate([[0], np.cumsum(((flat & 0xC0) != 0x80) & ~SEPARATORS[flat])])
    marks = np.concatenate([[0], np.cumsum(_SYMBOLS[flat])])
    out = []
    for i in range(rows):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        words = hashes[first[i] : first[i + 1]]
        lines: set[bytes] = set()
        twice = 0
        for line in flat[lo:hi].tobytes().split(b"\n"):
            if line in lines:
                twice += 1
            elif line.strip(b" \t\n\x0b\x0c\r"):
                lines.add(line)
        covered = 0
        if len(words) >= 8:
            at = _repeated(shingle_hashes(words, 8), flat[lo:hi].tobytes())
            if len(at):
                step = np.zeros(len(words) + 1, np.int64)
                step[at] += 1
                np.subtract.at(step, at + 8, 1)
                covered = int((np.cumsum(step[:-1]) > 0).sum())
        out.append((len(words), int(chars[hi] - chars[lo]), int(marks[hi] - marks[lo]), twice, covered))
    return out


def run_entropy(ids: np.ndarray, width: int = 64) -> float:
    """Mean entropy of the tokens in runs of ``width`` or a little more, as a share of the most that a run can have."""
    if len(ids) < 2:
        return 0.0
    runs = max(1, len(ids) // width)
    each = len(ids) // runs
    rows = np.sort(ids[: runs * each].reshape(runs, each), axis=1)
    new = np.ones((runs, each), bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    n = np.diff(np.append(np.flatnonzero(new), runs * each))
    return float(1 - (n * np.log2(n)).sum() / (runs * each) / np.log2(each))


def fertility(vocabulary: str, texts: list[str]) -> list[tuple[int, float, float, float] | None]:
    """Tokens, characters per token, byte-fallback share and run entropy; None where there is no token."""
    model = encoders.sentence_pieces(vocabulary)
    fallback = _fallback(vocabulary)
    out: list[tuple[int, float, float, float] | None] = []
    for text, ids in zip(texts, model.encode(texts, num_threads=1), strict=True):
        if not ids:
            out.append(None)
            continue
        ids = np.array(ids)
        out.append((len(ids), len(text) / len(ids), float(fallback[ids].mean()), run_entropy(ids)))
    return out


@functools.lru_cache(maxsize=4)
def _fallback(vocabulary: str) -> np.ndarray:
    model = encoders.sentence_pieces(vocabulary)
    return np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def measure(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", min_words: int = 20, repeat_share: int = 30) -> DataFrame:
    """Base counts and fertility of each document. A text that fails the base rules is not encoded: its verdict is settled."""
    wanted = {"doc_id": id_col, "text": text_col} | ({"lang": lang_col} if lang_col in docs.columns else {})
    rows = pick(docs, **wanted)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang") if "lang" in wanted else F.lit(None).cast("string").alias("lang"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                base = base_counts(*text_views(block.column(1)))
                failed = [b[0] < min_words or 100 * b[4] > repeat_share * b[0] for b in base]
                texts, langs = block.column(1).to_pylist(), block.column(2).to_pylist()
                good = [i for i, f in enumerate(failed) if not f]
                figures: list = [None] * len(texts)
                for i, x in zip(good, fertility(vocabulary, [texts[i] for i in good]), strict=True):
                    figures[i] = x
                scripts = [None if f else main_script(t) for f, t in zip(failed, texts, strict=True)]
                bands = [None if f else lang or f"script {x}" for f, x, lang in zip(failed, scripts, langs, strict=True)]
                arrays = [block.column(0), *(pa.array([b[k] for b in base], pa.int64()) for k in range(5)), pa.array(failed, pa.bool_()), pa.array(bands, pa.string()), pa.array(scripts, pa.string())]
                arrays += [pa.array([x and x[k] for x in figures], pa.float64() if k else pa.int64()) for k in range(4)]
                names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "band", "script", "n_tokens", "chars_per_token", "fallback_share", "token_entropy"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(lean(each), METRICS)


def judge(metrics: DataFrame, *, chars_reach: float = 1.6, entropy_reach: float = 1.0, joint_reach: float = 1.4, fallback_reach: float = 5.0, prior_docs: int = 10) -> DataFrame:
    """Adds ``kept``. ``metrics`` should be stored: it is read four times.

    One row of percentiles per band, per script and over all documents is made; the bands are broadcast, at
    most as many rows as there are languages and scripts. A ``reach`` is in units of the spread between the
    5th and 95th percentile.
    """
    figures = {"chars_per_token": 0.16, "fallback_share": 0.02, "token_entropy": 0.033}  # with the least spread, that of plain prose
    good = metrics.where(~F.col("base_failed"))

    def cuts(prefix: str) -> list[F.Column]:
        return [F.percentile_approx(c, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)), 1000).alias(f"{prefix}_{c}") for c in figures]

    bands = good.groupBy(F.col("band").alias("b_band")).agg(F.count(F.lit(1)).alias("b_n"), F.mode("script", True).alias("b_script"), *cuts("b"))
    scripts = good.where("script <> 'none'").groupBy(F.col("script").alias("s_script")).agg(*cuts("s"))
    bands = bands.join(F.broadcast(scripts), F.col("b_script") == F.col("s_script"), "left").crossJoin(F.broadcast(good.agg(*cuts("a"))))
    own = F.col("b_n") / (F.col("b_n") + prior_docs)
    for c, least in figures.items():
        pool = F.coalesce(f"s_{c}", f"a_{c}")
        mid, pool_mid = F.col(f"b_{c}")[1], pool[1]
        wide, pool_wide = (F.greatest(x[2] - x[0], F.lit(least)) for x in (F.col(f"b_{c}"), pool))
        both = F.sqrt(own * wide * wide + (1 - own) * pool_wide * pool_wide + own * (1 - own) * (mid - pool_mid) * (mid - pool_mid))
        bands = bands.withColumn(f"mid_{c}", own * mid + (1 - own) * pool_mid).withColumn(f"wide_{c}", both)
    bands = bands.select("b_band", *(f"{x}_{c}" for c in figures for x in ("mid", "wide")))
    loose = F.sqrt(1 + 128 / F.greatest("n_tokens", F.lit(1)))

    def off(figure: str) -> F.Column:
        return (F.col(figure) - F.col(f"mid_{figure}")) / F.col(f"wide_{figure}") / loose

    chars, entropy = off("chars_per_token"), off("token_entropy")
    fits = (F.abs(chars) <= chars_reach) & (entropy >= -entropy_reach) & (chars + entropy >= -joint_reach) & (off("fallback_share") <= fallback_reach)
    outer = F.col("chars_per_token").between(0.6, 12.0) & (F.col("fallback_share") <= 0.6) & (F.col("token_entropy") >= 0.5)
    joined = metrics.join(F.broadcast(bands), F.col("band") == F.col("b_band"), "left")
    return joined.select(*(c for c in metrics.columns if c != "script"), F.coalesce(~F.col("base_failed") & fits & outer, F.lit(False)).alias("kept"))


def quality(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", **options) -> DataFrame:
    """One row per document: the base counts, base_failed, the fertility figures and kept."""
    metrics = materialize(measure(docs, vocabulary, **options), work_path(docs.sparkSession, "quality"))
    return judge(metrics)
