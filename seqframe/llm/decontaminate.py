"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are folded to lower-case words joined by single spaces. An item of n characters
may differ by up to ``rate`` * n edits; cut into one piece more than that, at least one piece occurs
unchanged in any such occurrence. A sorted table of piece hashes, behind a bit map, finds all pieces in a
block of texts at once. A hit is verified by Myers' bit-parallel edit distance, first on the part of the
item around the piece and then on ever larger parts: halves share the budget so that an occurrence within
it has a half within the half's share. So almost all chance hits end after a few characters, and none that
counts is lost.

The items travel to the tasks in blocks of about ``block_bytes``, so what is broadcast does not grow with
the table: a piece takes some 40 bytes there, and parts of items are made when a hit needs them. One pass
over the texts serves a benchmark of one block; a larger one takes a pass for each block.

An item of fewer than ``least_chars`` folded characters has no budget: it goes whole into the same
table and counts where it stands unchanged between word borders. In scripts written without spaces
every place between two characters is a border.

Edge cases: null and empty texts match nothing, nor do items without a letter or digit; repeated rows and
repeated items each give their own result rows; ties of distance go to the first occurrence; empty tables
give an empty result; extra columns are ignored; long texts are searched whole.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, pick, without

#: Characters of a piece that its hash covers, at most; the rest is compared.
HASHED = 16
_STEP, _OTHER = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_GAPS = re.compile(r"[\W_]+")


#: Thai, Lao, Burmese, Khmer, kana and Han letters; these scripts put no spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def on_border(folded: str, at: int) -> bool:
    """Whether a word may begin or end before place ``at`` of a folded text."""
    if at == 0 or at == len(folded):
        return True
    pair = folded[at - 1 : at + 1]
    return " " in pair or _UNSPACED.search(pair) is not None


def fold(text: str) -> str:
    return _GAPS.sub(" ", text.lower()).strip()


class Part:
    """A part of an item with its share of the error budget, and the larger part that it belongs to."""

    __slots__ = ("_masks", "above", "budget", "item", "start", "text")

    def __init__(self, item: int, text: str, start: int, budget: int, above: Part | None):
        self.item, self.text, self.start, self.budget, self.above = item, text, start, budget, above
        self._masks: dict[str, int] | None = None

    @property
    def masks(self) -> dict[str, int]:
        """For each character the places where it stands, as bits."""
        if self._masks is None:
            self._masks = {}
            for i, c in enumerate(self.text):
                self._masks[c] = self._masks.get(c, 0) | 1 << i
        return self._masks


def pieces(item: int, text: str, budget: int) -> list[Part]:
    """The item in budget + 1 exact pieces, each linked to the larger parts above it."""
    out, todo = [], [Part(item, text, 0, budget, None)]
    while todo:
        part = todo.pop()
        if part.budget == 0:
            out.append(part)
            continue
        left = (part.budget - 1) // 2  # left + right + 1 = budget: both halves over their shares make more than the budget
        right = part.budget - 1 - left
        cut = len(part.text) * (left + 1) // (part.budget + 1)
        todo += [Part(item, part.text[:cut], part.start, left, part), Part(item, part.text[cut:], part.start + cut, right, part)]
    return out


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """The least edit distance between a pattern, given by its masks, and any part of the text; the first end of such a part."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = score, 0
    get = masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        across = eq | minus
        eq |= ((eq & plus) + plus) ^ plus
        up = minus | (full & ~(eq | plus))
        down = plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, at
        up <<= 1
        down <<= 1
        plus = (down | ~(across | up)) & full
        minus = up & across & full
    return best, end


@functools.lru_cache(maxsize=100_000)
def _cuts(n: int, budget: int) -> tuple[tuple[int, int], ...]:
    """(start, length) of the pieces of an item of n characters, in order of their starts."""
    return tuple((p.start, len(p.text)) for p in sorted(pieces(0, "x" * n, budget), key=lambda p: p.start))


def _hashes(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, 32-bit hashes of all runs of so many characters), put together from runs of powers of two."""
    doubled = [codes * _STEP]
    while 2 << len(doubled) - 1 <= max(sizes, default=0):
        half = 1 << len(doubled) - 1
        doubled.append(doubled[-1][:-half] * _STEP + doubled[-1][half:] if len(codes) > half else codes[:0])
    for size in sizes:
        total, at = None, 0
        for k in reversed(range(size.bit_length())):
            if size >> k & 1:
                more = doubled[k][at:]
                total = more if total is None else total[: len(more)] * _OTHER + more[: len(total)]
                at += 1 << k
        total = total[: max(0, len(codes) - size + 1)]
        yield size, (total ^ total >> np.uint32(15)) * _OTHER


def _sibling_fits(folded: str, item: str, piece: Part, at: int) -> bool:
    """Whether the other piece of a part with a budget of one edit may follow, or precede, a piece found at ``at``.

    One of its halves is unchanged: the one beside the piece stands next to it, the other up to one place off.
    """
    above = piece.above
    if piece.start == above.start:
        lo, hi = piece.start + len(piece.text), above.start + len(above.text)
        mid, begin = (lo + hi) // 2, at + len(piece.text)
        near, far, place = item[lo:mid], item[mid:hi], begin + mid - lo
        return folded.startswith(near, begin) or any(folded.startswith(far, place + k) for k in (0, -1, 1))
    lo, hi = above.start, piece.start
    mid = (lo + hi) // 2
    near, far, place = item[mid:hi], item[lo:mid], at - (hi - lo)
    return (at >= hi - mid and folded.startswith(near, at - (hi - mid))) or any(place + k >= 0 and folded.startswith(far, place + k) for k in (0, -1, 1))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Matcher:
    """The items of one block, by the hashes of their pieces."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, least_chars: int):
        self.items: list[tuple[int | None, str, int]] = []
        self.short: set[int] = set()
        rows: dict[int, list[np.ndarray]] = defaultdict(list)  # by hashed size: hash, item, start, length
        for item_id, text in items:
            folded = fold(text)
            if not folded:
                continue
            short = len(folded) < least_chars
            budget = 0 if short else int(len(folded) * rate)
            if short:
                self.short.add(len(self.items))
            cuts = np.array(_cuts(len(folded), budget), np.int64)
            sizes = np.minimum(cuts[:, 1], HASHED)
            for size, every in _hashes(_points(folded), sorted(set(sizes.tolist()))):
                at = cuts[sizes == size]
                rows[size].append(np.stack([every[at[:, 0]].astype(np.int64), np.full(len(at), len(self.items)), at[:, 0], at[:, 1]]))
            self.items.append((item_id, folded, budget))
        self.tables: dict[int, np.ndarray] = {}
        for size in sorted(rows):
            table = np.concatenate(rows.pop(size), axis=1)
            self.tables[size] = table[:, np.argsort(table[0], kind="stable")]
        n = sum(t.shape[1] for t in self.tables.values())
        self.shift = np.uint32(32 - min(28, max(16, (16 * n).bit_length())))
        self.map = np.zeros(1 << 32 - int(self.shift), bool)
        for table in self.tables.values():
            self.map[table[0] >> int(self.shift)] = True
        self.parts: dict[int, dict[int, Part]] = {}

    def part(self, item: int, start: int) -> Part:
        """The piece of an item that begins at ``start``, linked to the parts above it."""
        if item not in self.parts:
            if len(self.parts) > 2000:  # made again when they are needed again
                self.parts.clear()
            _, text, budget = self.items[item]
            self.parts[item] = {p.start: p for p in pieces(item, text, budget)}
        return self.parts[item][start]

    def hits(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(place, item, start in the item, length) of all pieces in a folded text, in order of their places."""
        found = []
        for size, every in _hashes(_points(text), list(self.tables)):
            at = np.flatnonzero(self.map[every >> self.shift])
            table = self.tables[size]
            wanted = every[at].astype(np.int64)
            lo, hi = np.searchsorted(table[0], wanted, "left"), np.searchsorted(table[0], wanted, "right")
            some = np.flatnonzero(hi > lo)
            at, lo, n = at[some], lo[some], (hi - lo)[some]
            row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(at, n), *table[1:, row]]))
        if found:
            every_hit = np.concatenate(found, axis=1)
            yield from zip(*every_hit[:, np.argsort(every_hit[0], kind="stable")].tolist(), strict=True)

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, end in the folded text, budget) of each item within its budget, at its best place."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str]) -> list[list[tuple[int | None, int, int, int]]]:
        """``find`` of each text; the pieces of all are looked up together."""
        out: list[list] = [[] for _ in texts]
        if not self.items:
            return out
        folded = [fold(t) for t in texts]
        starts = np.cumsum([0, *(len(t) + 1 for t in folded)])
        by_text: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        whole = "\n".join(folded)  # no piece has a line end
        bounds = starts.tolist()
        k = 0
        for at, item, start, size in self.hits(whole):
            while at >= bounds[k + 1]:
                k += 1
            by_text[k].append((at - bounds[k], item, start, size))
        for k, hits in by_text.items():
            out[k] = self._verified(folded[k], hits)
        return out

    def _verified(self, folded: str, hits: list[tuple[int, int, int, int]]) -> list[tuple[int | None, int, int, int]]:
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, set[int]] = defaultdict(set)  # places at which items were verified whole
        for at, item, start, size in hits:
            if not folded.startswith(self.items[item][1][start : start + size], at):  # hashes alike, texts not
                continue
            if item in self.short:
                if item not in best and on_border(folded, at) and on_border(folded, at + size):
                    best[item] = (0, at + size)
                continue
            begin = at - start  # where the item would begin without edits
            if begin in seen[item]:
                continue
            part = self.part(item, start)
            found, end = 0, at + size
            if part.above is not None and part.above.budget == 1 and not _sibling_fits(folded, self.items[item][1], part, at):
                continue
            while part.above is not None:
                part = part.above
                # the piece is exact and the part within its share: its ends are off by no more than that
                slack = part.budget
                lo = max(0, begin + part.start - slack)
                found, end = myers(part.masks, len(part.text), folded[lo : begin + part.start + len(part.text) + slack])
                end += lo
                if found > part.budget:
                    break
            else:
                best[item] = min(best.get(item, (found, end)), (found, end))
            if part.above is None:
                seen[item].add(begin)
        return [(self.items[i][0], *b, self.items[i][2]) for i, b in best.items()]


_built: dict[int, Matcher] = {}


def _matcher(key: int, items: list, rate: float, least_chars: int) -> Matcher:
    """One table per block of items and worker process."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, rate, least_chars)
    return _built[key]


def find_items(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.1, least_chars: int = 12, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (document, item) within the item's budget: doc_id, item_id, distance, budget."""
    if not 0 <= rate < 1:
        raise ValueError("rate must lie in [0, 1)")
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("text is not null")
    tests = pick(benchmark, item_id=item_col, text=item_text_col).select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("text is not null")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1

    def search(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(*items.value, rate, least_chars)
            for batch in batches:
                for block in blocks(batch, "text", 1 << 19):
                    found = [(doc, hit[0], hit[1], hit[3]) for doc, hits in zip(block.column(0).to_pylist(), matcher.find_all(block.column(1).to_pylist()), strict=True) for hit in hits]
                    cols = list(zip(*found, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(cols)], names=["doc_id", "item_id", "distance", "budget"])

        return run

    out = None
    for b in range(n):
        block = tests.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b) if n > 1 else tests
        items = spark.sparkContext.broadcast((uuid.uuid4().int, [(r["item_id"], r["text"]) for r in block.collect()]))  # block_bytes in the mean
        part = rows.mapInArrow(lean(search(items)), "doc_id long, item_id long, distance int, budget int")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents in which no item was found, with all their columns."""
    return without(docs, id_col, find_items(docs, benchmark, id_col=id_col, **options).select("doc_id"))
