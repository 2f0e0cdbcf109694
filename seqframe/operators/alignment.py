"""Pairwise alignment of many pairs: global, semi-global, banded and local, with traceback.

Whole batches of pairs are filled at once, row by row. With a linear gap a row's left moves are a
running maximum: H[j] = max over k <= j of (t[k] + gap * (j - k)) for t = max(diagonal, up), so
H + j * |gap| is a cumulative maximum and needs no loop over columns. Directions are kept in one byte
a cell and all pairs of a batch are traced back in lock-step. Ties go to the diagonal, then up, then left.

Global alignments of like sequences fill only the diagonals that a best path can reach. With all gap symbols
in one place and d mismatches the score is 2 m - 3 d - 2 g, for the shorter length m and the difference g of
lengths; a path w diagonals beyond those from 0 to g has w more gap symbols on either side and at most
2 m - 2 g - 6 w. So a best path, and each one that ties, keeps within d // 2 of them, and the result is that of
the whole matrix.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AlignmentError

#: The scores of a match, a mismatch and a gap symbol.
MATCH, MISMATCH, GAP = 2, -1, -2
MODES = ("global", "semi-global", "local")
#: Longer sequences give a null result with a reason.
MOST_SYMBOLS = 15_000
#: Direction cells that one kernel call may hold.
CELLS = 1 << 26
_NEVER = -(10**9)
_DIAGONAL, _UP, _LEFT, _STOP = 0, 1, 2, 3

RESULT = (
    "score int, identity double, n_matches int, n_mismatches int, n_gaps int, aligned_a string, aligned_b string, mode string, "
    "a_start int, a_end int, b_start int, b_end int, "
    "mutations array<struct<kind:string,pos_a:int,pos_b:int,sym_a:string,sym_b:string>>, problem string"
)


def _padded(texts: list[bytes], width: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t, np.uint8)
    return out


def fill(a: list[bytes], b: list[bytes], mode: str, band: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(directions, score, end row, end column) of each pair."""
    pairs = len(a)
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, cols = int(m.max()), int(n.max())
    sa, sb = _padded(a, rows, 0), _padded(b, cols, 1)
    ramp = (-GAP * np.arange(cols + 1)).astype(np.int32)
    every = np.arange(pairs)
    way = np.empty((pairs, rows + 1, cols + 1), np.uint8)
    free = mode != "global"
    h = np.zeros((pairs, cols + 1), np.int32) if free else np.repeat(-ramp[None], pairs, axis=0)
    way[:, 0, :] = _STOP if free else _LEFT
    way[:, 0, 0] = _STOP
    if band is not None:
        h[:, band + 1 :] = _NEVER
    score = np.full(pairs, _NEVER, np.int64) if mode != "local" else np.zeros(pairs, np.int64)
    end_row, end_col = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    column = np.full(pairs, _NEVER, np.int64)  # best of the last column
    column_row = np.zeros(pairs, np.int64)
    inside = np.arange(cols + 1)[None, :] <= n[:, None]

    def look(i: int, h: np.ndarray) -> None:
        if mode == "global":
            at = m == i
            score[at], end_row[at], end_col[at] = h[every[at], n[at]], i, n[at]
        elif mode == "local":
            best = np.where(inside, h, -1).argmax(axis=1)
            value = h[every, best]
            better = (value > score) & (i <= m)
            score[better], end_row[better], end_col[better] = value[better], i, best[better]
        else:
            last = h[every, n]
            better = (last > column) & (i <= m)
            column[better], column_row[better] = last[better], i
            at = np.flatnonzero(m == i)
            if len(at):
                best = np.where(inside[at], h[at], _NEVER).argmax(axis=1)
                score[at], end_row[at], end_col[at] = h[at, best], i, best

    look(0, h)
    for i in range(1, rows + 1):
        s = np.where(sa[:, i - 1 : i] == sb, MATCH, MISMATCH).astype(np.int32)
        diagonal, up = h[:, :-1] + s, h[:, 1:] + GAP
        t = np.empty_like(h)
        t[:, 0] = 0 if free else GAP * i
        np.maximum(diagonal, up, out=t[:, 1:])
        if band is not None:
            lo, hi = max(0, i - band), min(cols, i + band)
            t[:, :lo] = _NEVER
            t[:, hi + 1 :] = _NEVER
        if mode == "local":
            np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp
        if band is not None:
            h[:, :lo] = _NEVER
            h[:, hi + 1 :] = _NEVER
        d = np.where(h[:, 1:] == diagonal, _DIAGONAL, np.where(h[:, 1:] == up, _UP, _LEFT)).astype(np.uint8)
        if mode == "local":
            d[h[:, 1:] == 0] = _STOP
        way[:, i, 1:] = d
        way[:, i, 0] = _STOP if free else _UP
        look(i, h)
    if mode == "semi-global":
        better = column > score
        score[better], end_row[better], end_col[better] = column[better], column_row[better], n[better]
    return way, score, end_row, end_col


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least mismatches of each pair (symbols in rows, all x of one length and all y) with all gap symbols in one place."""
    if x.shape[1] > y.shape[1]:
        x, y = y, x
    m, gaps = x.shape[1], y.shape[1] - x.shape[1]
    if not gaps:
        return (x != y).sum(axis=1)
    zero = np.zeros((len(x), 1), np.int32)
    before, behind = (np.hstack([zero, np.cumsum(x != z, axis=1, dtype=np.int32)]) for z in (y[:, :m], y[:, gaps:]))
    return (before - behind).min(axis=1) + behind[:, -1]


def fill_near(sa: np.ndarray, sb: np.ndarray, m: np.ndarray, n: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, score) of global alignments on the diagonals low to high (column less row) alone; symbols padded in rows, directions by row, diagonal and pair."""
    pairs, rows = sa.shape
    width, pad = high - low + 1, max(0, 1 - low)
    kind = np.int16 if 4 * (rows + sb.shape[1] + width) < 1 << 14 else np.int32
    never = kind(-(1 << 14) if kind is np.int16 else -(1 << 29))
    sa = np.ascontiguousarray(sa.T)
    other = np.full((pad + max(sb.shape[1], rows + high), pairs), 1, np.uint8)
    other[pad : pad + sb.shape[1]] = sb.T
    way = np.empty((rows + 1, width, pairs), np.uint8)
    column = low + np.arange(width)
    h = np.repeat(np.where(column >= 0, GAP * column, never).astype(kind)[:, None], pairs, axis=1)
    way[0] = np.where(column == 0, _STOP, _LEFT)[:, None]
    score, at = np.zeros(pairs, np.int64), n - m - low
    for i in range(1, rows + 1):
        first = pad + i - 1 + low
        diagonal = h + np.where(sa[i - 1] == other[first : first + width], kind(MATCH), kind(MISMATCH))
        up = np.full_like(h, never)
        np.add(h[1:], kind(GAP), out=up[:-1])
        h = np.maximum(diagonal, up)
        for k in range(1, width):
            np.maximum(h[k], h[k - 1] + kind(GAP), out=h[k])
        if i + low <= 0:
            h[: max(0, -low - i)] = never  # left of the matrix
        way[i] = np.where(h == diagonal, _DIAGONAL, np.where(h == up, _UP, _LEFT))
        ends = np.flatnonzero(m == i)
        score[ends] = h[at[ends], ends]
    return way, score


def trace_near(way: np.ndarray, m: np.ndarray, n: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``trace``, for the directions of ``fill_near``."""
    pairs = way.shape[2]
    i, j = m.copy(), n.copy()
    moves = np.full((int((m + n).max()) + 1, pairs), _STOP, np.uint8)
    count = np.zeros(pairs, np.int64)
    live, step = np.arange(pairs), 0
    while len(live):
        d = way[i[live], j[live] - i[live] - low, live]
        go = d != _STOP
        if not go.all():
            live, d = live[go], d[go]
        moves[step, live] = d
        i[live] -= d != _LEFT
        j[live] -= d != _UP
        count[live] += 1
        step += 1
    return np.ascontiguousarray(moves[: step + 1].T), count, i, j


def trace(way: np.ndarray, end_row: np.ndarray, end_col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(moves in reverse, their number, start row, start column), all pairs in lock-step."""
    pairs = len(way)
    i, j = end_row.copy(), end_col.copy()
    moves = np.full((pairs, int((i + j).max()) + 1), _STOP, np.uint8)
    count = np.zeros(pairs, np.int64)
    live = np.arange(pairs)
    step = 0
    while len(live):
        d = way[live, i[live], j[live]]
        go = d != _STOP
        live, d = live[go], d[go]
        moves[live, step] = d
        i[live] -= d != _LEFT
        j[live] -= d != _UP
        count[live] += 1
        step += 1
    return moves, count, i, j


def _read_off(a: list[str], b: list[str], moves: np.ndarray, count: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(upper line, lower line, column state, a places, b places) of all pairs; state: 0 match, 1 mismatch, 2 gap, 3 beyond the end."""
    width = max(1, int(count.max()))
    column = np.arange(width)
    valid = column < count[:, None]
    d = np.take_along_axis(moves, np.where(valid, count[:, None] - 1 - column, moves.shape[1] - 1), axis=1)
    from_a, from_b = valid & (d != _LEFT), valid & (d != _UP)
    pa_, pb = (start[:, None] + np.cumsum(f, axis=1) - f for start, f in ((i, from_a), (j, from_b)))
    sa, sb = (_padded([x.encode() for x in s], max(max(map(len, s)), int(p.max()) + 1), 45) for s, p in ((a, pa_), (b, pb)))
    top = np.where(from_a, np.take_along_axis(sa, pa_, axis=1), 45).astype(np.uint8)
    low = np.where(from_b, np.take_along_axis(sb, pb, axis=1), 45).astype(np.uint8)
    state = np.where(~valid, 3, np.where(d != _DIAGONAL, 2, (top != low).astype(np.int8)))
    return top, low, state, pa_, pb


def _changes(top: np.ndarray, low: np.ndarray, state: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in state]
    at = np.nonzero((state == 1) | (state == 2))
    for x, p, q, u, v in zip(at[0].tolist(), pa_[at].tolist(), pb[at].tolist(), top[at].tolist(), low[at].tolist(), strict=True):
        kind = "insertion" if u == 45 else "deletion" if v == 45 else "substitution"
        out[x].append({"kind": kind, "pos_a": p, "pos_b": q, "sym_a": chr(u), "sym_b": chr(v)})
    return out


def problem_of(a: str | None, b: str | None, band: int | None = None, most: int = MOST_SYMBOLS) -> str | None:
    """Why a pair cannot be aligned."""
    if a is None or b is None:
        return "missing sequence"
    if not a or not b:
        return "empty sequence"
    if "-" in a or "-" in b:
        return "gap symbol in a sequence"
    if not (a.isascii() and b.isascii()):
        return "symbol outside the alphabet"
    if max(len(a), len(b)) > most:
        return f"longer than {most} symbols"
    if band is not None and abs(len(a) - len(b)) > band:
        return "band narrower than the difference of lengths"
    return None


def check_options(mode: str, band: int | None) -> None:
    if mode not in MODES:
        raise AlignmentError(f"mode must be one of {', '.join(MODES)}")
    if band is not None and (band < 1 or mode != "global"):
        raise AlignmentError("a band must be at least 1 and needs mode 'global'")


def _groups(a: list[str], b: list[str], good: list[int]) -> Iterator[list[int]]:
    """Runs of pairs of like size whose direction cells fit in CELLS."""
    order = sorted(good, key=lambda k: (len(a[k]), len(b[k])))
    held: list[int] = []
    rows = cols = 0
    for k in order:
        r, c = max(rows, len(a[k])), max(cols, len(b[k]))
        if held and (len(held) + 1) * (r + 1) * (c + 1) > CELLS:
            yield held
            held, r, c = [], len(a[k]), len(b[k])
        held.append(k)
        rows, cols = r, c
    if held:
        yield held


def _same_sizes(a: list[bytes], b: list[bytes], good: list[int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(pairs, symbols of a, symbols of b) for the pairs of each size, with few enough symbols for running sums."""
    for (m, n), held in itertools.groupby(sorted(good, key=lambda k: (len(a[k]), len(b[k]))), key=lambda k: (len(a[k]), len(b[k]))):
        rest, most = list(held), max(1, CELLS // (8 * (m + n)))
        for at in range(0, len(rest), most):
            some = rest[at : at + most]
            yield some, *(np.frombuffer(b"".join([s[k] for k in some]), np.uint8).reshape(len(some), -1) for s in (a, b))


def _reaches(a: list[bytes], b: list[bytes], good: list[int]) -> tuple[list[tuple[int, int, int]], list[int]]:
    """((lowest, highest diagonal, pair) of the pairs that few diagonals settle, the other pairs)."""
    near, rest = [], []
    for some, x, y in _same_sizes(a, b, good):
        gap, reach = y.shape[1] - x.shape[1], differences(x, y) // 2
        for k, w in zip(some, reach.tolist(), strict=True):
            low, high = min(gap, 0) - w, max(gap, 0) + w
            if 2 * (high - low + 1) <= y.shape[1]:
                near.append((low, high, k))
            else:
                rest.append(k)
    return near, rest


def _near_groups(a: list[bytes], near: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Runs of pairs of the same diagonals and of like size, whose direction cells fit in CELLS."""
    for (low, high), run in itertools.groupby(sorted(near, key=lambda x: (x[0], x[1], len(a[x[2]]))), key=lambda x: x[:2]):
        held: list[int] = []
        for *_, k in run:
            if held and (len(held) + 1) * (len(a[k]) + 1) * max(high - low + 1, 32) > CELLS:  # with few diagonals it is reading off that takes the memory
                yield low, high, held
                held = []
            held.append(k)
        yield low, high, held


def align_batch(a: list[str], b: list[str], mode: str = "global", band: int | None = None, most: int = MOST_SYMBOLS, strict: bool = False) -> list[dict]:
    """A result per pair, in the fields of RESULT; a pair with a problem has nulls (or, if strict, is an error)."""
    check_options(mode, band)
    out: list[dict] = [{}] * len(a)
    good = []
    for k in range(len(a)):
        wrong = problem_of(a[k], b[k], band, most)
        if wrong is None:
            good.append(k)
        elif strict:
            raise AlignmentError(wrong)
        else:
            out[k] = dict.fromkeys(("score", "identity", "n_matches", "n_mismatches", "n_gaps", "aligned_a", "aligned_b", "a_start", "a_end", "b_start", "b_end", "mutations")) | {"mode": mode, "problem": wrong}
    if mode == "global" and band is None:
        x, y = ([(s or "").encode() for s in t] for t in (a, b))
        near, good = _reaches(x, y, good)
        for low, high, group in _near_groups(x, near):
            m, n = (np.array([len(s[k]) for k in group]) for s in (x, y))
            sa, sb = _padded([x[k] for k in group], int(m.max()), 0), _padded([y[k] for k in group], int(n.max()), 1)
            if low == high == 0:  # one diagonal, which all pairs go down whole
                _settle_straight(out, group, sa, sb, m, mode)
                continue
            way, score = fill_near(sa, sb, m, n, low, high)
            _settle(out, a, b, group, score, m, n, trace_near(way, m, n, low), mode)
    for group in _groups(a, b, good):
        way, score, row, col = fill([a[k].encode() for k in group], [b[k].encode() for k in group], mode, band)
        _settle(out, a, b, group, score, row, col, trace(way, row, col), mode)
    return out


def _settle(out: list[dict], a: list[str], b: list[str], group: list[int], score: np.ndarray, row: np.ndarray, col: np.ndarray, traced: tuple[np.ndarray, ...], mode: str) -> None:
    """Puts the results of a group in their places."""
    moves, count, i, j = traced
    read = _read_off([a[k] for k in group], [b[k] for k in group], moves, count, i, j)
    _put(out, group, read, score, count, i, row, j, col, mode)


def _settle_straight(out: list[dict], group: list[int], sa: np.ndarray, sb: np.ndarray, m: np.ndarray, mode: str) -> None:
    """As ``_settle``, for pairs of equal length without gaps."""
    place = np.broadcast_to(np.arange(sa.shape[1]), sa.shape)
    state = np.where(place < m[:, None], (sa != sb).astype(np.int8), np.int8(3))
    other, zero = (state == 1).sum(axis=1), np.zeros(len(m), np.int64)
    _put(out, group, (sa, sb, state, place, place), MATCH * (m - other) + MISMATCH * other, m, zero, m, zero, m, mode)


def _put(out: list[dict], group: list[int], read: tuple[np.ndarray, ...], score: np.ndarray, count: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray, mode: str) -> None:
    changes = _changes(*read)
    sums = ((read[2] == v).sum(axis=1).tolist() for v in range(3))
    width = read[0].shape[1]
    top, low = (np.ascontiguousarray(x).tobytes().decode() for x in read[:2])
    numbers = zip(group, count.tolist(), score.tolist(), *sums, a_start.tolist(), a_end.tolist(), b_start.tolist(), b_end.tolist(), changes, range(0, width * len(group), width), strict=True)
    for k, n, s, same, other, gaps, a0, a1, b0, b1, found, at in numbers:
        out[k] = {
            "score": s, "identity": same / n if n else 0.0, "n_matches": same, "n_mismatches": other, "n_gaps": gaps, "aligned_a": top[at : at + n], "aligned_b": low[at : at + n], "mode": mode,
            "a_start": a0, "a_end": a1, "b_start": b0, "b_end": b1, "mutations": found, "problem": None,
        }


def align(a: Column, b: Column, mode: str = "global", band: int | None = None, *, most: int = MOST_SYMBOLS, strict: bool = False) -> Column:
    """A struct of RESULT for each pair of sequences."""
    check_options(mode, band)

    @F.pandas_udf(RESULT)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(align_batch(x.tolist(), y.tolist(), mode, band, most, strict), columns=[f.split()[0] for f in ("score", "identity", "n_matches", "n_mismatches", "n_gaps", "aligned_a", "aligned_b", "mode", "a_start", "a_end", "b_start", "b_end", "mutations", "problem")])

    return run.asNondeterministic()(a, b)  # so that no filter on a field makes Catalyst align twice


def align_pairs(pairs: DataFrame, a_col: str = "a", b_col: str = "b", **options) -> DataFrame:
    """All columns of ``pairs`` and ``alignment``. Spread long pairs with ``repartition`` before, if few tasks hold them."""
    return pairs.withColumn("alignment", align(F.col(a_col), F.col(b_col), **options))


def midline(aligned_a: Column, aligned_b: Column) -> Column:
    """A bar under each match, X under a mismatch, a blank at a gap."""
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(aligned_a), F.lit(1))), lambda i: F.when(F.substr(aligned_a, i, F.lit(1)) == F.substr(aligned_b, i, F.lit(1)), "|").when((F.substr(aligned_a, i, F.lit(1)) == "-") | (F.substr(aligned_b, i, F.lit(1)) == "-"), " ").otherwise("X")), ""
    )


def format_alignment(aligned_a: Column, aligned_b: Column, width: int = 60) -> Column:
    """Blocks of three lines: a, the midline, b."""
    if width < 1:
        raise AlignmentError("width must be at least 1")
    lines = midline(aligned_a, aligned_b)
    starts = F.sequence(F.lit(1), F.greatest(F.length(aligned_a), F.lit(1)), F.lit(width))
    block = lambda i: F.concat_ws("\n", *(F.substr(x, i, F.lit(width)) for x in (aligned_a, lines, aligned_b)))
    return F.when(F.length(aligned_a) == 0, "").otherwise(F.array_join(F.transform(starts, block), "\n\n"))
