"""External induced suffix sorting with common-prefix values.

Suffixes are of type L or S as they are larger or smaller than the suffix behind them; an S suffix
behind an L one is a seed. Seeds are sorted first: the substrings from seed to seed are named in
order, and the string of names is sorted by the same method, level by level, until the names are
unique or so few that they fit in ``memory``. One pass upwards then induces all L suffixes, one pass
downwards all S suffixes.

Both passes are served by a monotone priority queue of suffix tuples (position, common prefix). As
arrival order is sorted order within a symbol, the queue is a file of runs per symbol; it keeps
``memory`` bytes of tuples and moves the rest to disk. Runs are popped a bounded piece at a time and
induce in one step: a tuple's common prefix with the one before it in its new bucket is one more than
the least common prefix between their sources. Names have too many symbols for a run each, so there the
queue has a run per group of symbols, and what a group induces into itself is ordered by doubling.

Text, seeds, names and orders are arrays of a ``Scratch``: above ``memory`` bytes they lie in unnamed files
of the task, which end with it, as Spark's own sorters spill. Everything else is made in pieces of
``memory`` / 64 elements, PIECE at most. Sorting and common prefixes go to ``depth`` symbols: suffixes that agree so far
count as equal.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np


#: Elements that are taken at once, at most: more would only leave the processor's caches.
PIECE = 1 << 17


class Scratch:
    """Arrays of one sort; those above ``memory`` bytes are mapped from unnamed files. ``mapped``: bytes in such files so far."""

    def __init__(self, memory: int):
        self.memory, self.mapped, self.spilled, self.levels = memory, 0, 0, 0
        self.piece = max(8, min(memory // 64, PIECE))

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.memory:
            return np.zeros(n, kind)
        self.mapped += size
        file = tempfile.TemporaryFile()  # noqa: SIM115  closed with the mapping
        file.truncate(size)
        return np.memmap(file, kind, "r+", shape=n)

    def pieces(self, n: int) -> Iterator[slice]:
        for at in range(0, n, self.piece):
            yield slice(at, min(at + self.piece, n))


class TupleQueue:
    """Runs of suffix tuples per key, popped in order of arrival; beyond ``memory`` bytes the runs lie on disk."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.held, self.file = scratch, 0, None
        self.runs: dict[int, deque] = defaultdict(deque)
        self.count: dict[int, int] = defaultdict(int)

    def push(self, key: int, *columns: np.ndarray) -> None:
        if len(columns[0]) == 0:
            return
        self.runs[key].append(columns)
        self.count[key] += len(columns[0])
        self.held += sum(c.nbytes for c in columns)
        if self.held > self.scratch.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115  closed with the queue
        self.file.seek(0, 2)
        for key, runs in self.runs.items():
            if not any(isinstance(r[0], np.ndarray) for r in runs):
                continue
            kept: deque = deque()
            group: list[tuple] = []

            def flush(group=group, kept=kept) -> None:
                if group:
                    columns = [np.concatenate(x) for x in zip(*group, strict=True)]
                    kept.append((self.file.tell(), len(columns[0]), tuple(c.dtype for c in columns)))
                    for c in columns:
                        self.file.write(np.ascontiguousarray(c).data)
                        self.scratch.spilled += c.nbytes
                    group.clear()

            for run in runs:
                if isinstance(run[0], np.ndarray):
                    group.append(run)
                else:
                    flush()
                    kept.append(run)
            flush()
            self.runs[key] = kept
        self.held = 0

    def _load(self, run: tuple, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        if isinstance(run[0], np.ndarray):
            return tuple(c[lo:hi] for c in run)
        place, n, kinds = run
        out = []
        for kind in kinds:
            self.file.seek(place + lo * kind.itemsize)
            out.append(np.frombuffer(self.file.read((hi - lo) * kind.itemsize), kind))
            place += n * kind.itemsize
        return tuple(out)

    def pop(self, key: int, most: int, last: bool = False) -> tuple[np.ndarray, ...] | None:
        """The first (or last) ``most`` tuples of a key, in order of arrival; None if there are none."""
        runs, out, wanted = self.runs.get(key), [], most
        while runs and wanted:
            run = runs.pop() if last else runs.popleft()
            here = isinstance(run[0], np.ndarray)
            n = len(run[0]) if here else run[1]
            take = min(n, wanted)
            lo = n - take if last else 0
            out.append(self._load(run, lo, lo + take))
            if here:
                self.held -= sum(c.nbytes for c in out[-1])
            if take < n:
                rest = (0, lo) if last else (take, n)
                left = self._load(run, *rest)  # a loaded rest counts as held
                if not here:
                    self.held += sum(c.nbytes for c in left)
                (runs.append if last else runs.appendleft)(left)
            wanted -= take
        if not out:
            self.runs.pop(key, None)
            return None
        self.count[key] -= most - wanted
        if last:
            out.reverse()
        return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _least(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least value in [lo, hi] of each query, from a table of power-of-two minima."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int16)
    for k in range(int(level.max()) + 1 if len(level) else 0):
        which = np.flatnonzero(level == k)
        if len(which):
            out[which] = np.minimum(table[k][lo[which]], table[k][hi[which] - (1 << k) + 1])
    return out


def _minima(values: np.ndarray) -> list[np.ndarray]:
    table, width = [values], 1
    while 2 * width <= len(values):
        last = table[-1]
        table.append(np.minimum(last[:-width], last[width:]))
        width *= 2
    return table


def _runs_of(keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


class _Level:
    """A string of integers from 1 to ``symbols`` - 1 (the end counts as smaller than all) with its seeds."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, scratch: Scratch):
        self.symbols, self.depth, self.scratch, self.n = symbols, depth, scratch, len(text)
        self.padded = scratch.array(self.n + 16, text.dtype)
        for s in scratch.pieces(self.n):
            self.padded[s] = text[s]
        self.text = self.padded[: self.n]
        # of bytes, the eight from any place on as one number
        self.wide = np.ndarray(self.n + 9, ">u8", self.padded, strides=(1,)) if self.padded.dtype == np.uint8 else None
        self.seeds = self._seeds()
        self.distinct = 0

    def _found(self) -> Iterator[np.ndarray]:
        """Seeds piece by piece: first places of runs of one symbol that are less than both their neighbours."""
        before, candidate = None, None  # the last symbol so far; a run that fell and waits for the next symbol
        for s in self.scratch.pieces(self.n):
            x = self.text[s]
            new = np.append(before is None or x[0] != before, x[1:] != x[:-1])
            at = np.flatnonzero(new)
            if len(at) == 0:
                continue
            symbol = x[at].astype(np.int64)
            prior = np.append(-1 if before is None else before, symbol[:-1])
            falls = prior > symbol
            if candidate is not None and symbol[0] > prior[0]:
                yield np.array([candidate])
            yield at[:-1][falls[:-1] & (symbol[1:] > symbol[:-1])] + s.start
            candidate = int(at[-1]) + s.start if falls[-1] else None
            before = int(x[-1])

    def _seeds(self) -> np.ndarray:
        out = self.scratch.array(sum(len(x) for x in self._found()), np.int64)
        done = 0
        for x in self._found():
            out[done : done + len(x)] = x
            done += len(x)
        return out

    def _words(self, at: np.ndarray) -> np.ndarray:
        """The eight symbols from each place on."""
        if self.wide is not None:
            return self.wide[at].view(np.uint8).reshape(-1, 8)
        return self.padded[at[:, None] + np.arange(8)]

    def _alike_words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many of the eight symbols from two places on are alike before the first that is not."""
        if self.wide is None:
            unlike = self._words(a) != self._words(b)
            return np.where(unlike.any(axis=1), unlike.argmax(axis=1), 8)
        unlike = self.wide[a].astype(np.uint64) ^ self.wide[b].astype(np.uint64)
        high = (unlike >> np.uint64(32)).astype(np.float64)
        low = (unlike & np.uint64(0xFFFFFFFF)).astype(np.float64)
        bits = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])  # places of the highest unlike bits, from 1
        return 8 - (bits + 7) // 8

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to depth."""
        out = np.zeros(len(a), np.int16)
        n, left = self.n, np.arange(len(a))
        for done in range(0, self.depth, 8):
            left = left[(a[left] + done < n) & (b[left] + done < n)]
            if len(left) == 0:
                break
            alike = self._alike_words(a[left] + done, b[left] + done)
            out[left] = done + alike
            left = left[alike == 8]
        bound = np.minimum(np.minimum(n - a, n - b), self.depth)
        return np.minimum(out, bound).astype(np.int16)

    # --- names of seeds

    def _lengths(self, which: np.ndarray) -> np.ndarray:
        m = len(self.seeds)
        after = self.seeds[np.minimum(which + 1, m - 1)]
        return np.where(which < m - 1, after - self.seeds[which] + 1, self.n - self.seeds[which])

    def _at(self, which: np.ndarray, offset: int) -> np.ndarray:
        """A symbol of each seed's substring; beyond it one above all (it is larger than its extensions), beyond the text 0."""
        past = offset >= self._lengths(which)
        out = self.padded[np.minimum(self.seeds[which] + offset, self.n)].astype(np.int64)
        out[past] = self.symbols
        out[past & (which == len(self.seeds) - 1)] = 0
        return out

    def ranks(self) -> np.ndarray:
        """For each seed the number of seeds with a smaller substring. Sets of seeds that do not fit are split by one symbol after the other."""
        m, scratch = len(self.seeds), self.scratch
        rank = scratch.array(m, np.int64)
        whole = scratch.array(m, np.int64)
        for s in scratch.pieces(m):
            whole[s] = np.arange(s.start, s.stop)
        todo: list[tuple[np.ndarray, int, int]] = [(whole, 0, 0)]
        while todo:
            which, offset, base = todo.pop()
            if len(which) <= scratch.piece:
                which = np.array(which)
                rank[which] = base + self._ranked(which, offset)
                continue
            if offset >= max(self.depth, 1):
                self._alike(rank, which, base)
                continue
            sizes = scratch.array(self.symbols + 2, np.int64)
            for s in scratch.pieces(len(which)):
                keys, n = np.unique(self._at(which[s], offset), return_counts=True)
                sizes[keys + 1] += n
            starts = scratch.array(self.symbols + 2, np.int64)
            total = 0
            for s in scratch.pieces(len(sizes)):
                starts[s] = np.cumsum(sizes[s]) + total
                total += int(sizes[s].sum())
            sizes[:] = 0
            dealt = scratch.array(len(which), np.int64)
            for s in scratch.pieces(len(which)):
                part = which[s]
                keys = self._at(part, offset)
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                first = _runs_of(keys)
                n = np.diff(np.append(first, len(keys)))
                to = np.repeat(starts[keys[first]] + sizes[keys[first]] - first, n) + np.arange(len(keys))
                dealt[to] = part[order]
                sizes[keys[first]] += n
            lo = 0
            while lo < len(which):  # as many symbols at once as fit, or one that does not
                key = int(np.searchsorted(starts, lo, side="right")) - 1
                end = int(starts[key + 1]) if key + 1 < len(starts) else len(which)
                if end - lo > scratch.piece:
                    if key == self.symbols:
                        self._alike(rank, dealt[lo:end], base + lo)
                    else:
                        todo.append((dealt[lo:end], offset + 1, base + lo))
                else:
                    more = int(np.searchsorted(starts, lo + scratch.piece, side="right")) - 1
                    end = max(end, int(starts[more]))
                    part = np.array(dealt[lo:end])
                    rank[part] = base + lo + self._ranked(part, offset)
                lo = end
        return rank

    def _alike(self, rank: np.ndarray, which: np.ndarray, base: int) -> None:
        self.distinct += 1
        for s in self.scratch.pieces(len(which)):
            rank[which[s]] = base

    def _ranked(self, which: np.ndarray, offset: int) -> np.ndarray:
        """Ranks of some seeds, whose substrings agree up to ``offset``, among themselves."""
        seeds, n = self.seeds[which], self.n
        lengths = self._lengths(which)
        last = which == len(self.seeds) - 1
        high = self.symbols
        rank = np.zeros(len(which), np.int64)
        open_ = np.arange(len(which))
        narrow = self.padded.dtype == np.uint8 and high < 256
        closed = 0
        for done in range(offset, max(self.depth, 1), 8):
            symbols = self._words(np.minimum(seeds[open_] + done, n + 8))
            if not narrow:
                symbols = symbols.astype(np.int64)
            past = np.arange(done, done + 8) >= lengths[open_][:, None]
            symbols[past] = high
            symbols[past & last[open_][:, None]] = 0
            keys = [symbols.view(">u8").reshape(-1).astype(np.uint64)] if narrow else [symbols[:, i] for i in range(7, -1, -1)]
            order = np.argsort(keys[0]) if done == offset and narrow else np.lexsort((*keys, rank[open_]))
            ranks = rank[open_][order]
            new = np.append(True, ranks[1:] != ranks[:-1])
            group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            for k in keys:
                k = k[order]
                new[1:] |= k[1:] != k[:-1]
            inner = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) - group
            rank[open_[order]] = ranks + inner
            # go on where several share a rank and some reach further
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(order)))
            longest = np.maximum.reduceat(lengths[open_][order], starts)
            again = (size > 1) & (longest > done + 8) & (done + 8 < self.depth)
            closed += int((~again).sum())
            open_ = np.sort(open_[order[np.repeat(again, size)]])
            if len(open_) == 0:
                break
        self.distinct += closed
        return rank

    def sorted_seeds(self) -> np.ndarray:
        """The seeds in order of their suffixes."""
        m, scratch = len(self.seeds), self.scratch
        if m == 0:
            return self.seeds
        rank = self.ranks()
        out = scratch.array(m, np.int64)
        if self.distinct < m:
            depth = self.depth // 2 + 2  # seeds lie two symbols apart at least
            if 64 * m <= scratch.memory:
                out[_doubled(np.array(rank), depth)] = self.seeds
                return out
            scratch.levels += 1
            for s in scratch.pieces(m):
                rank[s] += 1
            order = _Names(rank, m + 1, depth, scratch).ascending()
            for s in scratch.pieces(m):
                out[s] = self.seeds[order[s]]
            return out
        for s in scratch.pieces(m):
            out[rank[s]] = self.seeds[s]
        return out


class _Bytes(_Level):
    """The lowest level: few symbols, a run of the queue for each, common prefixes carried."""

    def _pass(self, symbol: int, at: np.ndarray, common: np.ndarray, keep: np.ndarray, queue: TupleQueue, carry: np.ndarray) -> None:
        """Pushes what a popped batch induces. keep: whether the suffix before each one is induced by it."""
        table = _minima(common)
        idx = np.flatnonzero(keep)
        if len(idx):
            target = self.text[at[idx] - 1]
            order = np.argsort(target, kind="stable")
            j, target = idx[order], target[order]
            fresh = np.ones(len(j), bool)
            fresh[1:] = target[1:] != target[:-1]
            lo = np.zeros(len(j), np.int64)
            lo[1:] = np.where(fresh[1:], 0, j[:-1] + 1)
            value = _least(table, lo, j)
            value[fresh] = np.minimum(value[fresh], carry[target[fresh]])
            value = np.minimum(value + 1, self.depth).astype(np.int16)
            begins = np.flatnonzero(fresh)
            bounds = np.append(begins, len(j))
        least = int(common.min())
        np.minimum(carry, least, out=carry)
        if len(idx):
            last = j[bounds[1:] - 1]
            tail = np.full(len(last), self.depth, np.int16)
            inner = np.flatnonzero(last + 1 < len(at))
            if len(inner):
                tail[inner] = _least(table, last[inner] + 1, np.full(len(inner), len(at) - 1))
            carry[target[begins]] = tail
            before = at[j] - 1
            for k in range(len(begins)):
                s = slice(bounds[k], bounds[k + 1])
                queue.push(int(target[begins[k]]), before[s], value[s])

    def _rest_of_runs(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """All earlier places of the runs of one symbol that hold these places: beyond ``depth`` rounds they are equal for us."""
        for a in at.tolist():
            end = a
            while end > 0:
                lo = max(0, end - self.scratch.piece)
                other = np.flatnonzero(self.text[lo:end] != self.text[a])
                begin = lo + int(other[-1]) + 1 if len(other) else lo
                if begin < end:
                    yield np.arange(end - 1, begin - 1, -1)
                if len(other):
                    break
                end = begin

    def _own(self, symbol: int, queue: TupleQueue, carry: np.ndarray, upwards: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pops all tuples of a symbol, those that it induces itself included, and passes them on."""
        text, depth = self.text, self.depth
        rounds, left = 0, queue.count[symbol]
        while left or queue.count[symbol]:
            if left == 0:
                rounds, left = rounds + 1, queue.count[symbol]
            at, common = queue.pop(symbol, min(left, self.scratch.piece))
            left -= len(at)
            before = text[np.maximum(at - 1, 0)]
            if rounds > depth:
                keep = before > symbol if upwards else before < symbol
            else:
                keep = before >= symbol if upwards else before <= symbol
            yield at, common
            self._pass(symbol, at, common, (at > 0) & keep, queue, carry)
            if rounds > depth:
                for more in self._rest_of_runs(at):
                    same = np.full(len(more), depth, np.int16)
                    before = text[np.maximum(more - 1, 0)]
                    yield more, same
                    self._pass(symbol, more, same, (more > 0) & (before > symbol if upwards else before < symbol), queue, carry)

    def down(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in descending order with the common prefix of each and the one before it (the next larger)."""
        text, n, depth, scratch = self.text, self.n, self.depth, self.scratch
        if n == 0:
            return
        seeds = self.sorted_seeds()
        cuts = np.zeros(self.symbols + 1, np.int64)
        for s in scratch.pieces(len(seeds)):
            cuts[1:] += np.bincount(text[seeds[s]], minlength=self.symbols)[: self.symbols]
        cuts = np.cumsum(cuts)
        queue, larger = TupleQueue(scratch), TupleQueue(scratch)
        carry = np.full(self.symbols + 1, -1, np.int16)
        queue.push(int(text[-1]), np.array([n - 1]), np.zeros(1, np.int16))  # induced by the end mark
        carry[int(text[-1])] = depth
        for symbol in range(1, self.symbols):
            final = None
            for at, common in self._own(symbol, queue, carry, True):
                larger.push(symbol, at, common)
                final = int(at[-1])
            for lo in range(int(cuts[symbol]), int(cuts[symbol + 1]), scratch.piece):
                at = np.array(seeds[lo : min(lo + scratch.piece, int(cuts[symbol + 1]))])
                common = np.zeros(len(at), np.int16)
                common[1:] = self.common(at[:-1], at[1:])
                if final is not None:
                    common[0] = self.common(np.array([final]), at[:1])[0]
                final = int(at[-1])
                self._pass(symbol, at, common, at > 0, queue, carry)
        queue.close()
        queue = TupleQueue(scratch)
        carry = np.full(self.symbols + 1, -1, np.int16)
        for symbol in range(self.symbols - 1, 0, -1):
            final, between = None, None
            for at, common in self._own(symbol, queue, carry, False):
                yield at, common
                final = int(at[-1])
            while (batch := larger.pop(symbol, scratch.piece, last=True)) is not None:
                at, common = batch[0][::-1], np.zeros(len(batch[0]), np.int16)
                common[1:] = batch[1][:0:-1]
                if between is not None:
                    common[0] = between
                elif final is not None:
                    common[0] = self.common(np.array([final]), at[:1])[0]
                between = batch[1][0]
                yield at, common
                self._pass(symbol, at, common, (at > 0) & (text[np.maximum(at - 1, 0)] < symbol), queue, carry)
        queue.close()
        larger.close()


class _Names(_Level):
    """A level of names: many symbols, taken in groups that fit in memory; order alone, no common prefixes."""

    def ascending(self) -> np.ndarray:
        """All suffixes in order."""
        scratch, text, n = self.scratch, self.text, self.n
        out = scratch.array(n, np.int64)
        seeds = self.sorted_seeds()
        bounds, heavy = self._groups()
        group_of = lambda s: np.searchsorted(bounds, s, side="right") - 1
        cuts = np.zeros(len(bounds) + 1, np.int64)
        for s in scratch.pieces(len(seeds)):
            cuts[1:] += np.bincount(group_of(text[seeds[s]]), minlength=len(bounds))
        cuts = np.cumsum(cuts)
        queue, larger = TupleQueue(scratch), TupleQueue(scratch)

        def send(at: np.ndarray, here: int, upwards: bool) -> None:
            """Pushes the suffixes before the given ones (which are in order), where these induce them in another group."""
            at = at[at > 0]
            before, symbol = text[at - 1], text[at]
            group = group_of(before)
            go = group > here if upwards else group < here
            at, group = at[go] - 1, group[go]
            order = np.argsort(group, kind="stable")
            at, group = at[order], group[order]
            first = _runs_of(group)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=False):
                queue.push(int(group[a]), at[a:b])

        queue.push(int(group_of(text[-1:])[0]), np.array([n - 1]))
        for g in range(len(bounds)):
            lo, hi = int(cuts[g]), int(cuts[g + 1])
            if heavy[g]:
                while (batch := queue.pop(g, scratch.piece)) is not None:
                    larger.push(g, batch[0])
                    self._again(queue, g, batch[0])
                    send(batch[0], g, True)
                for a in range(lo, hi, scratch.piece):
                    part = np.array(seeds[a : min(a + scratch.piece, hi)])
                    send(part, g, True)
                continue
            found = queue.pop(g, n)
            first = found[0] if found else np.zeros(0, np.int64)
            at, kind = self._closed(first, np.array(seeds[lo:hi]), bounds, g, True)
            larger.push(g, at[kind < 2])
            send(at, g, True)
        queue.close()
        queue = TupleQueue(scratch)
        done = n

        def put(at: np.ndarray) -> None:
            nonlocal done
            out[done - len(at) : done] = at[::-1]
            done -= len(at)

        for g in range(len(bounds) - 1, -1, -1):
            if heavy[g]:
                while (batch := queue.pop(g, scratch.piece)) is not None:
                    put(batch[0])
                    self._again(queue, g, batch[0])
                    send(batch[0], g, False)
                while (batch := larger.pop(g, scratch.piece, last=True)) is not None:
                    at = batch[0][::-1]
                    put(at)
                    send(at, g, False)
                continue
            found, above = queue.pop(g, n), larger.pop(g, n)
            first = found[0] if found else np.zeros(0, np.int64)
            at, _ = self._closed(first, above[0][::-1] if above else np.zeros(0, np.int64), bounds, g, False)
            put(at)
            send(at, g, False)
        queue.close()
        larger.close()
        return out

    def _groups(self) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of the groups, and whether a group is one symbol that does not fit in memory."""
        scratch = self.scratch
        sizes = scratch.array(self.symbols, np.int64)
        for s in scratch.pieces(self.n):
            symbols, n = np.unique(self.text[s], return_counts=True)
            sizes[symbols] += n
        bounds, heavy, filled = [0], [False], 0
        for s in scratch.pieces(self.symbols):
            x = np.array(sizes[s])
            at = 0
            while at < len(x):
                sums = np.cumsum(x[at:])
                room = scratch.piece - filled
                fit = int(np.searchsorted(sums, room, side="right"))
                if fit:
                    filled += int(sums[fit - 1])
                    at += fit
                if at == len(x):
                    break
                big = bool(x[at] > scratch.piece)
                if s.start + at > bounds[-1]:
                    bounds.append(s.start + at)
                    heavy.append(big)
                else:
                    heavy[-1] = big
                filled = int(x[at])
                at += 1
                if big:
                    filled = 0
                    if s.start + at < self.symbols:
                        bounds.append(s.start + at)
                        heavy.append(False)
        return np.array(bounds), np.array(heavy)

    def _again(self, queue: TupleQueue, g: int, at: np.ndarray) -> None:
        """Of one symbol's suffixes, in order, those that the same symbol stands before go to its own queue."""
        some = at[at > 0]
        queue.push(g, some[self.text[some - 1] == self.text[some]] - 1)

    def _closed(self, first: np.ndarray, other: np.ndarray, bounds: np.ndarray, g: int, upwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """(places in order, kinds) of a group's suffixes: ``first`` came from other groups (kind 0), what the group induces itself is of kind 1, ``other`` (of the other type) of kind 2.

        Of one symbol, ``first`` come first, as they arrived; the induced are in order of what induced them;
        ``other`` come last. Upwards order ascends, downwards it descends.
        """
        text = self.text
        low, high = int(bounds[g]), int(bounds[g + 1]) if g + 1 < len(bounds) else self.symbols
        at = [first, other]
        source = [np.arange(len(first)), np.arange(len(first), len(first) + len(other))]
        kind = [np.zeros(len(first), np.int8), np.full(len(other), 2, np.int8)]
        total = len(first) + len(other)
        place, number = np.concatenate(at), np.arange(total)
        second = np.concatenate(kind) == 2
        while len(place):
            some = place > 0
            place, number, second = place[some], number[some], second[some]
            before, symbol = text[place - 1], text[place]
            keep = (before >= low) & (before < high)
            if upwards:
                keep &= (before > symbol) | ((before == symbol) & ~second)
            else:
                keep &= (before < symbol) | ((before == symbol) & ~second)
            place, number = place[keep] - 1, number[keep]
            at.append(place)
            source.append(number)
            kind.append(np.ones(len(place), np.int8))
            number = np.arange(total, total + len(place))
            second = np.zeros(len(place), bool)
            total += len(place)
        at, source, kind = (np.concatenate(x) for x in (at, source, kind))
        if len(at) == 0:
            return at, kind
        symbol = text[at].astype(np.int64) - low
        if not upwards:
            symbol = high - low - symbol
        order, new = _sorted_by(4 * symbol + kind, np.where(kind == 1, 0, np.arange(len(at))))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new)
        step = 1
        while not new.all() and step <= 2 * self.depth:
            order, new = _sorted_by(rank, rank[source])
            fresh = np.empty(len(at), np.int64)
            fresh[order] = np.cumsum(new)
            rank, source, step = fresh, source[source], 2 * step
        return at[order], kind[order]


def _sorted_by(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by two keys of no negative numbers, and where in it a new pair begins; one sort, where the two fit in one number."""
    width = int(second.max()).bit_length()
    if int(first.max()).bit_length() + width <= 62:
        both = first << width | second
        order = np.argsort(both, kind="stable")
        both = both[order]
        return order, np.append(True, both[1:] != both[:-1])
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))


def _doubled(rank: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of all suffixes of a short string, given as ranks of its symbols, by prefix doubling of what is still equal."""
    rank, m, h = rank.astype(np.int64), len(rank), 1
    left = np.argsort(rank, kind="stable")
    starts = _runs_of(rank[left])
    while h < depth:
        size = np.diff(np.append(starts, len(left)))
        left = left[np.repeat(size > 1, size)]
        if len(left) == 0:
            break
        ahead = np.where(left + h < m, rank[np.minimum(left + h, m - 1)] + 1, 0)
        sub = np.lexsort((ahead, rank[left]))
        left, ahead = left[sub], ahead[sub]
        held = rank[left]
        place = np.arange(len(left))
        begin = np.maximum.accumulate(np.where(np.append(True, np.diff(held) != 0), place, 0))
        new = np.append(True, (np.diff(held) != 0) | (np.diff(ahead) != 0))
        rank[left] = held + np.maximum.accumulate(np.where(new, place, 0)) - begin
        starts = np.flatnonzero(new)
        h *= 2
    order = np.argsort(rank, kind="stable")
    out = np.empty(m, np.int64)
    out[order] = np.arange(m)
    return out


def suffixes_down(text: np.ndarray, symbols: int, depth: int, memory: int = 32 << 20, scratch: Scratch | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches (places, common prefixes) of all suffixes of ``text`` in descending order, compared up to ``depth`` symbols.

    text: integers from 1 to ``symbols`` - 1. ``memory``: bytes that a queue or an array may take before it goes to disk.
    """
    yield from _Bytes(text, symbols, depth, scratch or Scratch(memory)).down()
