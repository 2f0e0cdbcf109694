"""Repeated passages by external induced suffix sorting over shards.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus. The
suffix sort runs over shards that are built so that equal strings always meet in one shard:

1. Texts are packed into parts (runs of whole documents in id order), written once to the shared folder.
2. Every window of ``length`` bytes has an anchor, its least hashed run of ANCHOR bytes. Windows in a
   row with one anchor make a fragment. Equal windows have equal anchors, so a window whose anchor
   occurs once in the corpus is settled: it does not repeat. Each part sends its distinct anchor
   hashes and their numbers to hashed buckets and gets back which of them other parts have too.
3. Fragments with repeated anchors are stored; equal fragments of one part are one row (the later ones are
   settled there). They go to the shard of their anchor, sorted by content: of equal ones all but the
   earliest are settled as they pass, and the others are appended to the shard's text, in a file of the task.
4. A shard is sorted by ``induced.suffixes_down``, with common-prefix values: a run of suffixes that
   share ``length`` bytes is one string, and all its places but the earliest are marked. Text, seeds, names
   and queues lie on disk above ``memory`` bytes, so a shard may be far larger than that.
5. The fragments of one anchor may differ at their ends only, and so many of them that they alone would fill
   a shard (``hot``) would make one of any size. Their windows are dealt by content instead: first by the core that CLASS windows
   in a row share, and where a core repeats by the whole window, as digests of 128 bits.
6. The marked spans go back to the parts and are cut from the texts.

Nothing is collected on the driver and no pairs are made. Texts move once, into the parts: these are
bucketed by part, so that both later joins bring the small side to them.

Order is (doc_id, start); null ids come last; rows of one id are in order of their parts. Edge cases:
null and empty texts, and texts shorter than ``length``, lose nothing; of repeated rows the first stays
whole; an empty table gives an empty result; extra columns are ignored; a text of any length is taken
whole, in overlapping pieces. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, U64, blocks, input_bytes, lean, materialize, mix, release, remove, salted, shuffle_partitions, text_views, work_path
from .induced import Scratch, suffixes_down

ANCHOR = 24
#: Text bytes of one part, and bytes of one step inside a part.
PART_BYTES = 8 << 20
STEP_BYTES = 1 << 20
#: Corpus bytes for each shard, in the mean; and the bytes that each array or queue of its sort holds before it goes to disk.
SHARD_BYTES = 4 << 20
MEMORY = 32 << 20
#: Bytes that the fragments of one anchor may take in its shard; beyond them its windows are dealt by content.
HOT_BYTES = 16 << 20
#: Windows of a hot anchor that share a core.
CLASS = 16
#: A byte that no UTF-8 text has; with symbols one higher than bytes it stays below 255.
GAP = 0xFD

_SPANS = pa.schema([("row", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
#: What a part sends. kind 0: spans that it settled itself; 1: a fragment for a shard; 2: a fragment of a hot anchor, which stands at ``anchor``.
_SENT = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("digest", pa.binary()), ("content", pa.binary()), ("anchor", pa.int32()), ("doc_id", pa.int64()), ("part", pa.int64()), ("row", pa.int32()), ("start", pa.int64())])
_SENT_SQL = "kind byte, bucket int, digest binary, content binary, anchor int, doc_id long, part long, row int, start long"
_WINDOWS = "key binary, content binary, doc_id long, part long, row int, start long"


def _dump(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue()


def _load(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


# --- parts ----------------------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, docs): runs of documents (doc_id, text as bytes, what else they carry) in id order, of about PART_BYTES."""
    from pyspark import TaskContext

    task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def part() -> pa.RecordBatch:
        nonlocal n, held, size
        table = pa.Table.from_batches(held)
        order = pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end")
        raw = _dump(table.take(order))
        n, held, size = n + 1, [], 0
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | n - 1], pa.int64()), pa.array([raw], pa.binary())], names=["part", "docs"])

    for batch in batches:
        for block in blocks(batch, "text", PART_BYTES // 4):
            texts = block.column(1).cast(pa.binary())
            held.append(block.set_column(1, pa.field("text", pa.binary()), texts))
            size += texts.nbytes
            if size >= PART_BYTES or sum(len(x) for x in held) > 1 << 20:
                yield part()
    if held:
        yield part()


def _steps(docs: pa.Table, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, document bounds, rows, starts in the documents): texts in steps; a long one in pieces that share ``length`` - 1 bytes."""
    buf: list[bytes] = []
    rows: list[int] = []
    starts: list[int] = []
    size = 0

    def step():
        flat = np.frombuffer(b"".join(buf), np.uint8)
        return flat, np.concatenate([[0], np.cumsum([len(x) for x in buf])]), np.array(rows), np.array(starts)

    for row, text in enumerate(docs.column("text")):
        text = text.as_py()
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, STEP_BYTES):
            piece = text[at : at + STEP_BYTES + length - 1]
            buf.append(piece)
            rows.append(row)
            starts.append(at)
            size += len(piece)
            if size >= STEP_BYTES:
                yield step()
                buf, rows, starts, size = [], [], [], 0
    if buf:
        yield step()


def _fragments(flat: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first byte, end, text, place of the anchor) of the fragments of texts of at least ``length`` bytes each."""
    n = len(flat)
    width = 1
    grams = BYTE_KEYS[flat]
    while width * 2 <= ANCHOR:  # hashes of runs of 1, 2, 4 ... bytes
        grams = mix(grams[:-width] * U64(0x9E3779B97F4A7C15)) + grams[width:]
        width *= 2
    rest = ANCHOR - width
    if rest:  # the last run overlaps
        grams = mix(grams[:-rest] * U64(0xC2B2AE3D27D4EB4F)) + grams[rest:]
    grams = mix(grams)
    keys = (grams & ~U64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    window = length - ANCHOR + 1
    width = 1
    while width * 2 <= window:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if window > width:
        keys = np.minimum(keys[: len(keys) - (window - width)], keys[window - width :])
    place = (keys & U64(0xFFFFFF)).astype(np.int64)  # of the anchor of the window at each byte
    real = np.ones(n - length + 1, bool)
    for b in bounds[1:-1]:
        real[max(0, b - length + 1) : b] = False
    new = real.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~real[:-1]
    first = np.flatnonzero(new)
    last = real.copy()
    last[:-1] &= (place[1:] != place[:-1]) | ~real[1:]
    end = np.flatnonzero(last) + length
    return grams[place[first]] >> U64(16), first, end, np.searchsorted(bounds, first, side="right") - 1, place[first]


# --- the operator ---------------------------------------------------------------------------


def removed_spans(docs: DataFrame, apply, out_schema, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, memory: int = MEMORY, hot: int | None = None) -> DataFrame:
    """``apply(documents, texts, spans)`` for each part -> RecordBatch of ``out_schema``.

    documents: the part's rows (doc_id, text as bytes and, with ``carry``, all columns of ``docs`` by
    place: c0, c1 ...); texts: theirs, null where a text is; spans: rows and bounds of the bytes to go, sorted and disjoint.
    hot: fragments of one anchor beyond which its windows are dealt by content.
    """
    if length < ANCHOR:
        raise ValueError(f"length must be at least {ANCHOR}")
    hot = HOT_BYTES // (2 * length) if hot is None else hot
    spark = docs.sparkSession
    base = work_path(spark, "suffixes")
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = [F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col)]
    more = [c for i, c in enumerate(flat.columns) if carry and i != docs.columns.index(text_col)]
    texts = flat.select(at[0].cast("long").alias("doc_id"), at[1].alias("text"), *more)
    joins = shuffle_partitions(spark)
    name = f"parts_{uuid.uuid4().hex}"
    try:
        texts.mapInArrow(lean(_pack), "part long, docs binary").write.format("parquet").bucketBy(joins, "part").option("path", f"{base}/parts").option("compression", "none").saveAsTable(name)
        parts = spark.table(name)
        shards = max(joins, input_bytes(parts) // SHARD_BYTES)  # the parts are files of known size

        def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = [_fragments(flat, bounds, length)[0] for flat, bounds, _, _ in _steps(_load(raw.as_py()), length)]
                    hashes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    bucket = (hashes % U64(shards)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    both, bucket = (hashes | np.minimum(n, 0xFFFF).astype(np.uint64) << U64(48))[order], bucket[order]
                    begin = _starts(bucket)
                    blobs = [x.tobytes() for x in np.split(both, begin[1:])] if len(both) else []
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[begin], pa.int32()), pa.array([part] * len(begin), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "part", "hashes"])

        def shared(table: pa.Table) -> pa.Table:
            """Which hashes of each part some other part has as well, or are hot; hot ones have their 49th bit set."""
            sets = [np.frombuffer(x.as_py(), "<u8") for x in table.column("hashes")]
            every = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            every, n = every & U64((1 << 48) - 1), (every >> U64(48)).astype(np.int64)
            order = np.argsort(every)
            every, owner, n = every[order], owner[order], n[order]
            first = _starts(every)
            size = np.diff(np.append(first, len(every)))
            many = np.repeat(np.add.reduceat(n, first) > hot, size) if len(every) else np.zeros(0, bool)
            kept = np.repeat(size > 1, size) | many
            every, owner = (every | many.astype(np.uint64) << U64(48))[kept], owner[kept]
            parted = np.argsort(owner, kind="stable")
            every, owner = every[parted], owner[parted]
            begin = _starts(owner)
            blobs = [x.tobytes() for x in np.split(every, begin[1:])] if len(every) else []
            return pa.table({"part": pa.array(table.column("part").to_numpy()[owner[begin]], pa.int64()), "hashes": pa.array(blobs, pa.binary())})

        repeated = parts.mapInArrow(lean(anchors), "bucket int, part long, hashes binary").groupBy("bucket").applyInArrow(shared, "part long, hashes binary")
        gathered = repeated.groupBy("part").agg(F.collect_list("hashes").alias("hashes"))

        def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, raw, blobs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    yield from _sent(part, _load(raw.as_py()), np.frombuffer(b"".join(blobs or []), "<u8"), length, shards)

        sent = parts.join(gathered, "part", "left").select("part", "docs", "hashes").mapInArrow(lean(fragments), _SENT_SQL)
        sent = materialize(sent, f"{base}/sent", codec="zstd")
        wanted = sent.where("kind = 1").select("bucket", "digest", "content", "doc_id", "part", "row", "start")
        dealt = wanted.repartition("bucket").sortWithinPartitions("bucket", "digest", F.col("doc_id").asc_nulls_last(), "part", "row", "start")
        marked = dealt.mapInArrow(lean(lambda batches: _sorted_shards(batches, length, memory)), "part long, spans binary")
        marked = marked.unionByName(sent.where("kind = 0").select("part", F.col("content").alias("spans")))
        hot_rows = sent.where("kind = 2")
        if not hot_rows.isEmpty():
            marked = marked.unionByName(_hot_spans(hot_rows, length, base))
        back = materialize(marked.groupBy("part").agg(F.collect_list("spans").alias("spans")), f"{base}/spans")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw, blobs in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    table = _load(raw.as_py())
                    spans = pa.concat_tables([_load(x) for x in blobs or []] or [_SPANS.empty_table()])
                    yield apply(table, table.column("text").to_pylist(), _union(*(spans.column(i).to_numpy() for i in range(3))))

        return materialize(parts.join(back, "part", "left").select("docs", "spans").mapInArrow(lean(cut), out_schema), f"{base}/done")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, *(f"{base}/{x}" for x in ("parts", "sent", "spans", "cores", "windows")))


def _starts(keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _sent(part: int, docs: pa.Table, flagged: np.ndarray, length: int, shards: int) -> Iterator[pa.RecordBatch]:
    """What a part sends: its distinct fragments with repeated anchors, and the spans of fragments that repeat an earlier one of the part.

    flagged: hashes that other parts have or that are hot; the 49th bit tells which are.
    """
    steps = list(_steps(docs, length))
    found = [_fragments(flat, bounds, length) for flat, bounds, _, _ in steps]
    if not found:
        return
    flagged = np.sort(flagged & U64((1 << 49) - 1))
    elsewhere = np.unique(flagged & U64((1 << 48) - 1))
    hot = np.sort(flagged[flagged >> U64(48) > 0] & U64((1 << 48) - 1))
    values, n = np.unique(np.concatenate([x[0] for x in found]), return_counts=True)
    wanted = np.union1d(values[n > 1], elsewhere)
    ids = docs.column("doc_id").to_pylist()
    seen: set[bytes] = set()
    own: list[tuple[int, int, int]] = []
    for (flat, bounds, rows, starts), (hashes, first, end, text, place) in zip(steps, found, strict=True):
        at = np.minimum(np.searchsorted(wanted, hashes), max(len(wanted) - 1, 0))
        chosen = np.flatnonzero(wanted[at] == hashes) if len(wanted) else np.zeros(0, np.int64)
        whole = flat.tobytes()
        bucket = (hashes[chosen] % U64(shards)).astype(np.int64).tolist()
        is_hot = (np.isin(hashes[chosen], hot)).tolist()
        row = rows[text[chosen]].tolist()
        begin = (first[chosen] - bounds[text[chosen]] + starts[text[chosen]]).tolist()
        out: list[tuple] = []
        for b, h, lo, hi, anchor, r, s in zip(bucket, is_hot, first[chosen].tolist(), end[chosen].tolist(), (place[chosen] - first[chosen]).tolist(), row, begin, strict=True):
            content = whole[lo:hi]
            if content in seen:
                own.append((r, s, s + hi - lo))
            else:
                seen.add(content)
                out.append((2 if h else 1, b, _digest(content), content, anchor, ids[r], part, r, s))
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 10_000], strict=True), _SENT, strict=True)], schema=_SENT)
    if own:
        blob = _blob(*_union(*(np.array(c) for c in zip(*own, strict=True))))
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((0, 0, None, blob, None, None, part, None, None), _SENT, strict=True)], schema=_SENT)


def _blob(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    return _dump(pa.table([pa.array(row, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], schema=_SPANS))


def _by_part(part: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """(part, spans) of spans in any order."""
    order = np.argsort(part, kind="stable")
    part, row, lo, hi = part[order], row[order], lo[order], hi[order]
    first = _starts(part)
    blobs = [_blob(*_union(row[a:b], lo[a:b], hi[a:b])) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "spans"])


# --- shards


class _Shard:
    """One shard's distinct contents, each closed by a gap, appended to a text that goes to a file of the task above ``memory`` bytes, and their places."""

    def __init__(self, bucket: int, memory: int):
        self.bucket, self.memory, self.held, self.size, self.file = bucket, memory, [], 0, None
        self.places: list[tuple[np.ndarray, ...]] = []  # null id, id, part, row, start, size

    def add(self, flat: np.ndarray, sizes: np.ndarray, *place: np.ndarray) -> None:
        text = np.full(len(flat) + len(sizes), GAP, np.uint8)
        at = np.ones(len(text), bool)
        at[np.cumsum(sizes + 1) - 1] = False
        text[at] = flat
        text += 1
        self.held.append(text)
        self.size += len(text)
        self.places.append((*place, sizes))
        if self.file is not None or self.size > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # noqa: SIM115  closed with the shard
            for x in self.held:
                self.file.write(x.data)
            self.held = []

    def spans(self, length: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(part, row, from, to) of what the contents' windows repeat."""
        if self.size == 0:
            return
        if self.file is not None:
            self.file.flush()
            text = np.memmap(self.file, np.uint8, "r", shape=self.size)
        else:
            text = np.concatenate(self.held)
        self.held = []
        null, doc, part, row, start, sizes = (np.concatenate(x) for x in zip(*self.places, strict=True))
        order = np.lexsort((row, part, doc, null))
        new = np.zeros(len(order), bool)
        for x in (null, doc, part, row):
            new[1:] |= x[order][1:] != x[order][:-1]
        document = np.empty(len(order), np.int64)
        document[order] = np.cumsum(new)
        for frag, lo, hi in _repeats(text, sizes, document, start, length, self.memory):
            yield part[frag], row[frag], start[frag] + lo, start[frag] + hi


def _sorted_shards(batches: Iterator[pa.RecordBatch], length: int, memory: int) -> Iterator[pa.RecordBatch]:
    """(part, spans) from fragments in order of shard, content and place. One shard is held at a time."""
    shard, last = None, None
    held: list[tuple[np.ndarray, ...]] = []

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        if sum(len(x[0]) for x in held) > least:
            yield _by_part(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()

    for batch in batches:
        bucket = batch.column(0).to_numpy()
        digest = text_views(batch.column(1))[0].reshape(-1, 16).view("<u8")
        flat, bounds = text_views(batch.column(2))
        null = batch.column(3).is_null().to_numpy(zero_copy_only=False)
        doc = batch.column(3).fill_null(0).to_numpy()
        part, row, start = (batch.column(k).to_numpy() for k in (4, 5, 6))
        sizes = np.diff(bounds)
        begin = _starts(bucket)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=False):
            if shard is None or shard.bucket != bucket[a]:
                if shard is not None:
                    for x in shard.spans(length):
                        held.append(x)
                        yield from flush(1 << 20)
                    release()
                shard, last = _Shard(int(bucket[a]), memory), None
            d = digest[a:b]
            new = np.append(last is None or (d[0] != last).any(), (d[1:] != d[:-1]).any(axis=1))
            last = d[-1].copy()
            later = np.flatnonzero(~new) + a
            if len(later):
                held.append((part[later], row[later].astype(np.int64), start[later], start[later] + sizes[later]))
                yield from flush(1 << 20)
            first = np.flatnonzero(new) + a
            if len(first):
                inside = np.repeat(new, sizes[a:b])
                shard.add(flat[bounds[a] : bounds[b]][inside], sizes[first], null[first], doc[first], part[first], row[first].astype(np.int64), start[first])
    if shard is not None:
        for x in shard.spans(length):
            held.append(x)
            yield from flush(1 << 20)
    yield from flush(0)


def _repeats(text: np.ndarray, sizes: np.ndarray, document: np.ndarray, start: np.ndarray, length: int, memory: int, scratch: Scratch | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(content, from, to): the spans of contents covered by windows that start earlier in another content or place.

    text: contents of ``sizes`` bytes, each with a gap behind it, one higher than their bytes. document,
    start: the first place of each content; documents are numbered in corpus order.
    """
    scratch = scratch or Scratch(memory)
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    of = scratch.array(len(text), np.int32)
    for s in scratch.pieces(len(text)):
        of[s] = np.searchsorted(ends, np.arange(s.start, s.stop), side="right")
    gone = scratch.array(len(text), bool)
    open_: tuple[int, int, int] | None = None  # document, place and position of the earliest window of a run that goes on

    for at, common in suffixes_down(text, 255, length, scratch=scratch):
        run = np.cumsum(common < length)  # 0: goes on from the batch before
        last = int(run[-1])
        content = of[at]
        offset = at - begin[content]
        whole = np.flatnonzero(offset <= sizes[content] - length)  # a whole string of the content starts here
        ends_open = None
        if len(whole):
            at, run, content, offset = at[whole], run[whole], content[whole], offset[whole]
            doc, place = document[content], start[content] + offset
            first = _starts(run)
            size = np.diff(np.append(first, len(run)))
            least = np.minimum.reduceat(doc, first)
            here = np.where(doc == np.repeat(least, size), place, np.iinfo(np.int64).max)
            kept = here == np.repeat(np.minimum.reduceat(here, first), size)
            spot = np.flatnonzero(kept)  # one for each run
            if run[0] == 0 and open_ is not None:
                if open_[:2] < (int(doc[spot[0]]), int(place[spot[0]])):
                    kept[spot[0]] = False
                else:
                    gone[open_[2]] = True
                    open_ = None
            gone[at[~kept]] = True
            if run[-1] == last:
                k = spot[-1]
                ends_open = (int(doc[k]), int(place[k]), int(at[k]))
        open_ = open_ if last == 0 and open_ is not None else ends_open
    held: tuple[int, int] | None = None
    for s in scratch.pieces(len(text)):
        hits = np.flatnonzero(gone[s]) + s.start
        if len(hits) == 0:
            continue
        new = np.append(held is None or hits[0] > held[1], hits[1:] > hits[:-1] + length)
        lo, hi = hits[new], np.append(hits[:-1][new[1:]], hits[-1]) + length
        if held is not None:
            if new[0]:
                lo, hi = np.append(held[0], lo), np.append(held[1], hi)
            else:
                lo = np.append(held[0], lo)
        held = (int(lo[-1]), int(hi[-1]))
        content = of[lo[:-1]]
        yield content, lo[:-1] - begin[content], hi[:-1] - begin[content]
    if held is not None:
        content = of[held[0] : held[0] + 1]
        yield content, held[0] - begin[content], held[1] - begin[content]


# --- hot anchors


def _hot_spans(rows: DataFrame, length: int, base: str) -> DataFrame:
    """(part, spans) of the windows of hot anchors that start earlier."""
    place = ["doc_id", "part", "row", "start"]

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for content, anchor, doc, part, row, start in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for lo, hi, core in core_classes(len(content), anchor, length):
                    out.append((_digest(content[core[0] : core[1]]) + bytes([(anchor - lo) // CLASS]), content[lo : hi - 1 + length], doc, part, row, start + lo))
            yield _windows(out)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for content, doc, part, row, start in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                out += [(_digest(content[k : k + length]), None, doc, part, row, start + k) for k in range(len(content) - length + 1)]
            yield _windows(out)

    shared = materialize(rows.select("content", "anchor", *place).mapInArrow(lean(cores), _WINDOWS), f"{base}/cores", codec="zstd")
    several = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    left = salted(shared, several, "key", "part", "row", "start").select("content", *place)
    each = materialize(left.mapInArrow(lean(windows), _WINDOWS).drop("content"), f"{base}/windows", codec="zstd")
    order = F.struct(F.col("doc_id").isNull().alias("null"), *place)
    firsts = each.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    later = salted(each, firsts, "key", "part", "row", "start").where(~((F.col("part") == F.col("first.part")) & (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part, row, start = (batch.column(k).to_numpy() for k in range(3))
                yield _by_part(part, row.astype(np.int64), start, start + length)

    return later.select("part", "row", "start").repartition("part").sortWithinPartitions("part").mapInArrow(lean(packed), "part long, spans binary")


def core_classes(size: int, anchor: int, length: int) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """(first window, end of windows, bounds of the core) of the classes of a fragment of ``size`` bytes whose anchor stands at ``anchor``.

    A window's class is its distance to the anchor divided by CLASS; the core, the bytes that all windows of
    such distances have in common, lies in each of them, so equal windows have equal cores.
    """
    windows = size - length + 1
    for k in range(max(0, anchor - windows + 1) // CLASS, anchor // CLASS + 1):
        near, far = k * CLASS, min(k * CLASS + CLASS - 1, length - ANCHOR)
        lo, hi = max(0, anchor - far), min(windows, anchor - near + 1)
        if lo < hi:
            yield lo, hi, (anchor - near, anchor - far + length)


def _windows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    columns = list(zip(*out, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _WINDOWS.split(", ")])


def _union(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted, disjoint, maximal spans of one part: rows below 2**22 (a part ends at about 2**20), places below 2**40."""
    if len(row) == 0:
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order].astype(np.int64), lo[order], hi[order]
    far = np.maximum.accumulate(row << 40 | hi)  # rows ascend, so an earlier row never reaches into a later one
    new = np.append(True, (row << 40 | lo)[1:] > far[:-1])
    first = np.flatnonzero(new)
    return row[first], lo[first], far[np.append(first[1:] - 1, len(row) - 1)] & ((1 << 40) - 1)


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def _by_row(n: int, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for r, lo, hi in zip(*(x.tolist() for x in spans), strict=True):
        out[r].append((lo, hi))
    return out


def digest_report(docs: DataFrame, *, length: int = 100, **columns: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def apply(table: pa.Table, texts: list[bytes], spans) -> pa.RecordBatch:
        ids = table.column("doc_id")
        rows = _by_row(len(texts), spans)
        gone = [sum(hi - lo for lo, hi in r) for r in rows]
        texts = [t or b"" for t in texts]
        kept = [hashlib.sha256(_kept(t, r)).hexdigest() for t, r in zip(texts, rows, strict=True)]
        return pa.RecordBatch.from_arrays([ids.combine_chunks(), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs, apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length=length, **columns)


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the bytes of characters that they cut through."""
    out = []
    for lo, hi in spans:
        while lo < hi and text[lo] & 0xC0 == 0x80:
            lo += 1
        if hi < len(text) and text[hi] & 0xC0 == 0x80:
            while hi > lo and text[hi] & 0xC0 == 0x80:
                hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def cut_texts(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from their texts; characters that a span would split stay whole, and null texts stay null."""
    place = docs.columns.index(text_col)

    def apply(table: pa.Table, texts: list[bytes], spans) -> pa.RecordBatch:
        kept = [None if t is None else _kept(t, whole_characters(t, r)).decode() for t, r in zip(texts, _by_row(len(texts), spans), strict=True)]
        columns = [pa.array(kept, pa.string()) if i == place else table.column(f"c{i}").combine_chunks() for i in range(width)]
        return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(width)])

    width = len(docs.columns)
    flat = docs.toDF(*(f"c{i}" for i in range(width)))
    return removed_spans(docs, apply, flat.schema, length=length, id_col=id_col, text_col=text_col, carry=True).toDF(*docs.columns)
