"""A Spark data source for FASTQ: spark.read.format("fastq").load(path).

The driver lists files and deals byte ranges; a task finds out what its file is and where its range begins.
In plain files that is the first record, where a line starts with '@' and the line two below with '+'; in
block gzip it is the first block, and then the same rule; other gzip files are read whole by the task of
their first range. Lines of regular records are taken as columns from the buffer; from the first irregular
record on a range is read line by line. Files are reached through Arrow's file systems (local paths, file://,
hdfs://, s3://, gs://, abfs://). Rows: read_id (the record's byte offset in the uncompressed file, or in
block gzip the block's offset and the place in it), file, header, n_symbols, seq, qual, malformed.

Qualities are kept as Phred+33 text of the sequence's length: short ones are padded with '!', long ones
cut, and the row is marked as malformed. Records without symbols and blank lines before a header are
left out. Sequences are read as nucleotides. Options: splitBytes, format (fastq or auto: a file that
begins with '>' is then an error that names the right reader).
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import SeqIOError
from ..functions.buffers import column_of
from .bgzf import inflate, is_block_gzip

SCHEMA = "read_id long, file string, header string, n_symbols int, seq string, qual string, malformed boolean"
_ARROW = pa.schema([("read_id", pa.int64()), ("file", pa.string()), ("header", pa.string()), ("n_symbols", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("malformed", pa.bool_())])
_BATCH = 8192
#: Uncompressed bytes that a task takes at once.
CHUNK = 4 << 20
_CANONICAL = bytes(ord("N") for _ in range(256))
for _from, _to in zip(b"ACGTacgtUu-.", b"ACGTACGTTT--", strict=True):
    _CANONICAL = _CANONICAL[:_from] + bytes([_to]) + _CANONICAL[_from + 1 :]
_SCORES = bytes(min(max(i, 33), 126) for i in range(256))
_CANONICAL_TABLE, _SCORES_TABLE = (np.frombuffer(x, np.uint8) for x in (_CANONICAL, _SCORES))


def _system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    import os

    return fs.LocalFileSystem(), os.path.abspath(path)


def list_files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, root = _system(path)
    if any(c in root for c in "*?["):
        import fnmatch

        top = root[: min(root.index(c) for c in "*?[" if c in root)].rsplit("/", 1)[0] or "/"
        found = [x for x in system.get_file_info(fs.FileSelector(top, recursive=True)) if x.is_file and fnmatch.fnmatch(x.path, root)]
    else:
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise SeqIOError(f"no such file: {path}")
        found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(root)) if x.is_file and not x.base_name.startswith(("_", "."))]
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((prefix + x.path if prefix else x.path, x.size) for x in found)


def local_path(name: str) -> str:
    """The path of a file of this machine, for tools that open files themselves."""
    return re.sub("^file:(//)?", "", name)


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


def plan(path: str, split: int) -> list[Range]:
    """Byte ranges of all files; none is opened."""
    return [Range(name, at, min(at + split, size)) for name, size in list_files(path) for at in range(0, size, split)]


class _Lines:
    """Lines with their places, from a source of chunks."""

    def __init__(self, chunks: Iterator[bytes], at: int):
        self.chunks, self.at, self.buffer, self.used, self.done = chunks, at, b"", 0, False

    def next(self) -> tuple[int, bytes] | None:
        while (end := self.buffer.find(b"\n", self.used)) < 0:
            chunk = next(self.chunks, None)
            if chunk is None:
                if self.used >= len(self.buffer):
                    return None
                end = len(self.buffer)
                break
            self.buffer = self.buffer[self.used :] + chunk
            self.used = 0
        line = self.buffer[self.used : end]
        place = self.at
        self.at += end + 1 - self.used
        self.used = end + 1
        return place, line.rstrip(b"\r")


class _Plain:
    """Bytes of a plain file from a place on. ``limit``: where the range's records end, as far as it is known."""

    def __init__(self, f, start: int, stop: int):
        self.f, self.begin, self.limit = f, max(start - 1, 0), stop  # with the byte before, a range that begins at a line keeps that line
        f.seek(self.begin)

    def read(self) -> bytes:
        return self.f.read(CHUNK)

    def place(self, at: np.ndarray) -> np.ndarray:
        return at


class _Gzip:
    """All bytes of a gzip file, in any number of members."""

    begin, limit = 0, None

    def __init__(self, f):
        f.seek(0)
        self.f, self.member, self.rest = f, zlib.decompressobj(31), b""

    def read(self) -> bytes:
        while True:
            raw = self.rest or self.f.read(1 << 20)
            if not raw:
                return b""
            out = self.member.decompress(raw, CHUNK)
            self.rest = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            if out:
                return out

    def place(self, at: np.ndarray) -> np.ndarray:
        return at


class _Blocks:
    """The data of block gzip from a block on. Places are (block offset << 16) + place in the block."""

    begin = 0

    def __init__(self, f, size: int, start: int, stop: int):
        self.f, self.size, self.at, self.stop, self.limit = f, size, start, stop, None
        self.starts: list[tuple[int, int]] = []  # uncompressed place, block offset
        self.done, self.first = 0, _last_byte(f, start) if start else b""  # one line end in front, as if the byte before ended a line or not

    def read(self) -> bytes:
        out, n = [self.first] if self.first else [], 0
        self.done += len(self.first)
        self.first = b""
        while self.at < self.size and n < CHUNK:
            self.f.seek(self.at)
            head = self.f.read(18)
            if not is_block_gzip(head):
                raise SeqIOError(f"no block header at byte {self.at}")
            size = struct.unpack("<H", head[16:18])[0] + 1
            if self.limit is None and self.at >= self.stop:
                self.limit = self.done
            data = inflate(head + self.f.read(size - 18))
            self.starts.append((self.done, self.at))
            self.done, self.at, n = self.done + len(data), self.at + size, n + len(data)
            out.append(data)
        if self.at >= self.size and self.limit is None:
            self.limit = self.done
        return b"".join(out)

    def place(self, at: np.ndarray) -> np.ndarray:
        begins, blocks = (np.array(x, np.int64) for x in zip(*self.starts, strict=True))
        k = np.searchsorted(begins, at, side="right") - 1
        return blocks[k] << 16 | at - begins[k]


def _first_block(f, size: int, start: int) -> int:
    """The offset of the first block at or behind ``start``: a header whose block inflates and ends at another header or the end of the file."""
    if start == 0:
        return 0
    at, window = start, 1 << 17
    while at < size:
        f.seek(at)
        raw = f.read(window + 18)
        for hit in re.finditer(rb"\x1f\x8b\x08\x04", raw[: window + 3]):
            head = raw[hit.start() : hit.start() + 18]
            if is_block_gzip(head):
                begin, end = at + hit.start(), at + hit.start() + struct.unpack("<H", head[16:18])[0] + 1
                f.seek(begin)
                block = f.read(end - begin + 18)
                if end == size or is_block_gzip(block[end - begin :]):
                    try:
                        inflate(block[: end - begin])
                    except zlib.error:
                        continue
                    return begin
        at += window
    return size


def _records(lines: _Lines) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(place, header, sequence, quality) of all records; what is no header where one should be is passed over."""
    while (first := lines.next()) is not None:
        place, header = first
        if not header.startswith(b"@"):
            continue
        seq, plus, qual = lines.next(), lines.next(), lines.next()
        if seq is None:
            return
        del plus
        yield place, header[1:].strip(), seq[1].strip(), qual[1].strip() if qual else b""


def _source(f, part: Range):
    """What a range reads from; None where another range has its records."""
    f.seek(0)
    head = f.read(18)
    if head[:1] == b">":
        raise SeqIOError(f"{part.file} looks like FASTA: use read_fasta")
    if is_block_gzip(head):
        f.seek(0, 2)
        size = f.tell()
        begin = _first_block(f, size, part.start)
        return _Blocks(f, size, begin, part.stop) if begin < part.stop else None
    if head[:2] == b"\x1f\x8b":
        return _Gzip(f) if part.start == 0 else None
    return _Plain(f, part.start, part.stop)


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    system, file = _system(part.file)
    with system.open_input_file(file) as f:
        source = _source(f, part)
        if source is not None:
            yield from _batches(source, part.file, part.start > 0)


def _batches(source, file: str, synchronise: bool) -> Iterator[pa.RecordBatch]:
    buffer, base, ended = b"", source.begin, False
    while True:
        chunk = source.read()
        ended = not chunk
        buffer += chunk
        if ended and buffer and not buffer.endswith(b"\n"):
            buffer += b"\n"
        data = np.frombuffer(buffer, np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        if synchronise:
            heads = np.flatnonzero((data[starts[1:-2]] == ord("@")) & (data[starts[3:]] == ord("+"))) if len(starts) > 3 else starts[:0]
            if len(heads) == 0:
                if ended:
                    return
                continue
            first = int(starts[1 + heads[0]])
            buffer, base, synchronise = buffer[first:], base + first, False
            data, starts, ends = data[first:], starts[1 + heads[0] :] - first, ends[1 + heads[0] :] - first
        n = len(ends) // 4 * 4
        if n:
            regular = (data[starts[0:n:4]] == ord("@")) & (data[starts[2:n:4]] == ord("+")) & (ends[0:n:4] > starts[0:n:4] + 1)
            if not regular.all():
                yield from _slowly(source, file, buffer, base)
                return
            yield from _columns(source, file, buffer, base, starts[:n], ends[:n])
            done = int(ends[n - 1]) + 1
            buffer, base = buffer[done:], base + done
        if source.limit is not None and base >= source.limit:
            return
        if ended:
            if buffer.strip():
                yield from _slowly(source, file, buffer, base)
            return


def _columns(source, file: str, buffer: bytes, base: int, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch of regular records from the bounds of their lines."""
    if source.limit is not None:
        n = 4 * int(np.searchsorted(starts[::4] + base, source.limit))
        starts, ends = starts[:n], ends[:n]
    if len(starts) == 0:
        return
    lines = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, ends[-1] + 1).astype(np.int64)), pa.py_buffer(buffer))
    header, seq, qual = (pc.ascii_trim_whitespace(lines.take(pa.array(np.arange(k, len(starts), 4)))) for k in (0, 1, 3))
    some = pc.greater(pc.binary_length(seq), 0)
    place = pa.array(source.place(starts[::4] + base), pa.int64())
    if not pc.all(some).as_py():
        header, seq, qual, place = (x.filter(some) for x in (header, seq, qual, place))
    if len(seq) == 0:
        return
    size = pc.binary_length(header).to_numpy()
    keep = np.ones(int(size.sum()), bool)
    keep[np.cumsum(size) - size] = False  # the mark in front
    bounds = np.append(0, np.cumsum(size - 1)).astype(np.int64)
    header = pc.ascii_trim_whitespace(pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(_bytes_of(header)[keep])))
    try:
        header.validate(full=True)
    except pa.ArrowInvalid:
        header = pa.array([x.decode("utf-8", "replace") for x in header.view(pa.large_binary()).to_pylist()], pa.large_string())
    n, m = (pc.binary_length(x).to_numpy() for x in (seq, qual))
    wrong = n != m
    if wrong.any():
        qual = pa.array([(q or b"")[:k].ljust(k, b"!") for q, k in zip(qual.view(pa.large_binary()).to_pylist(), n.tolist(), strict=True)], pa.large_binary())
    seq, qual = (column_of(table[_bytes_of(x)], n, None, pa.string()) for table, x in ((_CANONICAL_TABLE, seq), (_SCORES_TABLE, qual)))
    rows = len(n)
    for at in range(0, rows, _BATCH):
        size = min(_BATCH, rows - at)
        columns = [place, pa.repeat(pa.scalar(file), rows), header.cast(pa.string()), pa.array(n, pa.int32()), seq, qual, pa.array(wrong)]
        yield pa.RecordBatch.from_arrays([c.slice(at, size) for c in columns], schema=_ARROW)


def _bytes_of(column: pa.Array) -> np.ndarray:
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(bounds) > 1 else np.zeros(0, np.uint8)


def _slowly(source, file: str, buffer: bytes, base: int) -> Iterator[pa.RecordBatch]:
    """The records from a place on, a line at a time."""
    lines = _Lines(itertools.chain([buffer], iter(source.read, b"")), base)
    rows: list[list] = [[] for _ in _ARROW]
    for place, header, seq, qual in _records(lines):
        if source.limit is not None and place >= source.limit:
            break
        if not seq:
            continue
        n = len(seq)
        qual_text = qual.translate(_SCORES)[:n].ljust(n, b"!")
        known = int(source.place(np.array([place]))[0])
        for column, value in zip(rows, (known, file, header.decode("utf-8", "replace"), n, seq.translate(_CANONICAL).decode(), qual_text.decode(), len(qual) != n), strict=True):
            column.append(value)
        if len(rows[0]) >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(rows, _ARROW, strict=True)], schema=_ARROW)
            rows = [[] for _ in _ARROW]
    if rows[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(rows, _ARROW, strict=True)], schema=_ARROW)


def _last_byte(f, before: int) -> bytes:
    """The last uncompressed byte in front of a block; blocks are found backwards by their header."""
    low = max(0, before - (1 << 17))
    f.seek(low)
    raw = f.read(before - low)
    at = len(raw)
    while at >= 0:
        at = raw.rfind(b"\x1f\x8b\x08\x04", 0, at)
        if at < 0:
            return b"\n"
        if is_block_gzip(raw[at : at + 18]):
            size = struct.unpack("<H", raw[at + 16 : at + 18])[0] + 1
            if at + size == len(raw):
                data = inflate(raw[at:])
                if data:
                    return data[-1:]
                return b"\n"
    return b"\n"


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options.get("path"), int(options.get("splitBytes", 32 << 20))

    def partitions(self):
        return plan(self.path, self.split) or [Range("", 0, 0)]

    def read(self, partition):
        return read_range(partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    """New files of a folder, whatever their names and times: an offset is the list of the files that lay there.

    What was read may be moved away, which keeps the list short; a file should land whole, by a rename.
    """

    def __init__(self, options):
        self.path, self.split = options.get("path"), int(options.get("splitBytes", 32 << 20))

    def initialOffset(self):
        return {"files": []}

    def latestOffset(self):
        return {"files": [name for name, _ in list_files(self.path)]}

    def partitions(self, start, end):
        return [x for name in sorted(set(end["files"]) - set(start["files"])) for x in plan(name, self.split)]

    def read(self, partition):
        return read_range(partition)

    def commit(self, end):
        pass


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = 32 << 20):
    register(spark)
    return spark.read.format("fastq").option("splitBytes", split_bytes).load(path)


def fastq_text(header, seq, qual):
    """A record as FASTQ text."""
    from pyspark.sql import functions as F

    return F.concat(F.lit("@"), header, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def write_fastq(reads, path: str, compression: str | None = None) -> None:
    from pyspark.sql import functions as F

    writer = reads.select(fastq_text(F.col("header"), F.col("seq"), F.col("qual")).alias("value")).write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def sniff(path: str) -> str:
    """'fasta' or 'fastq', by the first byte that is not blank, of the first file that has one; FASTA where neither mark is found.

    Spark writes files without rows, too: such tell nothing of the others.
    """
    for name, size in list_files(path):
        if not size:
            continue
        system, file = _system(name)
        with system.open_input_stream(file, compression="gzip" if file.endswith(".gz") else None) as f:
            while head := f.read(4096):
                if head := head.lstrip():
                    return "fastq" if head[:1] == b"@" else "fasta"
    return "fasta"


def read_any(spark: SparkSession, path: str):
    """Reads either format, as sniffed."""
    from .fasta import read_fasta

    return read_fastq(spark, path) if sniff(path) == "fastq" else read_fasta(spark, path)
