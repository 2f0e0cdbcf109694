"""Block gzip: small independent gzip members that any gzip reader understands and that can be read in parallel."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

from ..errors import SeqIOError, SeqValueError

#: Fixed values of the format: data bytes of a block, the header of a member up to the block size, and the empty last block.
BLOCK_DATA = 65_280
_HEADER = bytes([31, 139, 8, 4, 0, 0, 0, 0, 0, 255, 6, 0, 66, 67, 2, 0])
END = bytes([31, 139, 8, 4, 0, 0, 0, 0, 0, 255, 6, 0, 66, 67, 2, 0, 27, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])


def _block(data: bytes, level: int) -> bytes:
    for strength in (level, 0):  # what does not shrink is stored
        packer = zlib.compressobj(strength, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        if len(body) + 26 <= 65_536:
            return _HEADER + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
    raise SeqIOError("a block does not fit")


def compress_bytes(data: bytes, level: int = 6, *, end: bool = True) -> bytes:
    """The bytes as block gzip. Levels run from 1 to 12; those above 9 compress as 9."""
    if not 1 <= level <= 12:
        raise SeqValueError("level must lie between 1 and 12")
    blocks = [_block(data[i : i + BLOCK_DATA], min(level, 9)) for i in range(0, len(data), BLOCK_DATA)]
    return b"".join([*blocks, END if end else b""])


def compress_file(path: str, out: str | None = None, level: int = 6) -> str:
    """Writes a file's block gzip (by default beside it as .gz); never over its own input. Memory stays at one block."""
    out = out or f"{path}.gz"
    if os.path.realpath(out) == os.path.realpath(path):
        raise SeqValueError("the output would overwrite the input")
    if not 1 <= level <= 12:
        raise SeqValueError("level must lie between 1 and 12")
    try:
        with open(path, "rb") as source, open(out, "wb") as sink:
            while data := source.read(BLOCK_DATA):
                sink.write(_block(data, min(level, 9)))
            sink.write(END)
    except FileNotFoundError as e:
        raise SeqIOError(str(e)) from e
    return out


def is_block_gzip(head: bytes) -> bool:
    return len(head) >= 18 and head[:4] == _HEADER[:4] and head[12:16] == b"BC\x02\x00"


def block_sizes(f) -> Iterator[tuple[int, int]]:
    """(offset, size) of each member, read from the headers alone."""
    at = 0
    while True:
        f.seek(at)
        head = f.read(18)
        if not head:
            return
        if not is_block_gzip(head):
            raise SeqIOError(f"no block header at byte {at}")
        size = struct.unpack("<H", head[16:18])[0] + 1
        yield at, size
        at += size


def inflate(raw: bytes) -> bytes:
    """All gzip members of some bytes."""
    out = []
    while raw:
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw) + member.flush())
        raw = member.unused_data
    return b"".join(out)


def write_block_gzip(lines, folder: str, level: int = 6) -> list[str]:
    """Writes a DataFrame's first column, a line per row, as one block gzip file per partition; their names.

    Each task writes under a name of its own and renames it, so repeated tasks do no harm; files that an
    earlier run left in the folder go.
    """
    import pyarrow as pa

    def run(batches):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
        system.create_dir(root, recursive=True)
        part, final = f"{root}/_writing-{uuid.uuid4().hex}", f"{root}/part-{TaskContext.get().partitionId():05d}.gz"
        with system.open_output_stream(part, compression=None) as sink:
            held = b""
            for batch in batches:
                held += "".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode()
                whole = len(held) - len(held) % BLOCK_DATA
                sink.write(compress_bytes(held[:whole], level, end=False))
                held = held[whole:]
            sink.write(compress_bytes(held, level))
        system.move(part, final)
        yield pa.RecordBatch.from_arrays([pa.array([final])], names=["name"])

    written = sorted(r["name"] for r in lines.mapInArrow(run, "name string").collect())  # one name per partition
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
    for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if old.is_file and old.path not in written and (old.base_name.startswith("_writing-") or (old.base_name.startswith("part-") and old.base_name.endswith(".gz"))):
            system.delete_file(old.path)
    return written
