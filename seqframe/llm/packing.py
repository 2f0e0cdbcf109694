"""Packing by power-of-two decomposition.

A document's token ids, closed by an end id, are cut into pieces whose lengths are powers of two:
as many full sequences as fit, then the binary digits of the rest, largest first. Pieces of one
length share a bucket and each is a sequence of its own, so no sequence crosses documents and none
is padded. Sequences are numbered bucket by bucket, from short to long, and within a bucket by hashed chunks
of documents and starts: gapless, and independent of how rows are partitioned.

Edge cases: null and empty texts have the end id alone, one piece of length 1; repeated rows are
packed once each; an empty table gives an empty result; extra columns are ignored; a text of any
length is cut as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoders
from .common import blocks, dense_numbers, lean, materialize, pick, work_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def binary_pieces(n: int, most: int = 1024) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; ``most`` is a power of two."""
    out = [(at, most) for at in range(0, n - most + 1, most)]
    at = n - n % most
    while at < n:
        length = 1 << ((n - at).bit_length() - 1)
        out.append((at, length))
        at += length
    return out


def cut_documents(docs: DataFrame, tokenizer: str, *, most: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece, without sequence numbers; with its ids on request."""
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                out: list[list] = [[], [], [], [], [], []]
                pieces_ids = []
                for doc, ids in zip(block.column(0).to_pylist(), encoders.encode(tokenizer, block.column(1).to_pylist()), strict=True):
                    raw = np.array([*ids, end_id], dtype="<u4")
                    whole = raw.tobytes()
                    for start, length in binary_pieces(len(raw), most):
                        row = (doc, start, length, zlib.crc32(whole[4 * start : 4 * (start + length)]), len(raw), length.bit_length() - 1)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        if with_ids:
                            pieces_ids.append(raw[start : start + length].tolist())
                arrays = [pa.array(x, pa.int64()) for x in out[:5]] + [pa.array(out[5], pa.int32())]
                if with_ids:
                    arrays.append(pa.array(pieces_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"] + ["ids"] * with_ids)

    return rows.mapInArrow(lean(cut), PIECES + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, *, most: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, chunks: int = 1024) -> DataFrame:
    """One row per piece with its sequence_id (gapless from 0; buckets in order of length) and offset (0: a piece fills its sequence).

    The pieces are written to the shared folder once, as numbering reads them twice.
    """
    spark = docs.sparkSession
    pieces = cut_documents(docs, tokenizer, most=most, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    pieces = materialize(pieces, work_path(spark, "pieces"))
    sizes = {b: 0 for b in range(most.bit_length())}
    sizes |= {r["bucket"]: r["count"] for r in pieces.groupBy("bucket").count().collect()}  # one row per power of two
    below = F.lit(0)
    total = 0
    for b, n in sorted(sizes.items()):
        below = F.when(F.col("bucket") == b, F.lit(total)).otherwise(below)
        total += n
    numbered = dense_numbers(pieces, "__in_bucket", ["bucket"], ["doc_id", "start"], ["doc_id", "start", "ids_crc32", "doc_tokens"], chunks)
    extra = ["ids"] if with_ids else []
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (below + F.col("__in_bucket")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *extra)
