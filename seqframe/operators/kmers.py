"""k-mer windows, spectra and candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..errors import SeqValueError
from ..functions.alphabet import NUCLEOTIDES, nucleotides_only
from ..functions.buffers import places, row_blocks, views

#: Longest k-mer whose place is a number of 63 bits.
MOST_LETTERS = 31
#: Longest k-mer of whose places a task marks those that it has met, in a byte each.
_MARKED = 12
#: Rows of a batch that a kernel gives back.
_BATCH = 1 << 16
_UNKNOWN = len(NUCLEOTIDES)
_CODES = np.full(256, _UNKNOWN, np.uint8)
_CODES[np.frombuffer(NUCLEOTIDES.encode(), np.uint8)] = np.arange(_UNKNOWN)


def windows(seq: Column, k: int) -> Column:
    """Array of all k-long windows without unknown symbols, in one pass over the sequence; empty if it is shorter."""
    if k < 1:
        raise SeqValueError("k must be at least 1")
    return F.regexp_extract_all(seq, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def explode_kmers(reads: DataFrame, k: int, seq_col: str = "seq", *keep: str, strict: bool = True) -> DataFrame:
    """The k-mers of all sequences; a protein is an error or, if not strict, has none."""
    return reads.select(*keep, F.explode(windows(nucleotides_only(F.col(seq_col), strict=strict), k)).alias("kmer"))


def explode_distinct(reads: DataFrame, k: int, seq_col: str = "seq", *keep: str, strict: bool = True) -> DataFrame:
    """Each sequence's k-mers once: enough for sets of k-mers, and far fewer rows."""
    return reads.select(*keep, F.explode(F.array_distinct(windows(nucleotides_only(F.col(seq_col), strict=strict), k))).alias("kmer"))


def kmer_set(reads: DataFrame, k: int, seq_col: str = "seq", *, strict: bool = True) -> DataFrame:
    """(kmer): the distinct k-mers of all sequences. Each task makes its own distinct before the shuffle, on numbers where k allows it."""
    if k > MOST_LETTERS:
        return explode_distinct(reads, k, seq_col, strict=strict).distinct()
    return kmer_places(reads, k, seq_col, strict=strict).distinct().select(kmer_text(F.col("place"), k).alias("kmer"))


def kmer_places(reads: DataFrame, k: int, seq_col: str = "seq", *, strict: bool = True) -> DataFrame:
    """(place): the places of all k-mers, in each task at most once for small k and once a block of sequences for others. A protein is an error or, if not strict, has none."""
    if not 1 <= k <= MOST_LETTERS:
        raise SeqValueError(f"k must lie between 1 and {MOST_LETTERS}")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            flat, bounds = views(batch.column(0))
            for lo, hi in row_blocks(bounds):
                yield window_places(flat[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], k)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = blocks(batches)
        if k <= _MARKED:
            seen = np.zeros(4**k, bool)
            for place in each:
                seen[place] = True
            each = iter([np.flatnonzero(seen)])
        for place in each:
            place = np.unique(place)
            for at in range(0, len(place), _BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(place[at : at + _BATCH])], names=["place"])

    return reads.select(nucleotides_only(F.col(seq_col), strict=strict).alias("seq")).mapInArrow(run, "place long")


def kmer_id(kmer: Column) -> Column:
    """Place of a k-mer in the dense spectrum: its letters as base-4 digits."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def kmer_text(place: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(place.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def spectrum(reads: DataFrame, k: int, seq_col: str = "seq", *, strict: bool = True) -> DataFrame:
    """(kmer, kmer_id, n) of the k-mers that occur; counts are summed in each task before the shuffle. A protein is an error or, if not strict, is left out."""
    counts = explode_kmers(reads, k, seq_col, strict=strict).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("kmer", kmer_id(F.col("kmer")).alias("kmer_id"), "n")


def dense_spectrum(reads: DataFrame, k: int, seq_col: str = "seq") -> DataFrame:
    """All 4**k k-mers with their counts, zeros included."""
    every = reads.sparkSession.range(4**k).select(F.col("id").alias("kmer_id"), kmer_text(F.col("id"), k).alias("kmer"))
    return every.join(spectrum(reads, k, seq_col).select("kmer_id", "n"), "kmer_id", "left").select("kmer", "kmer_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def merge_spectra(*spectra: DataFrame) -> DataFrame:
    """The spectrum of several batches together."""
    total = spectra[0]
    for s in spectra[1:]:
        total = total.unionByName(s)
    return total.groupBy("kmer", "kmer_id").agg(F.sum("n").alias("n"))


def window_places(flat: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start in ``flat``, place) of all k-long windows without unknown symbols, of rows with such bounds; none crosses rows."""
    n = len(flat) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = _CODES[flat]
    place, wrong = np.zeros(n, np.uint32 if k <= 16 else np.int64), np.zeros(n, bool)
    for j in range(k):
        part = code[j : j + n]
        place <<= 2
        place |= part & 3
        wrong |= part == _UNKNOWN
    first = np.maximum(bounds[1:-1] - k + 1, 0)
    crossing = places(first, bounds[1:-1] - first)
    wrong[crossing[crossing < n]] = True
    start = np.flatnonzero(~wrong)
    return start, place[start].astype(np.int64)


def distinct_places(flat: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each row's k-mers, once each."""
    start, place = window_places(flat, bounds, k)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[start]
    if 2 * k + len(bounds).bit_length() <= 63:
        both = np.unique(row << 2 * k | place)
        return both >> 2 * k, both & (1 << 2 * k) - 1
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    return row[new], place[new]


def _seeds(reads: DataFrame, k: int, key: str, seq: str, name: str) -> DataFrame:
    """(name, kmer): each sequence's k-mers once, as places where k allows it."""
    pairs = reads.select(F.col(key).alias(name), F.col(seq).alias("seq"))
    if k > MOST_LETTERS:
        return pairs.select(name, F.explode(F.array_distinct(windows(F.col("seq"), k))).alias("kmer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = views(batch.column(1))
            for lo, hi in row_blocks(bounds):
                row, place = distinct_places(flat[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], k)
                for at in range(0, len(row), _BATCH):
                    part = slice(at, at + _BATCH)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part] + lo)), pa.array(place[part])], names=[name, "kmer"])

    return pairs.mapInArrow(run, StructType([StructField(name, pairs.schema[name].dataType), StructField("kmer", LongType())]))


def seed_candidates(left: DataFrame, right: DataFrame, k: int, *, id_left: str, id_right: str, seq_left: str = "seq", seq_right: str = "seq", least: int = 1, salts: int = 16, frequent: int = 1000) -> DataFrame:
    """(id_left, id_right, shared): pairs with at least ``least`` distinct k-mers in common, to be aligned in full.

    The left rows of a k-mer with over ``frequent`` of them are dealt over ``salts`` parts, so it is not one task's; its
    right rows alone are repeated. Both sides are shuffled whatever Spark takes their size for: it does not know
    how many k-mers a sequence has.
    """
    if k < 1:
        raise SeqValueError("k must be at least 1")
    a, b = _seeds(left, k, id_left, seq_left, "__a"), _seeds(right, k, id_right, seq_right, "__b")
    often = F.broadcast(a.groupBy("kmer").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > frequent).select("kmer", F.lit(True).alias("__often")))  # a thousandth of the rows at most
    a = a.join(often, "kmer", "left").select("__a", "kmer", F.when(F.col("__often"), F.pmod(F.xxhash64("__a"), F.lit(salts)).cast("int")).otherwise(0).alias("__s"))
    b = b.join(often, "kmer", "left").select("__b", "kmer", F.explode(F.when(F.col("__often"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("__s"))
    pairs = a.hint("shuffle_merge").join(b, ["kmer", "__s"]).groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.where(F.col("shared") >= least).select(F.col("__a").alias(id_left), F.col("__b").alias(id_right), "shared")
