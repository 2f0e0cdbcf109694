"""What the corpus operators share: shared storage, column picking, row numbering and word hashing.

Nothing here keeps data on the driver; work tables go to the folder that all executors share.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64


# --- shared storage -------------------------------------------------------------------------


#: Work folders that this session's operators have made and not removed yet.
made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; a folder of our own only where that is unset and all executors are threads of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("seqframe.own.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the executors of a cluster need a folder that all of them reach")
        found = tempfile.mkdtemp(prefix="seqframe-")
        spark.conf.set("seqframe.own.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/seqframe-{name}-{uuid.uuid4().hex}"
    made.append(path)
    return path


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Removes the work folders made since ``since`` (a length of ``made``). DataFrames that read them are of no use afterwards."""
    while len(made) > since:
        remove(spark, made.pop())


def materialize(df: DataFrame, path: str, shrink: int = 1, codec: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps do not recompute it and lost executors cost nothing.

    shrink: narrow results of a shuffle go into so many times fewer files than there are shuffle partitions.
    """
    if shrink > 1:
        df = df.coalesce(max(1, shuffle_partitions(df.sparkSession) // shrink))
    writer = df.write.mode("overwrite")
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes work folders through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (one column; nulls match null ids).

    The ids are stored first: so Spark knows their size before it plans the join, and broadcasts them below
    its threshold instead of moving all texts; above it, both sides are shuffled.
    """
    ids = gone.toDF("__gone").select(F.col("__gone").cast("long").alias("__gone")).distinct()
    ids = materialize(ids, work_path(docs.sparkSession, "gone"), 16)
    return docs.join(ids, docs[id_col].cast("long").eqNullSafe(F.col("__gone")), "left_anti")


#: The column that ``keyed`` adds.
ROW = "__row"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs``, stored once, with a column ``ROW``: a number of each row's own, whatever its id; null and repeated ids tell no rows apart."""
    names = docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn(ROW, F.monotonically_increasing_id())
    return materialize(flat, work_path(docs.sparkSession, "rows"), codec="zstd").toDF(*names, ROW)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan's size; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# --- columns --------------------------------------------------------------------------------


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by exact name and position, renamed (new=old). Extra columns, also ones that differ in case only, are left out."""
    names = df.columns
    flat = df.toDF(*(f"__c{i}" for i in range(len(names))))
    return flat.select(*(F.col(f"__c{names.index(old)}").alias(new) for new, old in wanted.items()))


def dense_numbers(df: DataFrame, name: str, within: list[str], key: list[str], order: list[str], chunks: int) -> DataFrame:
    """Adds a long ``name``: gapless numbers from 0 within each value of ``within`` (never null).

    Rows fall into ``chunks`` hashed chunks per group, which are numbered on their own; the chunk
    sizes (at most groups x chunks rows, whatever the input) give the offsets. No group meets in
    one task, and the numbers do not depend on how rows are partitioned as long as ``order`` is total.
    """
    marked = df.withColumn("__chunk", F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int"))
    sizes = marked.groupBy(*within, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*within, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    ranked = marked.withColumn("__rank", F.row_number().over(Window.partitionBy(*within, "__chunk").orderBy(*order)))
    out = ranked.join(F.broadcast(firsts), [*within, "__chunk"])
    return out.withColumn(name, (F.col("__first") + F.col("__rank") - 1).cast("long")).drop("__chunk", "__first", "__rank")


def salted(rows: DataFrame, one: DataFrame, key: str, *spread: str, how: str = "inner") -> DataFrame:
    """Joins ``one`` (a row per ``key``) to ``rows`` on ``key``, wherever one value of it may hold a large share of the rows.

    A key's rows are dealt by the hash of ``spread`` over as many parts as there are shuffle partitions;
    its rows of ``one`` are repeated for the parts that occur, so once where the key is rare. ``rows`` is
    read twice and must be the same both times.
    """
    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    occur = dealt.select(key, "__salt").distinct().groupBy(key).agg(F.collect_list("__salt").alias("__salts"))
    repeated = one.join(occur, key).withColumn("__salt", F.explode("__salts")).drop("__salts")
    return dealt.join(repeated, [key, "__salt"], how).drop("__salt")


# --- Arrow text -----------------------------------------------------------------------------


def text_views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the rows' offsets in it. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows with about ``most`` bytes of text, to bound memory."""
    if batch.num_rows == 0:
        return
    at = batch.schema.get_field_index(column)
    _, bounds = text_views(batch.column(at))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def lean(run):
    """An Arrow function that releases memory when its partition is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


# --- words ----------------------------------------------------------------------------------

#: The bytes that part words, 0x20 and 0x09 to 0x0D.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), in place where it can be."""
    x = x ^ (x >> U64(31))
    x *= U64(0x9FB21C651E98DF25)
    x ^= x >> U64(28)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_seed = np.random.default_rng(20240229)
BYTE_KEYS = _seed.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
PLACE_KEYS = _seed.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
SHINGLE_KEYS = _seed.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def word_table(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words of the rows; no word crosses a row's bounds."""
    n = len(flat)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    inside = ~SEPARATORS[flat]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(starts) == 0:
        return starts, ends, np.zeros(0, np.uint64)
    begun = np.zeros(n, np.int64)
    begun[starts] = starts
    place = np.arange(n) - np.maximum.accumulate(begun)
    place[~inside] = 0
    value = BYTE_KEYS[flat] * PLACE_KEYS[place & 63]
    if len(far := np.flatnonzero(place >= 64)):
        value[far] = mix(value[far] + mix((place[far] >> 6).astype(np.uint64)))
    value[~inside] = 0
    return starts, ends, mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter; none without words."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    many = len(words) - width + 1
    total = np.full(many, U64(width))
    for i in range(width):
        total += words[i : i + many] * SHINGLE_KEYS[i % 64] + U64(i)
    return mix(total)
