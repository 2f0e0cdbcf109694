"""Token counts through a digest cache.

A text's key is the SHA-256 digest of its content, joined with the digest of the tokenizer's file.
Counts that the cache already has are joined; only distinct misses are encoded, and their counts
are appended to the cache as Parquet files in the shared folder.

The normal form of a text is the text itself, with null read as empty: any further folding (case,
Unicode forms) could change what the tokenizer counts.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each get a result; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import encoders
from .common import blocks, lean, pick, salted, work_path

_CACHE = T.StructType([T.StructField("version", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_cache(spark, path: str) -> DataFrame:
    """(version, digest, n_tokens); empty where nothing is stored yet. Concurrent appends may repeat a key, with equal counts."""
    stored = spark.read.schema(_CACHE).parquet(path) if _exists(spark, path) else spark.createDataFrame([], _CACHE)
    return stored


def count_tokens(docs: DataFrame, tokenizer: str, *, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). ``cache``: a Parquet folder that outlives the call."""
    spark = docs.sparkSession
    cache = cache or work_path(spark, "token-cache")
    version = encoders.tokenizer_version(tokenizer)
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    keyed = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest"))

    # One document stands for each digest that the cache lacks. Its text is fetched by a hash join that
    # builds on the narrow side, so no texts are sorted; hot groups shrink to one row before any shuffle of texts.
    known = read_cache(spark, cache).where(F.col("version") == version).select("digest")
    groups = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    standing = groups.join(known, "digest", "left_anti")
    wanted = standing.select(F.col("doc_id").alias("s_id"), F.col("digest").alias("s_digest")).hint("shuffle_hash")
    misses = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("s_id")) & (digest == F.col("s_digest")), "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for block in blocks(batch, "text"):
                distinct = list(dict.fromkeys(block.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([version] * len(distinct), pa.string()),
                        pa.array([hashlib.sha256(x.encode()).digest() for x in distinct], pa.binary()),
                        pa.array([len(x) for x in encoders.encode(tokenizer, distinct)], pa.int64()),
                    ],
                    names=["version", "digest", "n_tokens"],
                )

    misses.select("text").mapInArrow(lean(encode), _CACHE).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    # a digest that a large share of the documents has is dealt over all tasks
    joined = salted(keyed, counts, "digest", "doc_id")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
