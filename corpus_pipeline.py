"""From raw documents to packed sequences, in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm import decontaminate, minhash, packing, quality, suffix_dedup
from seqframe.llm.common import ROW, keyed, made, materialize, remove, sweep, without, work_path

#: Some stages have no SQL form; tests/llm compares each stage and the whole with brute force.
ORACLE_SQL = None


LAST = "packed_sequences"
#: Work folders of the stage that was called last.
_left: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage first removes what the stage before it has stored: its result lies in Parquet by then, as the next one's input.

    What the last stage has stored stays, as nothing says when its result has been read.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, *_left)
        before = len(made)
        out = f(spark, docs, sf_dir)
        _left[:] = [] if f.__name__ == LAST else made[before:]
        return out

    return run


# Every stage but the last returns all columns of its input, by place: names that differ in case only, or
# that an operator uses itself, do no harm. Rows are told apart by a key of their own, so repeated rows and
# rows of a repeated or null doc_id are judged one by one. An empty table gives an empty one, and texts of
# any length are taken whole.


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go.

    Null, empty and blank texts go, as do all of fewer than 20 words; repeated rows stay or go together.
    """
    rows = keyed(docs)
    return without(rows, ROW, quality.quality(rows, id_col=ROW).where(~F.col("kept")).select("doc_id")).drop(ROW)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: that of the smallest doc_id, null ids last.

    Null texts and texts without words link with nothing and stay; of repeated rows one stays.
    """
    return minhash.deduplicate(docs, width=5, threshold=(80, 100))


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that start earlier in the corpus are cut from the texts, and n_chars is counted anew.

    All rows stay. Null texts stay null, with their n_chars; of repeated rows the first keeps its text.
    """
    cut = suffix_dedup.cut_texts(docs, length=100)
    names = cut.columns
    flat = cut.toDF(*(f"c{i}" for i in range(len(names))))
    if "n_chars" in names:
        text, n = (F.col(f"c{names.index(x)}") for x in ("text", "n_chars"))
        flat = flat.withColumn(f"c{names.index('n_chars')}", F.coalesce(F.length(text).cast(cut.schema[names.index("n_chars")].dataType), n))
    return flat.toDF(*names)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its error budget, go.

    Null and empty texts hold none and stay; repeated rows stay or go together; an empty benchmark removes nothing.
    """
    return decontaminate.drop_contaminated(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW).drop(ROW)


@_stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary-length pieces of the documents' tokens with their sequence numbers; the columns are those of ``packing.pack``.

    Null and empty texts are the end id alone; repeated rows are packed once each.
    """
    return packing.pack(docs, "byte_bpe_50k.json")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. What a stage has stored goes when its result is written, that result when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = work_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        before = len(made)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"{base}/{i}")
            sweep(spark, before)
        if 0 < i < len(STAGES) - 1:
            remove(spark, f"{base}/{i - 1}")
    return docs
