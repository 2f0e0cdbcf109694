"""FASTA files and text as DataFrames: seq_id, file, header, seq_type, n_symbols, seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SeqValueError
from ..functions.alphabet import canonical, detect_type


def _records(chunks: Column) -> Column:
    """Structs (header, text) of chunks between '>' marks: the first line is the header; lines after it are joined, without edge blanks and ';' lines."""
    end = lambda c: F.locate("\n", c)
    parts = F.transform(chunks, lambda c: F.struct(F.substring_index(c, "\n", 1).alias("head"), F.when(end(c) > 0, F.substr(c, end(c) + 1)).otherwise("").alias("body")))
    line = lambda x: F.ltrim(F.rtrim(x, F.lit("\t\r ")), F.lit("\t "))
    joined = lambda body: F.array_join(F.filter(F.transform(F.split(body, "\n"), line), lambda x: ~x.startswith(";")), "")
    plain = lambda body: ~(body.contains("\t") | body.contains("\r") | body.contains(" ") | body.contains(";"))
    text = lambda body: F.when(plain(body), F.replace(body, F.lit("\n"), F.lit(""))).otherwise(joined(body))
    return F.transform(parts, lambda x: F.struct(F.trim(F.rtrim(x["head"], F.lit("\t\r "))).alias("header"), text(x["body"]).alias("text")))


def _typed(records: DataFrame, force_type: str | None, *keep: str) -> DataFrame:
    if force_type not in (None, "nucleotide", "protein"):
        raise SeqValueError("force_type must be 'nucleotide' or 'protein'")
    kind = F.lit(force_type) if force_type else detect_type(F.col("r.text"))
    out = records.where(F.length("r.text") > 0).withColumn("seq_type", kind)
    return out.select(*keep, F.col("r.header").alias("header"), "seq_type", F.length("r.text").alias("n_symbols"), canonical(F.col("r.text"), F.col("seq_type")).alias("seq"))


def _bytes(spark: SparkSession, name: str) -> int:
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))


def read_fasta(spark: SparkSession, path: str, force_type: str | None = None) -> DataFrame:
    """Records of one file, a folder or a glob; gzip by file name. Files are split at record marks.

    seq_id grows in the order of the records in their file, whatever its splits, and tells the records of one
    file apart; records without symbols are left out.
    """
    chunks = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # only the chunk at a file's beginning keeps its mark; text before the first mark has none
    # splits of a file lie at least so many bytes apart; within a split rows are numbered as they are read
    sizes = [_bytes(spark, f"spark.sql.files.{x}") for x in ("maxPartitionBytes", "openCostInBytes")]
    split = F.floor(F.col("block") / max(1, min(sizes))).cast("long")
    marked = chunks.withColumn("seq_id", F.shiftleft(split, 33).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    cleaned = marked.withColumn("value", F.regexp_replace("value", r"(?s)\A(?:[^>]*\n)?>", ""))
    return _typed(cleaned.select("seq_id", "file", F.explode(_records(F.array("value"))).alias("r")), force_type, "seq_id", "file")  # exploded, so that no filter works out a record again


def parse_fasta(texts: DataFrame, text_col: str = "text", *keep: str, force_type: str | None = None) -> DataFrame:
    """Records of FASTA texts held in a column; what stands before the first '>' is left out. seq_id counts within the text."""
    lead = F.concat(F.lit("\n"), F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")))
    chunks = F.filter(F.split(lead, "\n>"), lambda _, place: place > 0)
    each = texts.select(*keep, F.posexplode(_records(chunks)).alias("seq_id", "r"))
    return _typed(each, force_type, *keep, "seq_id")


def fasta_lines(header: Column, seq: Column, width: int = 60) -> Column:
    """A record as FASTA text, its sequence in lines of ``width``."""
    if width < 1:
        raise SeqValueError("width must be at least 1")
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", ""))


def write_fasta(records: DataFrame, path: str, width: int = 60, compression: str | None = None) -> None:
    writer = records.select(fasta_lines(F.col("header"), F.col("seq"), width).alias("value")).write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)
