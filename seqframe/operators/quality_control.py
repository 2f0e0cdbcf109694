"""Read quality control: scalars, histograms and per-position tables.

Reads are (read_id, seq, qual) with Phred+33 text. All tables are sums of small keys, so partial
aggregation in each task leaves little to shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SeqValueError
from ..functions.sequences import gc_content, mean_quality, quality_scores, quality_sum, symbol_count

#: Positions that the per-position tables cover.
MOST_POSITIONS = 1000


def measured(reads: DataFrame) -> DataFrame:
    """Each read's length, G and C count, quality sum, mean quality and GC share."""
    seq, qual = F.col("seq"), F.col("qual")
    out = reads.withColumns({"n": F.length(seq), "gc_n": symbol_count(seq, "GC"), "q_sum": quality_sum(qual)})
    mean = F.when(F.length(qual) == 0, F.lit(0.0)).otherwise(F.col("q_sum") / F.length(qual))
    return out.withColumns({"mean_q": mean, "gc": F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("gc_n") / F.col("n"))})


def filter_reads(reads: DataFrame, least: float) -> DataFrame:
    """The reads whose mean quality is at least ``least``."""
    return reads.where(mean_quality(F.col("qual")) >= F.lit(float(least)))


def scalars(reads: DataFrame) -> DataFrame:
    """One row: reads, bases, lengths, GC and quality over all bases, and shares of reads of quality 20 and 30."""
    m = measured(reads)
    share = lambda q: F.sum((F.col("mean_q") >= q).cast("long")) * 100.0 / F.count(F.lit(1))
    return m.agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.sum("n").alias("total_bases"),
        F.min("n").alias("min_len"),
        F.max("n").alias("max_len"),
        (F.sum("n") / F.count(F.lit(1))).alias("mean_len"),
        (F.sum("gc_n") / F.sum("n")).alias("gc"),
        (F.sum("q_sum") / F.sum("n")).alias("mean_q"),
        share(20.0).alias("pct_q20"),
        share(30.0).alias("pct_q30"),
    )


def quality_histogram(reads: DataFrame) -> DataFrame:
    """(bin, n) of whole mean qualities, 0 to 63."""
    return reads.groupBy(F.least(F.floor(mean_quality(F.col("qual"))), F.lit(63)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def gc_histogram(reads: DataFrame) -> DataFrame:
    """(bin, n) of whole GC per cents, cut off, 0 to 100."""
    return reads.groupBy((gc_content(F.col("seq")) * F.lit(100.0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rebucket(histogram: DataFrame, low: int, high: int, step: int) -> DataFrame:
    """(lo, n): bins from ``low`` in steps; the last bucket, ``high``, is open to the right."""
    if step < 1:
        raise SeqValueError("step must be at least 1")
    kept = histogram.where(F.col("bin") >= low)
    lo = F.least(F.floor((F.col("bin") - low) / step) * step + low, F.lit(high)).cast("int")
    return kept.groupBy(lo.alias("lo")).agg(F.sum("n").alias("n"))


def position_quality(reads: DataFrame, most: int = MOST_POSITIONS) -> DataFrame:
    """(pos, n, q_sum, mean_q) of the first positions."""
    each = reads.select(F.posexplode(F.slice(quality_scores(F.col("qual")), 1, most)).alias("pos", "q"))
    return each.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.sum("q").cast("long").alias("q_sum")).withColumn("mean_q", F.col("q_sum") / F.col("n"))


def position_bases(reads: DataFrame, most: int = MOST_POSITIONS) -> DataFrame:
    """(pos, n, a, c, g, t, other) counts and shares of the first positions; everything but ACGT is other."""
    symbols = F.filter(F.split(F.substr(F.col("seq"), F.lit(1), F.lit(most)), ""), lambda c: c != "")
    each = reads.select(F.posexplode(symbols).alias("pos", "base"))
    counts = {b.lower(): F.sum((F.col("base") == b).cast("long")) for b in "ACGT"}
    out = each.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in counts.items()))
    out = out.withColumn("other", F.col("n") - F.col("a") - F.col("c") - F.col("g") - F.col("t"))
    return out.withColumns({f"{b}_share": F.col(b) / F.col("n") for b in ("a", "c", "g", "t", "other")})


def global_composition(reads: DataFrame) -> DataFrame:
    """(base, mean_share, base_share): the mean of the positions' shares, scaled to 1, and the share of all bases."""
    table = position_bases(reads)
    bases = ("a", "c", "g", "t", "other")
    sums = table.agg(*(F.sum(f"{b}_share").alias(f"{b}_s") for b in bases), *(F.sum(b).alias(f"{b}_n") for b in bases))
    total_s, total_n = sum((F.col(f"{b}_s") for b in bases), F.lit(0.0)), sum((F.col(f"{b}_n") for b in bases), F.lit(0))
    rows = F.array(*(F.struct(F.lit(b).alias("base"), (F.col(f"{b}_s") / total_s).alias("mean_share"), (F.col(f"{b}_n") / total_n).alias("base_share")) for b in bases))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


@dataclass
class QCReport:
    """The small tables of one report, on the driver: a row of scalars, two histograms and two position tables."""

    scalars: dict
    quality_histogram: dict[int, int]
    gc_histogram: dict[int, int]
    positions: list[dict]
    bases: list[dict]


def report(reads: DataFrame) -> QCReport:
    """All tables over one stored scan; no reads is an error."""
    reads = reads.persist()
    try:
        found = scalars(reads).first().asDict()
        if not found["n_reads"]:
            raise SeqValueError("no reads")
        return QCReport(
            found,
            {r["bin"]: r["n"] for r in quality_histogram(reads).collect()},
            {r["bin"]: r["n"] for r in gc_histogram(reads).collect()},
            [r.asDict() for r in position_quality(reads).orderBy("pos").collect()],
            [r.asDict() for r in position_bases(reads).orderBy("pos").collect()],
        )
    finally:
        reads.unpersist()
