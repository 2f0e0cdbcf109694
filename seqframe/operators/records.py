"""Records as an ordered collection: places in a packed buffer, and access by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SeqValueError


def offsets(records: DataFrame, order_col: str, size: Column, chunks: int = 256) -> DataFrame:
    """All columns with ``start`` and ``stop``: running sums of ``size`` in the order of a numeric, unique column.

    Rows fall into ``chunks`` ranges of that column, by approximate quantiles; sums of whole ranges give where
    each begins, so no task orders all rows.
    """
    if chunks < 1:
        raise SeqValueError("chunks must be at least 1")
    cuts = records.agg(F.percentile_approx(order_col, F.array(*(F.lit(i / chunks) for i in range(1, chunks + 1))), 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array(F.lit(0))
    ranged = records.withColumn("__size", size.cast("long")).withColumn("__range", F.size(F.filter(at, lambda c: c < F.col(order_col))))
    sums = ranged.groupBy("__range").agg(F.sum("__size").alias("__sum"))  # one row per range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__begin"))
    inside = Window.partitionBy("__range").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(begins), "__range").withColumn("stop", (F.col("__begin") + F.sum("__size").over(inside)).cast("long"))
    return out.withColumn("start", F.col("stop") - F.col("__size")).select(*records.columns, "start", "stop")


def record_at(records: DataFrame, order_col: str, index: int) -> DataFrame:
    """The record at a 0-based index in the order of a numeric, unique column, from the end if negative; no row outside."""
    place = index if index >= 0 else records.count() + index
    return offsets(records, order_col, F.lit(1)).where(F.col("start") == place).select(*records.columns)
