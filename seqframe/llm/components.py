"""Connected components over long ids, in joins and aggregates; labels never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, work_path


def connected_components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(id, label): the smallest id that each id of ``links`` (a, b) reaches. ``start``: labels (id, label) known already.

    Each round takes the least label among a node's neighbours and then the label of that label, so
    path lengths shrink at least by half; every round's labels are written to the shared folder.
    """
    spark = links.sparkSession
    base = work_path(spark, "components")
    if start is not None:  # links between known components
        known = start
        for end in ("a", "b"):
            named = known.select(F.col("id").alias(end), F.col("label").alias(f"__{end}"))
            links = links.join(named, end, "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, f"{base}/links", 16)
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{base}/0", 16)
    round_no = 0
    while True:
        round_no += 1
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "l").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("far"))
        moved = lower.join(jump, "to", "left").select("id", F.least("to", F.coalesce("far", "to")).alias("label"), (F.least("to", F.coalesce("far", "to")) != F.col("label")).alias("changed"))
        moved = materialize(moved, f"{base}/{round_no}", 16)
        labels, done = moved.select("id", "label"), moved.where("changed").isEmpty()
        if round_no > 1:
            remove(spark, f"{base}/{round_no - 1}")
        if done:
            break
    if start is None:
        return labels
    named = labels.select(F.col("id").alias("label"), F.col("label").alias("__top"))
    old = start.join(named, "label", "left").select("id", F.coalesce("__top", "label").alias("label"))
    return materialize(old.unionByName(labels.join(start, "id", "left_anti")), f"{base}/all", 16)
