"""Dense numbering of distinct values without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources.scratch import Scratch


def number_members(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Number distinct ``(dim, value)`` rows 0, 1, ... per ``dim`` in value order.

    Rows are range-partitioned and stored with their slice number, so that each slice is
    ranked by itself and shifted by the row counts of the slices before it. Storing them first
    is what makes it exact: the slice borders come from a sample and could differ when a lost
    executor makes Spark compute them again.
    """
    sliced = scratch.save(
        members.repartitionByRange("dim", "value").withColumn("slice", F.spark_partition_id()),
        "members",
    )
    before = Window.partitionBy("dim").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy("dim", "slice")
        .agg(F.count("*").alias("n"))
        .select("dim", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("dim", "slice").orderBy("value")
    return (
        sliced.withColumn("rank", F.row_number().over(within) - 1)
        .join(shifts, ["dim", "slice"])
        .select("dim", "value", (F.col("rank") + F.col("shift")).cast("int").alias("ord"))
    )
