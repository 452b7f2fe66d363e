"""A table's order at any size: ranges of keys sorted each by itself, in place of one task that sorts all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import stored


def in_ranges(df: DataFrame, *by: Column | str) -> DataFrame:
    """df in partitions of ranges of `by`, in order, sorted each. Equal keys are in one partition. Written files have the ranges' order in their names."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def ranked(df: DataFrame, *by: Column | str, name: str = "position") -> DataFrame:
    """df with each row's place (from 0) in the order of `by`; equal keys follow in any order.

    Places within a range are counted by its own task, and begin where the ranges before it end: one number for each range is summed up.
    """
    rows = in_ranges(df, *by).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = stored(rows, "ranked")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
