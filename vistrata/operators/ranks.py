"""Global positions and running totals without a one-task sort.

A frame is range-partitioned once and written with its partition number. The number is then data: totals
per partition give each partition's offset, and a window inside the partition does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vistrata.functions.columns import col
from vistrata.session import stage


def range_staged(df: DataFrame, order_by: list[str], label: str, spread_ties: bool = False) -> DataFrame:
    """Staged frame with `_part`, ascending along `order_by`.

    `spread_ties` lets rows with an equal key go to neighbouring partitions, for keys that may repeat
    without bound.
    """
    keys: list[Column] = [col(c) for c in order_by]
    if spread_ties:
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        keys.append(F.col("_tie"))
    return stage(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), label)


def with_running_total(parts: DataFrame, order_by: list[str], weight: Column, name: str) -> DataFrame:
    """Adds `name`: the total weight of all rows before this one."""
    totals = parts.groupBy("_part").agg(F.sum(weight).alias("_total"))
    # One row per partition, so this window is as small as the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = (Window.partitionBy("_part").orderBy(*[col(c) for c in order_by])
              .rowsBetween(Window.unboundedPreceding, -1))
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_offset")
    )


def global_position(df: DataFrame, order_by: str, name: str) -> DataFrame:
    """Adds the 0-based position of each row in the order of one column."""
    parts = range_staged(df, [order_by], "position", spread_ties=True)
    return with_running_total(parts, [order_by, "_tie"], F.lit(1), name).drop("_part", "_tie")


def average_ranks(counts: DataFrame, value: str, count: str) -> DataFrame:
    """(value, count) rows with distinct values -> the same rows with `rank`, ties sharing their mean rank."""
    parts = range_staged(counts, [value], "ranks")
    ranked = with_running_total(parts, [value], F.col(count), "_before")
    return ranked.select(col(value), F.col(count),
                         (F.col("_before") + (F.col(count) + 1) / 2.0).alias("rank"))
