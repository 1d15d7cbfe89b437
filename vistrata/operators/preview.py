"""Heads, tails and shortened series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vistrata.functions.columns import col

# Fixed values of the chart payload.
SERIES_POINTS = 120
CATEGORY_POINTS = 25
END_POINTS = 12


def head(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """First n rows in a stated order; each task keeps n rows, nothing is sorted as a whole."""
    return df.orderBy(*order_by).limit(n)


def tail_per_series(df: DataFrame, series: str, order_by: str, n: int) -> DataFrame:
    """Last n rows of every series; each task drops what cannot be among them before the shuffle."""
    newest = Window.partitionBy(col(series)).orderBy(col(order_by).desc())
    return df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def series_preview(df: DataFrame, order_by: Sequence[str], limit: int = SERIES_POINTS,
                   total: int | None = None, descending: Sequence[str] = ()) -> DataFrame:
    """All points when there are at most `limit`, else the first and last 12.

    Adds position (0-based in the whole series), truncated, total_points and note. Both ends are top-n
    selections, so a long series is never sorted or numbered as a whole. Columns of the order named in
    `descending` fall.
    """
    total = df.count() if total is None else total
    ends = min(END_POINTS, limit // 2)
    forward = [col(c).desc() if c in descending else col(c).asc() for c in order_by]
    backward = [col(c).asc() if c in descending else col(c).desc() for c in order_by]
    rising, falling = Window.orderBy(*forward), Window.orderBy(*backward)
    if total <= limit:
        shown = df.withColumn("position", F.row_number().over(rising) - 1)
        note = F.lit(None).cast("string")
    else:
        first = df.orderBy(*forward).limit(ends)
        last = df.orderBy(*backward).limit(ends)
        # Both windows see at most `ends` rows.
        shown = first.withColumn("position", F.row_number().over(rising) - 1).unionByName(
            last.withColumn("position", F.lit(total) - F.row_number().over(falling)))
        note = F.lit(f"Showing {2 * ends} of {total} points")
    return (shown.withColumn("position", F.col("position").cast("bigint"))
            .withColumn("truncated", F.lit(total > limit))
            .withColumn("total_points", F.lit(total).cast("bigint")).withColumn("note", note))


def category_preview(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    return series_preview(df, order_by, CATEGORY_POINTS)


def share_of_largest(df: DataFrame, value: str) -> DataFrame:
    """Adds each shown value as a percentage of the largest shown one."""
    largest = df.agg(F.max(F.coalesce(col(value), F.lit(0)))).scalar()
    return df.withColumn("pct_of_largest", F.try_divide(col(value), largest) * 100)
