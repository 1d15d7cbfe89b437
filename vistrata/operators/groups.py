"""Metrics by category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.functions.columns import col, finite
from vistrata.operators.quantiles import percentiles


def group_means(df: DataFrame, category: str, metric: str) -> DataFrame:
    """category, mean of the metric, highest first; rows without a category belong to no group."""
    value = finite(col(metric).cast("double"))
    return (df.where(col(category).isNotNull()).groupBy(col(category).alias("category"))
            .agg(F.avg(value).alias("mean")).orderBy(F.desc_nulls_last("mean"), "category"))


def group_detail(df: DataFrame, category: str, metric: str) -> DataFrame:
    """category, mean, std, min, max, count, median."""
    return group_details(df, category, [metric]).drop("metric")


def group_details(df: DataFrame, category: str, metrics: Sequence[str]) -> DataFrame:
    """metric, category, mean, std, min, max, count, median of several metrics by one category, from the same scans."""
    wide = df.select(col(category).alias("category"), *[col(m).alias(f"m{i}") for i, m in enumerate(metrics)])
    cells = []
    for i, m in enumerate(metrics):
        value = finite(F.col(f"m{i}").cast("double"))
        cells.append(F.struct(F.lit(m).alias("metric"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
                              F.max(value).alias("max"), F.count(value).alias("count")))
    basic = wide.where(F.col("category").isNotNull()).groupBy("category").agg(F.array(*cells).alias("s")).select("category", F.inline("s"))
    names = [f"m{i}" for i in range(len(metrics))]
    medians = percentiles(wide, names, [0.5], keys=["category"])
    named = F.element_at(F.array(*map(F.lit, metrics)), F.array_position(F.array(*map(F.lit, names)), F.col("column")).cast("int"))
    return basic.join(medians.select("category", named.alias("metric"), F.col("values")[0].alias("median")), ["category", "metric"], "left").select(
        "metric", "category", "mean", "std", "min", "max", "count", "median")
