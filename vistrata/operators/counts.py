"""Value counts, modes, shares and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vistrata.functions.columns import col
from vistrata.operators.profile import long_form, numbers
from vistrata.operators.quantiles import named


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of the present values, unordered."""
    return df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("count"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; equal counts go by value."""
    return value_counts(df, column).orderBy(F.desc("count"), "value").limit(k)


def counts_by_key(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column).orderBy("value")


def text_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count) of several columns in one job; values as text."""
    return long_form(df, columns, "string").groupBy("column", "value").agg(F.count("*").alias("count"))


def top_of(counted: DataFrame, k: int) -> DataFrame:
    """(column, rank, value, count): the k most frequent values of each column."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return (counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("column", "rank", "value", "count"))


def top_values_per_column(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    return top_of(text_counts(df, columns), k)


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode, mode_count): the smallest of the most frequent values."""
    cells = F.array(*[F.struct(F.lit(i).alias("ci"), F.col(f"v{i}").alias("value")) for i in range(len(columns))])
    counted = (numbers(df, columns).select(F.inline(cells)).where("value IS NOT NULL")
               .groupBy("ci", "value").agg(F.count("*").alias("vc")))
    return modes_of(counted, columns)


def modes_of(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same from ci, value, vc rows. The sign of the value settles ties in one aggregate."""
    best = counted.groupBy("ci").agg(F.max(F.struct("vc", (-F.col("value")).alias("neg"))).alias("b"))
    return best.select(named(columns), (F.lit(0.0) - F.col("b.neg")).alias("mode"), F.col("b.vc").alias("mode_count"))


def category_shares(counts: DataFrame, label: str = "value", metric: str = "count") -> DataFrame:
    """Adds the percentage of the shown total to a short list of categories."""
    total = counts.agg(F.sum(metric)).scalar()
    return counts.select(
        F.col(label).cast("string").alias("name"), F.col(metric).alias("count"),
        F.when(total > 0, F.round(F.col(metric) / total * 100, 4)).otherwise(F.lit(0.0)).alias("proportion_pct"))


def category_summary(counts: DataFrame, label: str = "value", metric: str = "count") -> DataFrame:
    """total_categories, total_count, dominant_category and its share, of the shown categories."""
    # Equal leaders: the smallest label, as in the display order.
    top = F.max(metric)
    named = counts.withColumn("_top", counts.agg(F.max(metric)).scalar())
    return named.agg(
        F.count("*").alias("total_categories"),
        F.sum(metric).cast("double").alias("total_count"),
        F.min(F.when(F.col(metric) == F.col("_top"), F.col(label).cast("string"))).alias("dominant_category"),
        F.round(F.try_divide(top, F.sum(metric)) * 100, 4).alias("dominant_proportion_pct"))
