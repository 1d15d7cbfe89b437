"""Dataset summary and profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.functions.columns import categorical_columns, column_classes, numeric_columns
from vistrata.operators.counts import text_counts, top_of
from vistrata.operators.profile import distinct_counts, known_facts, missing_counts
from vistrata.operators.statistics import describe, describe_times, full_statistics, time_columns
from vistrata.session import stage

TOP_VALUES = 5


def categorical_summary(df: DataFrame) -> DataFrame:
    """column, unique_values, missing_count, top_values: the 5 most frequent (rank, value, count)."""
    columns = categorical_columns(df)
    counted = text_counts(df, columns)
    top = top_of(counted, TOP_VALUES).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("top_values"))
    # Reading `count` keeps this aggregate equal to the one below the top values, so its shuffle is reused.
    unique = counted.groupBy("column").agg(F.count_if(F.col("count") > 0).alias("unique_values"))
    missing = missing_counts(df, columns).withColumnRenamed("missing", "missing_count")
    return (missing.join(unique, "column", "left").join(top, "column", "left")
            .withColumn("unique_values", F.coalesce("unique_values", F.lit(0).cast("bigint"))))


def dataset_shape(df: DataFrame) -> DataFrame:
    facts = known_facts(df)
    if facts:
        return df.sparkSession.createDataFrame([(facts.rows, len(df.columns))], "rows bigint, columns int")
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def dataset_summary(df: DataFrame, statistics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Shape, column lists, numeric statistics and categorical summaries; known statistics are reused."""
    out = {"shape": dataset_shape(df), "columns": column_classes(df)}
    if numeric_columns(df):
        out["numeric_statistics"] = full_statistics(df) if statistics is None else statistics
    if categorical_columns(df):
        out["categorical_statistics"] = categorical_summary(df)
    return out


def dataset_profile(df: DataFrame, exact: bool = True) -> dict[str, DataFrame]:
    """Shape, per column type and distinct count (sketched if not `exact`), the describe table, and time columns' as times."""
    types = column_classes(df)
    plain = [r["column"] for r in types.where("class != 'other'").select("column").collect()]
    unique = distinct_counts(df, plain, exact).select("column", F.col("distinct").alias("unique"))
    out = {"shape": dataset_shape(df),
           "columns": types.select("position", "column", "type").join(unique, "column", "left"),
           "statistics": describe(df)}
    if time_columns(df):
        # Both parts read the table.
        out["statistics"] = stage(out["statistics"], "describe")
        out["times"] = describe_times(df, out["statistics"])
    return out


def profile_text(profile: dict[str, DataFrame]) -> DataFrame:
    """The profile as numbered text lines; it has a few lines per column."""
    shape = profile["shape"].select(F.lit(0).alias("part"), F.lit(0).alias("position"), F.format_string(
        "(%d, %d)", "rows", "columns").alias("line"))
    columns = profile["columns"].select(F.lit(1).alias("part"), "position", F.format_string(
        "%s | type=%s | unique=%d", "column", "type", "unique").alias("line"))
    statistics = profile["statistics"]
    times = profile.get("times")
    if times is not None:
        # Times are told as times, after the numbers, and not once more as seconds.
        statistics = statistics.join(F.broadcast(times.select("column")), "column", "left_anti")
        shown = [F.concat(F.lit(f"{c}="), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) for c in ("mean", "min", "p25", "p50", "p75", "max")]
        times = times.select(F.lit(3).alias("part"), F.lit(0).alias("position"), F.concat_ws(
            " ", "column", F.format_string("count=%d", "count"), *shown).alias("line"))
    numbers = statistics.select(F.lit(2).alias("part"), "position", F.concat_ws(
        " ", "column", *[F.format_string(f"{c}=%.6f", F.col(c).cast("double"))
                         for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]).alias("line"))
    lines = shape.unionByName(columns).unionByName(numbers)
    return lines if times is None else lines.unionByName(times)
