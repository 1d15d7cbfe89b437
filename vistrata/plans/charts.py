"""Chart-ready frames: the data and statistics below each chart."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vistrata.functions.columns import categorical_columns, col, finite, numeric_columns
from vistrata.functions.names import CHART_CATEGORIES, chart_category, display_name
from vistrata.operators.association import (
    adjacent_pairs, correlation_matrix, linear_association, spearman_pairs)
from vistrata.operators.counts import category_summary, top_values_per_column
from vistrata.operators.groups import group_details
from vistrata.operators.histogram import histograms
from vistrata.operators.preview import CATEGORY_POINTS, SERIES_POINTS, series_preview
from vistrata.operators.profile import low_cardinality, varying_columns
from vistrata.operators.statistics import full_statistics
from vistrata.session import stage

# Category limits and shown values per chart type, number of group-mean charts.
BAR_CATEGORIES, BAR_SHOWN = 20, 15
PIE_CATEGORIES, PIE_SHOWN = 10, 10
GROUP_CHARTS = 7


def chart_histograms(df: DataFrame, statistics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Bins and statistics of every numeric column; known statistics are reused."""
    return {"bins": histograms(df), "statistics": full_statistics(df) if statistics is None else statistics}


def _category_chart(df: DataFrame, limit: int, shown: int) -> dict[str, DataFrame]:
    columns = list(low_cardinality(df, limit))
    if not columns:
        empty = df.sparkSession.createDataFrame([], "column string, rank int, value string, count bigint")
        return {"points": empty}
    points = top_values_per_column(df, columns, shown)
    whole = Window.partitionBy("column")
    points = stage(points.withColumn("proportion_pct", F.round(F.col("count") / F.sum("count").over(whole) * 100, 4)), "points")
    return {"points": points, "summary": category_summaries(points), "count_statistics": count_statistics(points)}


def category_summaries(points: DataFrame) -> DataFrame:
    """Per chart: categories, total, dominant category and its share, over the shown categories."""
    return points.groupBy("column").agg(
        F.count("*").alias("total_categories"), F.sum("count").alias("total_count"),
        F.min_by("value", "rank").alias("dominant_category"),
        F.min_by("proportion_pct", "rank").alias("dominant_proportion_pct"))


def count_statistics(points: DataFrame) -> DataFrame:
    """Statistics over the shown counts of each chart; at most 15 rows per group."""
    return shown_statistics(points, "column", "count")


def shown_statistics(points: DataFrame, group: str, value: str) -> DataFrame:
    """Statistics over the few shown values of each group: moments, percentiles, fences, outliers and mode."""
    v, n = col(value).cast("double"), F.count("*")
    levels = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
    made = points.groupBy(group).agg(
        n.alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"),
        F.percentile(v, F.array(*map(F.lit, levels))).alias("q"), F.collect_list(v).alias("values"),
        F.mode(v, True).alias("mode"),
        F.when(n >= 3, F.skewness(v)).alias("skewness"), F.when(n >= 4, F.kurtosis(v)).alias("kurtosis"))
    p = {level: F.col("q")[i] for i, level in enumerate(levels)}
    iqr = p[0.75] - p[0.25]
    low, high = p[0.25] - 1.5 * iqr, p[0.75] + 1.5 * iqr
    return made.select(
        group, "n", "mean", "std", "min", "max", "sum", "mode", p[0.25].alias("q1"), p[0.5].alias("median"), p[0.75].alias("q3"),
        iqr.alias("iqr"), "skewness", "kurtosis", "variance", (F.col("max") - F.col("min")).alias("range"),
        p[0.05].alias("p5"), p[0.1].alias("p10"), p[0.9].alias("p90"), p[0.95].alias("p95"),
        low.alias("lower_fence"), high.alias("upper_fence"),
        F.size(F.filter("values", lambda x: (x < low) | (x > high))).alias("outlier_count"),
        F.size(F.filter("values", lambda x: x == F.col("mode"))).alias("mode_count"),
        F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100).alias("coefficient_of_variation_pct"))


def chart_bars(df: DataFrame) -> dict[str, DataFrame]:
    """Categorical columns with at most 20 values: top 15 counts."""
    return _category_chart(df, BAR_CATEGORIES, BAR_SHOWN)


def chart_pies(df: DataFrame) -> dict[str, DataFrame]:
    """Categorical columns with at most 10 values: shares."""
    return _category_chart(df, PIE_CATEGORIES, PIE_SHOWN)


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Shortened series of the complete pairs, ordered by x then y."""
    pairs = df.select(finite(col(x).cast("double")).alias("x"), finite(col(y).cast("double")).alias("y")).dropna()
    return series_preview(pairs, ["x", "y"], SERIES_POINTS)


def chart_scatters(df: DataFrame, statistics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Up to 4 neighbouring numeric pairs: points, correlation and regression, statistics of both sides.

    Known column statistics are those of a pair when neither column has missing values.
    """
    pairs = adjacent_pairs(df)
    if not pairs:
        return {}
    out = {"association": linear_association(df, pairs), "rank_correlation": spearman_pairs(df, pairs)}
    whole = set()
    if statistics is not None:
        whole = {r["column"] for r in statistics.where("missing = 0").select("column").collect()}
    for x, y in pairs:
        out[f"points_{x}_{y}"] = scatter_points(df, x, y)
        if {x, y} <= whole:
            out[f"statistics_{x}_{y}"] = statistics.where(F.col("column").isin(x, y))
        else:
            out[f"statistics_{x}_{y}"] = full_statistics(df.select(col(x), col(y)).dropna(), [x, y])
    return out


def default_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """First 7 combinations of a low-cardinality category and a numeric column, both in schema order."""
    categories = list(low_cardinality(df, BAR_CATEGORIES))
    return [(c, m) for c in categories for m in numeric_columns(df)][:GROUP_CHARTS]


def chart_group_means(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None) -> dict[str, dict[str, DataFrame]]:
    """Mean by category, summary and statistics of the means, and per-group detail for each usable pair."""
    if pairs is None:
        pairs = default_pairs(df)
    categories, metrics = set(categorical_columns(df)), set(numeric_columns(df))
    usable = [(c, m) for c, m in pairs if c in categories and m in metrics]
    # One table a category serves every frame of its charts.
    made = {c: stage(group_details(df, c, list(dict.fromkeys(m for k, m in usable if k == c))), "groups") for c in dict.fromkeys(c for c, _ in usable)}
    out = {}
    for category, metric in usable:
        detail = made[category].where(F.col("metric") == metric).drop("metric")
        means = detail.select("category", "mean").orderBy(F.desc_nulls_last("mean"), "category")
        full = means.where("mean IS NOT NULL")
        out[f"avg_{metric}_by_{category}"] = {
            "points": series_preview(means, ["mean", "category"], CATEGORY_POINTS, descending=["mean"]),
            "summary": category_summary(full, "category", "mean"),
            # In one stretch, so that sums of the means are added in the same order in every plan.
            "statistics": shown_statistics(full.coalesce(1).withColumn("column", F.lit(metric)), "column", "mean"),
            "per_group_detail": detail}
    return out


def chart_correlation(df: DataFrame, statistics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Correlation matrix and per-column statistics, when two columns vary."""
    columns = varying_columns(df)
    if len(columns) < 2:
        return {}
    known = full_statistics(df, columns) if statistics is None else statistics.where(F.col("column").isin(columns))
    return {"matrix": correlation_matrix(df, columns), "statistics": known}


def chart_line(df: DataFrame, x: str, y: str) -> dict[str, DataFrame]:
    """Shortened series along x, trend of last against first value, statistics of y."""
    points = df.select(col(x).alias("x"), finite(col(y).cast("double")).alias("y")).dropna()
    trend = points.agg(F.when(F.max_by("y", "x") > F.min_by("y", "x"), "increasing").otherwise("decreasing")
                       .alias("trend"))
    return {"points": series_preview(points, ["x", "y"], SERIES_POINTS), "trend": trend,
            "statistics": full_statistics(points.select(F.col("y").alias(y)), [y])}


def anomaly_scatter(labelled: DataFrame) -> dict[str, DataFrame]:
    """Points of the first two numeric columns, shortened per label."""
    columns = [c for c in numeric_columns(labelled) if c not in ("anomaly", "anomaly_score")]
    if len(columns) < 2:
        return {}
    out = {}
    for label, name in ((1, "normal"), (-1, "anomaly")):
        side = labelled.where(F.col("anomaly") == label).select(
            col(columns[0]).alias("x"), col(columns[1]).alias("y"), "anomaly")
        out[name] = series_preview(side, ["x", "y"], SERIES_POINTS)
    return out


def _named(points: DataFrame, name: Column | str) -> DataFrame:
    """stem, points: how many points each named chart shows."""
    name = F.lit(name) if isinstance(name, str) else name
    return points.groupBy(name.alias("stem")).agg(F.count("*").alias("points"))


def chart_index(made: dict[str, dict], forecasts: DataFrame | None = None) -> DataFrame:
    """stem, name, category, points: a row per chart of the made ones that shows a point.

    The frames counted are chart data, a bounded number of points per column; the anomaly scatter's two sides are one chart.
    """
    parts = []
    if "histograms" in made:
        parts.append(_named(made["histograms"]["bins"], F.concat(F.lit("hist_"), "column")))
    for part, prefix in (("bars", "bar_"), ("pies", "pie_")):
        if part in made:
            parts.append(_named(made[part]["points"], F.concat(F.lit(prefix), "column")))
    parts += [_named(points, "scatter_" + key.removeprefix("points_"))
              for key, points in made.get("scatters", {}).items() if key.startswith("points_")]
    parts += [_named(chart["points"], stem) for stem, chart in made.get("group_means", {}).items()]
    if made.get("correlation"):
        parts.append(_named(made["correlation"]["matrix"], "correlation_heatmap"))
    sides = list(made.get("anomaly_scatter", {}).values())
    if sides:
        parts.append(_named(reduce(DataFrame.unionByName, sides), "anomaly_scatter"))
    if forecasts is not None:
        parts.append(_named(forecasts, F.concat(F.lit("forecast_"), "series")))
    if not parts:
        raise ValueError("no charts to list")
    stem = F.col("stem")
    return reduce(DataFrame.unionByName, parts).select(
        stem, display_name(stem).alias("name"), chart_category(stem).alias("category"), "points")


def staged_points(made: dict[str, dict]) -> dict[str, dict]:
    """The same charts; points that take a scan of the table, which the index counts once more, are computed once."""
    scanned = lambda part, key: (part, key) in (("histograms", "bins"), ("correlation", "matrix")) or key.startswith("points_") or part == "anomaly_scatter"
    return {part: {key: stage(frame, "points") if scanned(part, key) else frame for key, frame in frames.items()} for part, frames in made.items()}


def chart_sections(index: DataFrame) -> DataFrame:
    """position, category, charts, points, names: charts by category; a category without charts has no row."""
    order = F.array(*map(F.lit, [*CHART_CATEGORIES.values(), "other"]))
    return index.groupBy("category").agg(
        F.count("*").alias("charts"), F.sum("points").alias("points"), F.array_sort(F.collect_list("name")).alias("names")
    ).select((F.array_position(order, F.col("category")) - 1).cast("int").alias("position"), "category", "charts", "points", "names")
