"""Column, chart and metric names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrata.functions.columns import col

# Chart-name prefix -> category.
CHART_CATEGORIES = {
    "forecast_": "forecasting",
    "anomaly": "anomaly",
    "correlation": "correlation",
    "scatter_": "scatter",
    "hist_": "distribution",
    "bar_": "bar",
    "pie_": "pie",
}


def underscore_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores."""
    return df.withColumnsRenamed({c: c.replace(".", "_") for c in df.columns if "." in c})


def drop_document_id(df: DataFrame) -> DataFrame:
    return df.drop("_id")


def category_for_id(df: DataFrame) -> DataFrame:
    """The grouping key of a document query (`_id`) is shown as `category`."""
    return df.withColumnRenamed("_id", "category")


def flatten(df: DataFrame, depth: int | None = None, separator: str = ".") -> DataFrame:
    """Lift struct fields to columns named by their path, at any depth or down to `depth` levels."""

    def walk(parts: list[str], data_type: T.DataType, level: int):
        if isinstance(data_type, T.StructType) and (depth is None or level < depth):
            for f in data_type.fields:
                yield from walk(parts + [f.name], f.dataType, level + 1)
        else:
            c = col(parts[0])
            for p in parts[1:]:
                c = c.getField(p)
            yield c.alias(separator.join(parts))

    return df.select(*[c for f in df.schema.fields for c in walk([f.name], f.dataType, 0)])


def with_row_index(df: DataFrame) -> DataFrame:
    """A one-column result gets an `index` column in front: positions of the sorted values.

    Positions come from the sorted partitions' sizes, so no task ever holds the whole column.
    """
    if len(df.columns) != 1:
        return df
    from vistrata.operators.ranks import global_position

    name = df.columns[0]
    return global_position(df, name, "index").select("index", col(name))


def display_name(stem: Column) -> Column:
    """`forecast_unit_price` -> `Forecast: Unit Price`."""
    title = F.initcap(F.translate(stem, "_", " "))
    tail = F.initcap(F.translate(F.regexp_replace(stem, "^forecast_", ""), "_", " "))
    return (
        F.when(stem.startswith("forecast_"), F.concat(F.lit("Forecast: "), tail))
        .when(stem.startswith("anomaly"), F.concat(F.lit("Anomaly: "), title))
        .otherwise(title)
    )


def chart_category(stem: Column) -> Column:
    name = F.lower(stem)
    out = F.lit("other")
    for prefix, category in reversed(CHART_CATEGORIES.items()):
        out = F.when(name.startswith(prefix), F.lit(category)).otherwise(out)
    return out


def metric_group(metric: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(metric, "^(SUM|AVG)_", 1), F.lit("")), F.lit("other"))


def metric_label(metric: Column) -> Column:
    return F.regexp_replace(metric, "^(SUM|AVG)_", "")
