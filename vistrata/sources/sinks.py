"""Writing results: one Spark write per result, to CSV, JSON, text, JDBC or document files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.functions.columns import iso_frame, kpi_text
from vistrata.sources.load import jdbc_url


def write_kpis(kpis: DataFrame, path: str) -> None:
    """Metric, Value; whole values without a fraction."""
    (kpis.select(F.col("metric").alias("Metric"), kpi_text(F.col("value")).alias("Value"))
     .write.csv(path, header=True, mode="overwrite"))


def write_rows(df: DataFrame, path: str) -> None:
    """Flagged rows or any other flat frame as CSV, times in ISO form."""
    iso_frame(df).write.csv(path, header=True, mode="overwrite")


def write_forecasts(forecasts: DataFrame, path: str) -> None:
    """One folder per series."""
    iso_frame(forecasts).write.partitionBy("series").csv(path, header=True, mode="overwrite")


def write_json(df: DataFrame, path: str) -> None:
    """Chart data, profile and summary frames, one JSON object per row; missing values are left out."""
    iso_frame(df).write.json(path, mode="overwrite")


def write_chart_folders(charts: DataFrame, path: str) -> None:
    """Chart frames with a `chart` column, one folder per chart."""
    iso_frame(charts).write.partitionBy("chart").json(path, mode="overwrite")


def write_report(report: DataFrame, path: str) -> None:
    """Cleaning report as text lines in order. A report has a few lines per column, so one file holds it."""
    title = report.sparkSession.createDataFrame([(-1, "DATA CLEANING REPORT")], "position int, line string")
    (title.unionByName(report.select("position", "line")).repartition(1).sortWithinPartitions("position")
     .select("line").write.text(path))


def write_sql_table(df: DataFrame, uri: str, table: str, mode: str = "overwrite") -> None:
    """Upload to a database table; `overwrite` replaces it, `append` adds to it."""
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")
    url, properties = jdbc_url(uri)
    df.write.jdbc(url, table, mode=mode, properties=properties)


def write_documents(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, added to those already there."""
    df.write.mode("append").json(path)
