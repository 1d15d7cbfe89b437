"""Key figures of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.functions.columns import kpi_value, numeric_columns
from vistrata.functions.names import metric_group, metric_label
from vistrata.operators.profile import known_facts, number_columns


def kpis(df: DataFrame) -> DataFrame:
    """position, metric, value: SUM_c and AVG_c of each numeric column, ROW_COUNT and COLUMN_COUNT; one scan."""
    columns = numeric_columns(df)
    facts = known_facts(df, columns)
    if facts:
        made = [(f"{kind}_{c}", facts.basics[c][at]) for c in columns for kind, at in (("SUM", 2), ("AVG", 3))]
        made += [("ROW_COUNT", float(facts.rows)), ("COLUMN_COUNT", float(len(df.columns)))]
        known = df.sparkSession.createDataFrame([(i, m, v) for i, (m, v) in enumerate(made)], "position int, metric string, v double")
        return known.select("position", "metric", kpi_value(F.col("v")).alias("value"))
    rows = []
    for i, c in enumerate(columns):
        v = F.col(f"v{i}")
        rows += [(f"SUM_{c}", F.sum(v)), (f"AVG_{c}", F.avg(v))]
    rows += [("ROW_COUNT", F.count(F.lit(1)).cast("double")), ("COLUMN_COUNT", F.lit(float(len(df.columns))))]
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), kpi_value(v).alias("value"))
                      for i, (m, v) in enumerate(rows)])
    return df.select(*number_columns(df, columns)).agg(cells.alias("s")).select(F.inline("s"))


def kpi_groups(table: DataFrame) -> DataFrame:
    """Number of figures per group (SUM, AVG, other); groups without figures do not appear."""
    return table.groupBy(metric_group(F.col("metric")).alias("metric_group")).agg(F.count("*").alias("metrics"))


def kpi_group_figures(table: DataFrame) -> DataFrame:
    """metric_group, metrics, missing, least, greatest: what the figures of each group show."""
    return table.groupBy(metric_group(F.col("metric")).alias("metric_group")).agg(
        F.count("*").alias("metrics"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.min("value").alias("least"), F.max("value").alias("greatest"))


def kpi_labels(table: DataFrame) -> DataFrame:
    metric = F.col("metric")
    return table.select("metric", metric_group(metric).alias("metric_group"), metric_label(metric).alias("label"),
                        "value")
