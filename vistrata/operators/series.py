"""Finding a time column and metrics, and preparing series for forecasting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrata.functions.columns import col, to_number, to_time
from vistrata.operators.layouts import layout_scores, time_values
from vistrata.operators.profile import known_facts
from vistrata.operators.quantiles import percentile_dict

# Fixed values of the detection and preparation rules.
NAME_BONUS = 10
MIN_NUMBERS = 10
MAX_METRICS = 3
MIN_ROWS = 20
TRIM = (0.01, 0.99)


def time_scores(df: DataFrame) -> DataFrame:
    """column, score: values readable as a time, plus 10 for a telling name. Numbers are never times."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    counts = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.count(to_time(col(f.name), f.dataType)).alias("read"), F.lit(_bonus(f.name)).alias("bonus"))
        for f in fields if not isinstance(f.dataType, T.StringType)])
    bonus = df.sparkSession.createDataFrame([(f.name, _bonus(f.name)) for f in fields if isinstance(f.dataType, T.StringType)], "column string, bonus int")
    texts = layout_scores(df).groupBy("column").agg(F.max("readable").alias("read")).join(F.broadcast(bonus), "column")
    plain = df.agg(counts.alias("s")).select(F.inline("s")) if len(fields) > bonus.count() else texts.limit(0)
    return plain.unionByName(texts).select("column", (F.col("read") + F.col("bonus")).alias("score"))


def _bonus(name: str) -> int:
    low = name.lower()
    return NAME_BONUS if "date" in low or "time" in low or low == "ds" else 0


def detect_time_column(df: DataFrame) -> str | None:
    """Highest score; equal scores go to the later name."""
    timed = {f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))}
    best = [r for r in time_scores(df).orderBy(F.desc("score"), F.desc("column")).collect()
            if r["column"] in timed and r["score"] > _bonus(r["column"])]
    return best[0]["column"] if best else None


def metric_scores(df: DataFrame, time_column: str | None) -> DataFrame:
    """column, numbers: numeric or numeric-looking columns with at least 10 numbers that are not all equal."""
    fields = [f for f in df.schema.fields
              if f.name != time_column and isinstance(f.dataType, (T.NumericType, T.StringType))]
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.count(x).alias("numbers"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        for f in fields for x in [to_number(col(f.name), f.dataType)]])
    return (df.agg(cells.alias("s")).select(F.inline("s"))
            .where((F.col("numbers") >= MIN_NUMBERS) & (F.col("lo") < F.col("hi"))).select("column", "numbers"))


def detect_metrics(df: DataFrame, time_column: str | None, limit: int = MAX_METRICS) -> list[str]:
    """Most numbers first; equal counts go to the later name."""
    ranked = metric_scores(df, time_column).orderBy(F.desc("numbers"), F.desc("column")).limit(limit)
    return [r["column"] for r in ranked.collect()]


def trim_extremes(df: DataFrame, value: str) -> DataFrame:
    """Rows within the 1st and 99th percentile, both included."""
    got = percentile_dict(df, [value], TRIM)
    if value not in got:
        return df.limit(0)
    return df.where(col(value).between(*got[value]))


def prepare_series(df: DataFrame, time_column: str, metrics: Sequence[str]) -> DataFrame:
    """(series, ds, y) rows of every usable metric: timed, numeric, varying, trimmed, at least 20 rows."""
    metrics = [m for m in metrics if m in df.columns and m != time_column]
    wide = df.select(time_values(df, time_column).alias("ds"),
                     *[to_number(col(m), df.schema[m].dataType).alias(f"m{i}") for i, m in enumerate(metrics)]).where("ds IS NOT NULL")
    names = [f"m{i}" for i in range(len(metrics))]
    empty = df.sparkSession.createDataFrame([], "series string, ds timestamp, y double")
    # With a time in every row the columns' own percentiles hold, which the frame's facts may tell.
    facts, plain = known_facts(df, metrics), isinstance(df.schema[time_column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    if facts and plain and facts.present.get(time_column) == facts.rows:
        bounds = {f"m{metrics.index(c)}": v for c, v in percentile_dict(df, metrics, TRIM).items()}
    else:
        bounds = percentile_dict(wide, names, TRIM)
    if not bounds:
        return empty
    kept = {n: F.when(F.col(n).between(*bounds[n]), F.col(n)) for n in bounds}
    facts = wide.agg(*[F.count(kept[n]).alias(f"c_{n}") for n in kept],
                     *[(F.min(n) < F.max(n)).alias(f"v_{n}") for n in kept]).first()
    usable = [n for n in kept if facts[f"c_{n}"] >= MIN_ROWS and facts[f"v_{n}"]]
    if not usable:
        return empty
    cells = F.array(*[F.struct(F.lit(metrics[int(n[1:])]).alias("series"), kept[n].alias("y")) for n in usable])
    return wide.select("ds", F.inline(cells)).where("y IS NOT NULL").select("series", "ds", "y")
