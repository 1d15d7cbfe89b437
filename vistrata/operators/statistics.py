"""Full per-column statistics, describe tables and query-result statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from vistrata.functions.columns import col, numeric_columns
from vistrata.functions.formulas import normal_quantile, shapiro_francia_p, shapiro_wilk
from vistrata.operators.counts import modes_of
from vistrata.operators.profile import numeric_profile
from vistrata.operators.quantiles import ValueTable, percentiles, value_table

# Fixed values of the statistics payload.
PERCENTILES = [5, 10, 25, 50, 75, 90, 95]
OUTLIER_SAMPLE = 20
NORMALITY_ROWS = 5000
NORMALITY_LEVEL = 0.05
# Copies of one value up to which every one has a normal score of its own.
SINGLE_SCORES = 4096


def percentile_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, p5 ... p95, median, q1, q3, iqr and the 1.5 IQR fences."""
    columns = numeric_columns(df) if columns is None else list(columns)
    return _named_percentiles(percentiles(df, columns, [p / 100 for p in PERCENTILES]))


def _named_percentiles(table: DataFrame) -> DataFrame:
    p = {q: F.col("values")[i] for i, q in enumerate(PERCENTILES)}
    spread = p[75] - p[25]
    return table.select(
        "column", *[p[q].alias(f"p{q}") for q in PERCENTILES], p[50].alias("median"), p[25].alias("q1"),
        p[75].alias("q3"), spread.alias("iqr"), (p[25] - 1.5 * spread).alias("lower_fence"),
        (p[75] + 1.5 * spread).alias("upper_fence"))


def outliers_of(counted: DataFrame, fences: DataFrame) -> DataFrame:
    """column, outlier_count, outliers_sample (the 20 smallest) from column, value, vc rows.

    `fences` has one row per column.
    """
    bounds = F.broadcast(fences.select("column", "lower_fence", "upper_fence"))
    outside = counted.join(bounds, "column").where(
        (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence")))
    order = Window.partitionBy("column").orderBy("value")
    # 20 distinct values are enough to list 20 occurrences.
    shown = (outside.withColumn("r", F.row_number().over(order)).where(F.col("r") <= OUTLIER_SAMPLE)
             .select("column", "value", F.explode(F.array_repeat(
                 F.lit(1), F.least(F.col("vc"), F.lit(OUTLIER_SAMPLE)).cast("int"))))
             .groupBy("column").agg(F.slice(F.array_sort(F.collect_list(F.round("value", 6))), 1, OUTLIER_SAMPLE)
                                    .alias("outliers_sample")))
    counts = outside.groupBy("column").agg(F.sum("vc").alias("outlier_count"))
    return (fences.select("column").join(counts, "column", "left").join(shown, "column", "left")
            .withColumn("outlier_count", F.coalesce("outlier_count", F.lit(0).cast("bigint"))))


def outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, lower_fence, upper_fence, outlier_count, outliers_sample of numeric columns."""
    columns = numeric_columns(df) if columns is None else list(columns)
    values = value_table(df, columns)
    fences = _named_percentiles(values.percentiles([p / 100 for p in PERCENTILES]))
    found = outliers_of(values.named(), fences)
    return fences.select("column", "lower_fence", "upper_fence").join(found, "column")


def normality(df: DataFrame, columns: Sequence[str] | None = None, rows: int = NORMALITY_ROWS) -> DataFrame:
    """column, shapiro_stat, shapiro_p_value, is_normal_distribution, n (values) and n_tested.

    The test is defined for few values only: up to `rows` of them are drawn by seeded random rank, all if there are
    no more.
    """
    values = value_table(df, numeric_columns(df) if columns is None else list(columns))
    sizes = values.named().groupBy("column").agg(F.sum("vc").alias("n"))
    return (normality_of(values, rows).join(sizes, "column")
            .withColumn("n_tested", F.least(F.col("n"), F.lit(rows)).cast("bigint")))


def normality_of(values: ValueTable, rows: int = NORMALITY_ROWS) -> DataFrame:
    """The test from a value table; one Spark group of at most `rows` values per column."""
    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        enough = len(pdf) >= 3
        w, p = shapiro_wilk(pdf["value"].to_numpy()) if enough else (0.0, 0.0)
        row = pd.DataFrame({"column": [pdf["column"].iloc[0]], "shapiro_stat": [round(w, 6)],
                            "shapiro_p_value": [round(p, 6)], "is_normal_distribution": [p > NORMALITY_LEVEL]})
        return row if enough else row.iloc[:0]

    return values.sample(rows).groupBy("column").applyInPandas(
        test, "column string, shapiro_stat double, shapiro_p_value double, is_normal_distribution boolean")


def score_sums(before: np.ndarray, copies: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the normal scores of the ranks before + 1 .. before + copies out of n.

    Up to SINGLE_SCORES copies every rank is scored; longer runs are an integral, whose error falls with the square of
    their length.
    """
    out = np.zeros(len(copies))
    short = copies <= SINGLE_SCORES
    at = np.flatnonzero(short)
    size = copies[at]
    for part in np.array_split(np.arange(len(at)), max(1, int(size.sum()) >> 20)):
        own, first = size[part], np.cumsum(size[part]) - size[part]
        rank = np.repeat(before[at[part]] + 1 - first, own) + np.arange(int(own.sum()))
        scores = normal_quantile((rank - 0.375) / (np.repeat(n[at[part]], own) + 0.25))
        out[at[part]] = np.add.reduceat(scores, first) if len(part) else scores
    density = lambda u: np.exp(-0.5 * normal_quantile(u) ** 2) / np.sqrt(2 * np.pi)
    long = ~short
    whole = n[long] + 0.25
    # The lowest and the highest rank alone keep the ends off 0 and 1.
    low, high = before[long] + 1, before[long] + copies[long]
    score = lambda rank: normal_quantile((rank - 0.375) / whole)
    inner = whole * (density((low + 0.125) / whole) - density((high - 0.875) / whole))
    out[long] = score(low) + score(high) + inner
    return out


def normality_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n, francia_stat, francia_p_value, is_normal_distribution: the Shapiro-Francia test over all values.

    Values stand at their distributed ranks in the value table; each task scores its own runs of equal values, and the
    sums of a column meet in one aggregate. Columns of fewer than 5 values are left out; a constant column is no
    normal one.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    return normality_of_all(value_table(df, columns))


def normality_of_all(values: ValueTable) -> DataFrame:
    """The same from a value table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, copies, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("before", "vc", "n"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_sums(before, copies, n))], names=[*batch.schema.names, "m"])

    # Scores are symmetric, so any centre gives the same product; the mean keeps the figures small.
    means = values.frame.groupBy("ci").agg((F.sum(F.col("value") * F.col("vc")) / F.sum("vc")).alias("mean"))
    centred = values.frame.join(F.broadcast(means), "ci").select("ci", "before", "vc", "n", (F.col("value") - F.col("mean")).alias("d"))
    scored = centred.mapInArrow(run, "ci int, before bigint, vc bigint, n bigint, d double, m double")
    sums = scored.groupBy("ci").agg(F.first("n").alias("n"), F.sum(F.col("m") * F.col("d")).alias("md"), F.sum(F.col("vc") * F.col("d") * F.col("d")).alias("dd"),
                                    F.count("*").alias("values"))
    rows = sums.where("n >= 5").collect()
    # The scores' own squares depend on n alone.
    squares = {n: score_squares(n) for n in {r["n"] for r in rows}}
    made = []
    for r in rows:
        w = min(r["md"] ** 2 / (squares[r["n"]] * r["dd"]), 1.0) if r["values"] > 1 and r["dd"] > 0 else 0.0
        p = shapiro_francia_p(w, r["n"]) if w else 0.0
        made.append((values.columns[r["ci"]], r["n"], w, p, p > NORMALITY_LEVEL))
    return values.frame.sparkSession.createDataFrame(
        made, "column string, n bigint, francia_stat double, francia_p_value double, is_normal_distribution boolean")


def score_squares(n: int) -> float:
    """Sum of the squared normal scores of n ranks: single ones at both ends, an integral between.

    The integral of the squared quantile is u - q(u) * density(q(u)).
    """
    edge = min(n, 2 * SINGLE_SCORES)
    ranks = np.arange(1, edge // 2 + 1)
    out = 2.0 * float((normal_quantile((ranks - 0.375) / (n + 0.25)) ** 2).sum())
    if n > edge:
        ends = np.array([edge // 2 + 0.125, n - edge // 2 + 0.125]) / (n + 0.25)
        q = normal_quantile(ends)
        whole = ends - q * np.exp(-0.5 * q * q) / np.sqrt(2 * np.pi)
        out += (n + 0.25) * float(whole[1] - whole[0])
    return out


def full_statistics(df: DataFrame, columns: Sequence[str] | None = None, with_normality: bool = True) -> DataFrame:
    """The complete statistics of each numeric column that has values, rounded to 6 places."""
    columns = numeric_columns(df) if columns is None else list(columns)
    values = value_table(df, columns)
    table = df.sparkSession.createDataFrame(*_local(_named_percentiles(
        values.percentiles([p / 100 for p in PERCENTILES]))))
    present = [c for c in columns if c in {r["column"] for r in table.collect()}]
    if not present:
        return numeric_profile(df, columns).where("count > 0")
    out = (
        numeric_profile(df, present)
        .withColumn("coefficient_of_variation_pct",
                    F.round(F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100), 4))
        .join(table, "column").join(modes_of(values.frame, columns), "column", "left")
        .join(outliers_of(values.named(), table), "column", "left")
    )
    if with_normality:
        out = out.join(normality_of(values), "column", "left")
    fixed = {"coefficient_of_variation_pct", "shapiro_stat", "shapiro_p_value"}
    return out.select(*[
        F.round(f.name, 6).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) and f.name not in fixed else F.col(f.name)
        for f in out.schema.fields
    ])


def _local(df: DataFrame):
    """Rows and schema of a frame with one row per column."""
    return df.collect(), df.schema


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]


def _clock(df: DataFrame, times: Sequence[str]) -> DataFrame:
    """Time columns as seconds since the epoch."""
    return df.select(*[(F.unix_micros(col(c).cast("timestamp")) / 1e6).alias(c) for c in times])


def describe_times(df: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """column, count, mean, min, p25, p50, p75, max of the time columns as times, to the microsecond.

    A known describe table that holds the time columns is read instead of the frame. A column without values has a row
    of missing times; a table without time columns gives no row.
    """
    times, shown = time_columns(df), ["mean", "min", "p25", "p50", "p75", "max"]
    if not times:
        return df.sparkSession.createDataFrame([], "column string, count bigint, " + ", ".join(f"{c} timestamp" for c in shown))
    if described is not None and numeric_columns(df):
        made = described.where(F.col("column").isin(times))
    else:
        clock = _clock(df, times)
        made = numeric_profile(clock, times).join(percentile_table(clock, times).select("column", "p25", "p50", "p75"), "column", "left")
    return made.select("column", "count", *[F.timestamp_micros(F.round(F.col(c) * 1e6).cast("bigint")).alias(c) for c in shown])


def describe(df: DataFrame) -> DataFrame:
    """column, count, mean, std, min, 25%, 50%, 75%, max as text-free doubles.

    Timestamp columns join in, as seconds since the epoch and without std, when there is a numeric column.
    """
    numeric = numeric_columns(df)
    times = time_columns(df) if numeric else []
    if not numeric:
        return df.sparkSession.createDataFrame(
            [], "column string, count bigint, mean double, std double, min double, p25 double, p50 double, "
                "p75 double, max double, position int")
    clock = _clock(df, times)
    table = percentile_table(df, numeric).select("column", "p25", "p50", "p75")
    profile = numeric_profile(df, numeric).withColumn("std", F.when(F.col("count") > 1, F.col("std")))
    if times:
        table = table.unionByName(percentile_table(clock, times).select("column", "p25", "p50", "p75"))
        timed = numeric_profile(clock, times).withColumn("std", F.lit(None).cast("double"))
        profile = profile.unionByName(timed.withColumn("position", F.col("position") + len(numeric)))
    return profile.join(table, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max", "position")


def query_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics of the plotted columns of a query result; skewness and kurtosis are bias-corrected."""
    columns = [c for c in columns if c in numeric_columns(df)]
    table = percentile_table(df, columns).select("column", "median", "q1", "q3", "iqr")
    n, g1, g2 = F.col("count").cast("double"), F.col("skewness"), F.col("kurtosis")
    return (
        numeric_profile(df, columns).join(table, "column", "left")
        .withColumn("std", F.when(n > 1, F.col("std")))
        .withColumn("skewness", F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2)))
        .withColumn("kurtosis", F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))
        .select("column", "count", "missing", "mean", "median", "std", "min", "max", "range",
                "q1", "q3", "iqr", "skewness", "kurtosis")
    )


def percentile_ladder(table: DataFrame) -> DataFrame:
    """Position of each percentile between min and max, in percent, held to 2-100."""
    steps = [("p5", "p5"), ("p10", "p10"), ("Q1 (p25)", "q1"), ("Median (p50)", "p50"),
             ("Q3 (p75)", "q3"), ("p90", "p90"), ("p95", "p95")]
    width = F.when(F.col("max") == F.col("min"), F.lit(1.0)).otherwise(F.col("max") - F.col("min"))
    cells = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(name).alias("value"),
                 F.greatest(F.lit(2.0), F.least(F.lit(100.0), (F.col(name) - F.col("min")) / width * 100))
                 .alias("position_pct"))
        for i, (label, name) in enumerate(steps)
    ])
    return table.select("column", F.inline(cells)).where("value IS NOT NULL")
