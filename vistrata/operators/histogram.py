"""Equal-width histograms of many columns in one job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.functions.columns import numeric_columns, plain_number
from vistrata.operators.profile import numbers, numeric_profile

# Automatic bin count is the square root of n, held to these bounds.
MIN_BINS, MAX_BINS = 5, 30
QUERY_BINS = 30


def bin_count(n: int) -> int:
    return min(MAX_BINS, max(MIN_BINS, math.isqrt(n)))


def with_bin(cells: DataFrame) -> DataFrame:
    """Adds `bin` to rows of value, lo, step, bins. Bins are closed below and open above, the last one on both sides.

    The first guess is corrected against the edges themselves, so a value on an edge lands above it.
    """
    value, lo, step, bins = (F.col(c) for c in ("value", "lo", "step", "bins"))
    guessed = cells.withColumn("guess", F.least(F.floor((value - lo) / step), bins - 1))
    guess = F.col("guess")
    return guessed.withColumn(
        "bin", F.when(value < guess * step + lo, guess - 1)
        .when((guess < bins - 1) & (value >= (guess + 1) * step + lo), guess + 1)
        .otherwise(guess).cast("int"))


def histograms(df: DataFrame, columns: Sequence[str] | None = None, bins: int | None = None) -> DataFrame:
    """column, bin, low, high, label, count: every bin of every column, empty ones included."""
    columns = numeric_columns(df) if columns is None else list(columns)
    ranges = [r for r in numeric_profile(df, columns, moments=False).orderBy("position").collect()
              if r["count"] > 0]
    edges, cells = [], []
    for r in ranges:
        low, high = r["min"], r["max"]
        if low == high:
            low, high = low - 0.5, high + 0.5
        k = bin_count(r["count"]) if bins is None else bins
        edges.append((r["column"], low, high, k))
        cells.append(F.struct(F.lit(r["column"]).alias("column"), F.col(f"v{r['position']}").alias("value"),
                              F.lit(low).alias("lo"), F.lit((high - low) / k).alias("step"), F.lit(k).alias("bins")))
    frame = df.sparkSession.createDataFrame(edges, "column string, lo double, hi double, bins int")
    grid = frame.select("column", "lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    low = F.round(F.col("bin") * step + F.col("lo"), 6)
    high = F.round(F.when(F.col("bin") == F.col("bins") - 1, F.col("hi"))
                   .otherwise((F.col("bin") + 1) * step + F.col("lo")), 6)
    grid = grid.select("column", "bin", low.alias("low"), high.alias("high"))
    if not cells:
        return grid.select("*", F.lit("").alias("label"), F.lit(0).cast("bigint").alias("count"))
    values = numbers(df, columns).select(F.inline(F.array(*cells))).where("value IS NOT NULL")
    counted = with_bin(values).groupBy("column", "bin").agg(F.count("*").alias("count"))
    return grid.join(counted, ["column", "bin"], "left").select(
        "column", "bin", "low", "high",
        F.concat(plain_number(F.col("low")), F.lit(" - "), plain_number(F.col("high"))).alias("label"),
        F.coalesce("count", F.lit(0)).alias("count"))
