"""Profiles that merge: one state per column and load, so that a new file costs its own scan only.

A state has exact counts, sums and ranges beside Spark's own sketches: HLL for distinct values, KLL for percentiles.
States of parts, merged, give the state of the whole; merging is associative and may be repeated. The exact operators
stay the default; a sketch's distinct count has a relative standard error of DISTINCT_ERROR, its percentiles a rank error
of at most RANK_ERROR with 99 % confidence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.functions.columns import categorical_columns, col, numeric_columns
from vistrata.operators.profile import number_columns

# Base-2 logarithm of the HLL registers, and the size of a KLL level.
HLL_DIGITS, KLL_SIZE = 14, 800
DISTINCT_ERROR, RANK_ERROR = 0.0065, 0.0045
PERCENTILES = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


def profile_state(df: DataFrame, load: str = "") -> DataFrame:
    """load, column, numeric, rows, present, sum, squares, min, max, distinct (HLL), ranks (KLL): a row per scalar
    column, in one scan. Times, dates and truth values count as text; NaN and infinities as missing."""
    numeric, texts = numeric_columns(df), categorical_columns(df)
    wide = df.select(*number_columns(df, numeric), *[col(c).cast("string").alias(f"t{i}") for i, c in enumerate(texts)])
    null = F.lit(None).cast("double")
    cells = []
    for i, c in enumerate(numeric):
        v = F.col(f"v{i}").cast("double")
        cells.append((c, True, v, [F.sum(v), F.sum(v * v), F.min(v), F.max(v)], F.kll_sketch_agg_double(v, KLL_SIZE)))
    for i, c in enumerate(texts):
        cells.append((c, False, F.col(f"t{i}"), [null] * 4, F.lit(None).cast("binary")))
    names = ["sum", "squares", "min", "max"]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(is_number).alias("numeric"), F.count(F.lit(1)).alias("rows"), F.count(v).alias("present"),
                     *[x.alias(n) for n, x in zip(names, figures)], F.hll_sketch_agg(v.cast("string"), HLL_DIGITS).alias("distinct"), ranks.alias("ranks"))
            for c, is_number, v, figures, ranks in cells]
    return wide.agg(F.array(*rows).alias("s")).select(F.lit(load).alias("load"), F.inline("s"))


def merge_states(states: DataFrame, load: str = "") -> DataFrame:
    """States of several loads as the state of all their rows. A column that a load lacks is missing in its rows."""
    rows = states.groupBy("load").agg(F.max("rows").alias("r")).agg(F.sum("r").alias("rows"))
    merged = states.groupBy("column").agg(
        F.bool_and("numeric").alias("numeric"), F.sum("present").alias("present"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks", KLL_SIZE).alias("ranks"))
    return merged.select(F.lit(load).alias("load"), "column", "numeric", rows.scalar().alias("rows"), "present", "sum", "squares", "min", "max", "distinct", "ranks")


def read_states(states: DataFrame, probabilities: Sequence[float] = tuple(PERCENTILES)) -> DataFrame:
    """column, rows, missing, mean, std, min, max, distinct and percentiles of each state."""
    n = F.col("present").cast("double")
    spread = F.greatest(F.lit(0.0), F.col("squares") - F.col("sum") * F.col("sum") / n)
    is_number = F.col("numeric") & (F.col("present") > 0)
    return states.select(
        "column", "rows", (F.col("rows") - F.col("present")).alias("missing"), F.when(is_number, F.col("sum") / n).alias("mean"),
        F.when(is_number & (n > 1), F.sqrt(spread / (n - 1))).alias("std"), "min", "max", F.hll_sketch_estimate("distinct").alias("distinct"),
        F.when(is_number, F.array(*[F.kll_sketch_get_quantile_double("ranks", F.lit(float(p))) for p in probabilities])).alias("percentiles"))
