"""Correlation and regression between numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.functions.columns import numeric_columns
from vistrata.functions.formulas import correlation_p_value
from vistrata.operators.gram import pair_sums
from vistrata.operators.profile import numbers, numeric_profile, varying
from vistrata.operators.quantiles import ValueTable, value_table
from vistrata.session import stage

# Distinct values of all ranked columns that one table in memory may hold (16 bytes each).
BROADCAST_ROWS = 1_000_000
HOT_SHARE = 1000
# Share of the raw squares below which a spread is rounding.
NO_SPREAD = 1e-11


def adjacent_pairs(df: DataFrame, limit: int = 4) -> list[tuple[str, str]]:
    """Neighbouring numeric columns, in schema order."""
    names = numeric_columns(df)
    return list(zip(names, names[1:]))[:limit]


def _moments(df: DataFrame, pairs: Sequence[tuple[str, str]], means: dict[str, float] | None = None) -> DataFrame:
    """position, x_name, y_name, n, sxx, syy, sxy, mx, my of each pair over its complete rows.

    Column means are read first, if not given; all sums of all pairs then come from one scan of values less these means.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    if means is None:
        means = {r["column"]: r["mean"] for r in numeric_profile(df, names, moments=False).collect()}
    shift = [means[c] or 0.0 for c in names]
    centred = numbers(df, names).select(*[(F.col(f"v{i}") - F.lit(m)).alias(f"d{i}") for i, m in enumerate(shift)])
    return _centred(pair_sums(centred), pairs, {c: i for i, c in enumerate(names)}, shift)


def _centred(sums: DataFrame, pairs: Sequence[tuple[str, str]], place: dict[str, int], means: Sequence[float]) -> DataFrame:
    """Central sums of the named pairs, from the sums of values less `means`."""
    rows = [(k, a, b, min(place[a], place[b]), max(place[a], place[b]), place[a] > place[b], means[place[a]], means[place[b]])
            for k, (a, b) in enumerate(pairs)]
    asked = df_of(sums, rows, "position int, x_name string, y_name string, i int, j int, turned boolean, cx double, cy double")
    side = lambda one, other: F.when(F.col("turned"), F.col(other)).otherwise(F.col(one))
    made = F.broadcast(asked).join(sums, ["i", "j"]).select(
        "position", "x_name", "y_name", "n", "xy", "cx", "cy", side("sx", "sy").alias("sx"), side("sy", "sx").alias("sy"),
        side("qx", "qy").alias("qx"), side("qy", "qx").alias("qy"))
    centre = lambda total, left, right: F.col(total) - F.coalesce(F.try_divide(F.col(left) * F.col(right), F.col("n")), F.lit(0.0))
    # A constant column has no spread, whatever rounding says.
    spread = lambda q, s: F.when(centre(q, s, s) > F.col(q) * NO_SPREAD, centre(q, s, s)).otherwise(F.lit(0.0))
    return made.select(
        "position", "x_name", "y_name", "n", spread("qx", "sx").alias("sxx"), spread("qy", "sy").alias("syy"),
        centre("xy", "sx", "sy").alias("sxy"), (F.col("cx") + F.try_divide("sx", "n")).alias("mx"),
        (F.col("cy") + F.try_divide("sy", "n")).alias("my"))


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def _bounded(product, left, right):
    """product / sqrt(left * right), held to -1 and 1; NULL without spread on a side."""
    r = F.try_divide(product, F.sqrt(left) * F.sqrt(right))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def _pearson():
    return _bounded(F.col("sxy"), F.col("sxx"), F.col("syy"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """row_name, column_name, r over the non-constant numeric columns; pairwise complete, 6 places."""
    facts = varying(df, columns)
    columns = [r["column"] for r in facts]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    diagonal = df_of(df, [(c, c, 1.0) for c in columns], "row_name string, column_name string, r double")
    if not pairs:
        return diagonal.limit(0)
    half = _moments(df, pairs, {r["column"]: r["mean"] for r in facts}).select("x_name", "y_name", F.round(_pearson(), 6).alias("r"))
    both = half.select(F.inline(F.array(
        F.struct(F.col("x_name").alias("row_name"), F.col("y_name").alias("column_name"), "r"),
        F.struct(F.col("y_name").alias("row_name"), F.col("x_name").alias("column_name"), "r"))))
    return both.unionByName(diagonal)


def wide_matrix(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column name, one value column per column name."""
    return matrix.groupBy("row_name").pivot("column_name", list(columns)).agg(F.first("r"))


def linear_association(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Pearson r, simple regression of y on x, and their common p-value, one row per pair.

    Pairs with fewer than 3 complete rows are left out; a constant side gives NULLs.
    """
    pairs = adjacent_pairs(df) if pairs is None else list(pairs)
    r, n = F.col("pearson_r"), F.col("n").cast("double")
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    unexplained = F.greatest(F.lit(0.0), (1.0 - r * r) * F.col("syy"))
    return (
        _moments(df, pairs).where("n >= 3").withColumn("pearson_r", _pearson())
        .select(
            "position", "x_name", "y_name", "n", "pearson_r", (r * r).alias("r_squared"),
            slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
            F.sqrt(F.try_divide(unexplained, F.col("sxx") * (n - 2))).alias("std_error"),
            correlation_p_value()(r, n).alias("p_value"))
    )


def _looked_up(values: ValueTable) -> list[int]:
    """Columns of the fewest distinct values, as many as one table in memory may hold."""
    out, total = [], 0
    for i in sorted(range(len(values.columns)), key=lambda i: values.distinct[i]):
        total += values.distinct[i]
        if total <= BROADCAST_ROWS:
            out.append(i)
    return out


def _rank_table(values: ValueTable, columns: Sequence[int]) -> DataFrame:
    """ci, value, vc, n, rank of some columns; ranks are centred."""
    rank = F.col("before") + (F.col("vc") + 1) / 2.0 - (F.col("n") + 1) / 2.0
    return values.frame.where(F.col("ci").isin(list(columns))).select("ci", (F.col("value") + 0.0).alias("value"), "vc", "n", rank.alias("rank"))


def _rank_sums(frame: DataFrame, values: ValueTable, columns: Sequence[int]) -> DataFrame:
    """Pair sums of centred ranks; every task looks the values of `columns` up in one table of bounded size, the others
    are ranks."""
    table = _rank_table(values, columns).select("ci", "value", "rank").toPandas()
    found = []
    for i in columns:
        one = table[table["ci"] == i].sort_values("value")
        found.append((i, one["value"].to_numpy(float), one["rank"].to_numpy(float)))
    shared = frame.sparkSession.sparkContext.broadcast(found)

    def change(x: np.ndarray) -> np.ndarray:
        out = x.copy()
        for i, value, rank in shared.value:
            there = ~np.isnan(x[:, i])
            out[there, i] = rank[np.searchsorted(value, x[there, i])]
        return out

    return pair_sums(frame, change)


def _by_join(frame: DataFrame, values: ValueTable, columns: Sequence[int]) -> DataFrame:
    """The frame with centred ranks for the values of `columns`, by joins of single values; those holding over a
    thousandth of a column's rows are broadcast, the others shuffled. The other columns travel once a row."""
    rows = stage(frame.withColumn("row", F.monotonically_increasing_id()), "rows")
    cells = F.array(*[F.struct(F.lit(i).alias("ci"), (F.col(f"v{i}") + 0.0).alias("value")) for i in columns])
    long = rows.select("row", F.inline(cells)).where("value IS NOT NULL")
    table = stage(_rank_table(values, columns).select("ci", "value", (F.col("vc") * HOT_SHARE > F.col("n")).alias("hot"), "rank"), "ranks")
    # At most a thousand values of each column.
    hot = F.broadcast(table.where("hot").drop("hot"))
    ranked = long.join(hot, ["ci", "value"]).unionByName(
        long.join(hot, ["ci", "value"], "left_anti").join(table.where("NOT hot").drop("hot"), ["ci", "value"])).drop("value")
    kept = [c for i, c in enumerate(frame.columns) if i not in columns]
    met = ranked.unionByName(rows.select("row", *kept), allowMissingColumns=True)
    return met.groupBy("row").agg(*[F.max(c).alias(c) if c in kept else F.max(F.when(F.col("ci") == i, F.col("rank"))).alias(c)
                                    for i, c in enumerate(frame.columns)]).drop("row")


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """x_name, y_name, n, spearman_r, spearman_p_value of each pair over its complete rows, ties sharing their mean
    rank; pairs of fewer than 3 complete rows are left out.

    All columns are ranked by one table of counted values, and all sums of all pairs come from one matrix of ranks, so
    the number of jobs does not depend on the number of pairs. A column that meets gaps of its partner is ranked
    within the partner's rows, as a column of its own.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    gaps = {r["column"] for r in numeric_profile(df, names, moments=False).where("missing > 0").select("column").collect()}
    place = {c: i for i, c in enumerate(names)}
    sides = [((x, y if y in gaps else None), (y, x if x in gaps else None)) for x, y in pairs]
    columns = list(dict.fromkeys(side for both in sides for side in both))
    frame = numbers(df, names).select(*[
        (F.when(F.col(f"v{place[mask]}").isNotNull(), F.col(f"v{place[c]}")) if mask else F.col(f"v{place[c]}")).alias(f"v{i}")
        for i, (c, mask) in enumerate(columns)])
    # Without gaps the columns are those of the frame, whose value table may be known.
    whole = not any(mask for _, mask in columns)
    values = value_table(df, names) if whole else value_table(frame, frame.columns)
    held = _looked_up(values)
    others = [i for i in range(len(columns)) if i not in held]
    sums = _rank_sums(_by_join(frame, values, others) if others else frame, values, held)
    at = {side: i for i, side in enumerate(columns)}
    keyed = [(str(at[a]), str(at[b])) for a, b in sides]
    made = _centred(sums, keyed, {str(i): i for i in range(len(columns))}, [0.0] * len(columns)).where("n >= 3")
    named = df_of(df, [(k, x, y) for k, (x, y) in enumerate(pairs)], "position int, x_name string, y_name string")
    r = _pearson()
    return (made.drop("x_name", "y_name").join(F.broadcast(named), "position").select("x_name", "y_name", "n", r.alias("spearman_r"))
            .withColumn("spearman_p_value", correlation_p_value()(F.col("spearman_r"), F.col("n").cast("double"))))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """The same of one pair."""
    return spearman_pairs(df, [(x, y)])
