"""One-pass column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrata.functions.columns import categorical_columns, col, finite, numeric_columns


PROFILE_SCHEMA = ("position int, column string, count bigint, missing bigint, sum double, mean double, "
                  "min double, max double, range double")


def long_form(df: DataFrame, columns: Sequence[str], cast: str = "double") -> DataFrame:
    """(column, value) rows of the present values; `column` values are names."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast(cast).alias("value")) for c in columns])
    return df.select(F.inline(cells)).where("value IS NOT NULL")


def number_columns(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Finite double values of the columns under the names v0, v1, ..."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        out.append((v if isinstance(kinds[c], T.IntegralType) else finite(v)).alias(f"v{i}"))
    return out


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same as a frame: values are computed once, however many aggregates use them."""
    return df.select(*number_columns(df, columns))


def per_column(df: DataFrame, columns: Sequence[str], build, center: Sequence[float] | None = None) -> DataFrame:
    """One aggregate over the frame whose result is turned into one row per numeric column.

    `build(i, value)` gives the aggregates of column i by output name; values are less `center`, if given.
    """
    if not columns:
        raise ValueError("no column to profile")
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 *[e.alias(n) for n, e in build(i, F.col(f"v{i}")).items()])
        for i, c in enumerate(columns)
    ]
    values = numbers(df, columns)
    if center is not None:
        values = values.select(*[(F.col(f"v{i}") - F.lit(m)).alias(f"v{i}") for i, m in enumerate(center)])
    return values.agg(F.array(*rows).alias("s")).select(F.inline("s"))


# Rows whose medians shift the values of the one-scan moments; they steer rounding, never results.
SHIFT_ROWS = 1000
BASICS = ["count", "missing", "sum", "mean", "min", "max", "range"]


@dataclass
class Facts:
    """What later steps want to know of one frame, gathered in one scan: rows, present values of every column, basic
    figures and power sums around the mean of numeric ones, sketched distinct counts of categorical ones."""
    rows: int
    present: dict[str, int]
    basics: dict[str, tuple]
    powers: dict[str, tuple]
    rough: dict[str, int]
    exact: dict[str, int] = field(default_factory=dict)
    # The table of distinct values (`quantiles.ValueTable`), once a step has made it.
    values: object = None

    def profile(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return df.sparkSession.createDataFrame([(i, c, *self.basics[c]) for i, c in enumerate(columns)], PROFILE_SCHEMA)

    def power_sums(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return df.sparkSession.createDataFrame([(i, c, *self.powers[c]) for i, c in enumerate(columns)],
                                               "position int, column string, s1 double, s2 double, s3 double, s4 double")


def known_facts(df: DataFrame, columns: Sequence[str] = ()) -> Facts | None:
    """Facts that a frame carries, if they cover these numeric columns."""
    facts = df.__dict__.get("_facts")
    return facts if facts is not None and all(c in facts.basics for c in columns) else None


def gather_facts(df: DataFrame) -> Facts:
    """One scan over all columns, after a look at a few rows."""
    numeric, categorical = numeric_columns(df), categorical_columns(df)
    values = number_columns(df, numeric)
    shifts = [0.0] * len(numeric)
    if numeric:
        first = df.select(*values).limit(SHIFT_ROWS).toPandas().astype(float).median()
        shifts = [0.0 if m != m else float(m) for m in first]
    wide = df.select(*values, *[col(c).alias(f"c{j}") for j, c in enumerate(df.columns) if c not in set(numeric)])
    wide = wide.select("*", *[(F.col(f"v{i}") - F.lit(m)).alias(f"d{i}") for i, m in enumerate(shifts)])
    cells = []
    for i in range(len(numeric)):
        v, d = F.col(f"v{i}"), F.col(f"d{i}")
        cells.append(F.struct(F.count(v).alias("n"), F.sum(v).cast("double").alias("sum"), F.min(v).cast("double").alias("min"),
                              F.max(v).cast("double").alias("max"), F.sum(d).alias("s1"), F.sum(d * d).alias("s2"), F.sum(d * d * d).alias("s3"), F.sum(d * d * d * d).alias("s4")))
    others = [(j, c) for j, c in enumerate(df.columns) if c not in set(numeric)]
    kinds = set(categorical)
    counts = [F.struct(F.count(F.col(f"c{j}")).alias("present"), (F.approx_count_distinct(F.col(f"c{j}"), 0.02) if c in kinds else F.lit(0).cast("bigint")).alias("rough"))
              for j, c in others]
    row = wide.agg(F.count(F.lit(1)).alias("rows"), *([F.array(*cells).alias("numeric")] if cells else []), *([F.array(*counts).alias("others")] if counts else [])).first()
    rows = row["rows"]
    present, basics, powers, rough = {}, {}, {}, {}
    for c, shift, x in zip(numeric, shifts, row["numeric"] if cells else []):
        n, mean = x["n"], (x["sum"] / x["n"] if x["n"] else None)
        present[c] = n
        basics[c] = (n, rows - n, x["sum"], mean, x["min"], x["max"], None if mean is None else x["max"] - x["min"])
        if not n:
            powers[c] = (None,) * 4
            continue
        # The sums move from the shift to the mean.
        m, s1, s2, s3, s4 = mean - shift, x["s1"], x["s2"], x["s3"], x["s4"]
        powers[c] = (s1 - n * m, s2 - 2 * m * s1 + n * m**2, s3 - 3 * m * s2 + 3 * m**2 * s1 - n * m**3,
                     s4 - 4 * m * s3 + 6 * m**2 * s2 - 4 * m**3 * s1 + n * m**4)
    for (_, c), x in zip(others, row["others"] if counts else []):
        present[c] = x["present"]
        if c in kinds:
            rough[c] = x["rough"]
    return Facts(rows, present, basics, powers, rough)


def with_facts(df: DataFrame) -> DataFrame:
    """The frame, carrying its facts: operators that ask this frame object for the same figures read no row for them."""
    df._facts = gather_facts(df)
    return df


def carry_facts(source: DataFrame, df: DataFrame, extra: Sequence[str] = (), less: Sequence[str] = ()) -> DataFrame:
    """`df`, with the facts of `source`, whose rows and columns it holds; `extra` columns are added by a scan of their
    own, `less` are columns that changed."""
    known = known_facts(source)
    if known is None:
        return df
    more = gather_facts(df.select(*[col(c) for c in extra])) if extra else Facts(known.rows, {}, {}, {}, {})
    kept = lambda old, new: {c: v for c, v in old.items() if c not in less} | new
    df._facts = Facts(known.rows, kept(known.present, more.present), kept(known.basics, more.basics), kept(known.powers, more.powers),
                      kept(known.rough, more.rough), kept(known.exact, {}),
                      known.values if known.values is not None and not set(known.values.columns) & {*extra, *less} else None)
    return df


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, moments: bool = True) -> DataFrame:
    """count, missing, sum, mean, min, max, range and, unless switched off, the central moments.

    std and variance use n - 1 and are 0 for one value; skewness and kurtosis are the population forms,
    NULL below 3 and 4 values or on constant input. Moments are sums of powers of (value - mean), with the
    means read first: two light passes are exact and several times faster than one pass of Spark's
    four-moment aggregates, which leave generated code on wide tables.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    facts = known_facts(df, columns)
    if not moments:
        if facts:
            return facts.profile(df, columns)
        return per_column(df, columns, lambda _, v: {
            "count": F.count(v), "missing": F.count(F.lit(1)) - F.count(v), "sum": F.sum(v),
            "mean": F.try_divide(F.sum(v), F.count(v)), "min": F.min(v), "max": F.max(v),
            "range": F.max(v) - F.min(v)})
    known = numeric_profile(df, columns, moments=False).orderBy("position").collect()
    sums = facts.power_sums(df, columns) if facts else per_column(df, columns, lambda _, d: {
        "s1": F.sum(d), "s2": F.sum(d * d), "s3": F.sum(d * d * d), "s4": F.sum(d * d * d * d)},
        center=[r["mean"] or 0.0 for r in known])
    basics = F.broadcast(df.sparkSession.createDataFrame(known, PROFILE_SCHEMA))
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4"))
    varies = F.col("min") < F.col("max")
    # s1 is rounding noise; the corrections remove what it adds.
    table = (
        basics.join(sums.drop("column"), "position")
        .withColumn("n", F.col("count").cast("double"))
        .withColumn("m2", F.when(varies, s2 - s1 * s1 / n).when(n > 0, F.lit(0.0)))
        .withColumn("m3", s3 - 3.0 * s1 * s2 / n + 2.0 * s1 * s1 * s1 / (n * n))
        .withColumn("m4", s4 - 4.0 * s1 * s3 / n + 6.0 * s1 * s1 * s2 / (n * n) - 3.0 * s1 * s1 * s1 * s1 / (n * n * n))
        .withColumn("variance", F.when(n > 1, F.col("m2") / (n - 1)).otherwise(F.col("m2")))
    )
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    return table.select(
        "position", "column", "count", "missing", "sum", "mean", "min", "max", "range",
        F.sqrt("variance").alias("std"), "variance",
        F.when(varies & (n >= 3), F.sqrt(n) * m3 / (m2 * F.sqrt(m2))).alias("skewness"),
        F.when(varies & (n >= 4), n * m4 / (m2 * m2) - 3.0).alias("kurtosis"))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column; NaN and infinities count as missing in floating columns."""
    names = list(df.columns if columns is None else columns)
    facts = known_facts(df)
    if facts and all(c in facts.present for c in names):
        return df.sparkSession.createDataFrame([(i, c, facts.rows - facts.present[c]) for i, c in enumerate(names)],
                                               "position int, column string, missing bigint")
    floating = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("float", "double")}
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 (F.count(F.lit(1)) - F.count(finite(col(c)) if c in floating else col(c))).alias("missing"))
        for i, c in enumerate(names)
    ]
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct present values per column. The exact form is one job whose shuffle is combined per task; columns whose
    exact number the frame's facts hold are not counted again."""
    names = [f for f in (df.columns if columns is None else columns)]
    known = _known_distinct(df) if exact else {}
    measure = F.count_distinct if exact else F.approx_count_distinct
    unknown = [measure(col(c)).alias(f"d{i}") for i, c in enumerate(names) if c not in known]
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                     (F.lit(known[c]).cast("bigint") if c in known else F.col(f"d{i}")).alias("distinct"))
            for i, c in enumerate(names)]
    wide = df.agg(*unknown) if unknown else df.sparkSession.range(1)
    return wide.select(F.inline(F.array(*rows)))


def _known_distinct(df: DataFrame) -> dict[str, int]:
    """Exact distinct counts among a frame's facts. The value table holds finite doubles, so it tells those of columns
    without other values and of whole numbers that doubles keep apart."""
    facts = known_facts(df)
    if not facts:
        return {}
    out = dict(facts.exact)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c, n in zip(facts.values.columns, facts.values.distinct) if facts.values is not None else []:
        low, high = facts.basics[c][4], facts.basics[c][5]
        floating = isinstance(kinds[c], (T.FloatType, T.DoubleType)) and facts.present[c] == facts.rows
        if floating or isinstance(kinds[c], T.IntegralType) and (low is None or max(-low, high) < 2.0**53):
            out[c] = n
    return out


def constant_numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose sample variance is exactly 0: at least two values, all equal."""
    columns = numeric_columns(df)
    if not columns:
        return []
    p = numeric_profile(df, columns, moments=False)
    return [r["column"] for r in p.where("count > 1 AND min = max").select("column").collect()]


def drop_constant_numeric(df: DataFrame) -> DataFrame:
    return df.drop(*constant_numeric_columns(df))


def varying(df: DataFrame, columns: Sequence[str] | None = None) -> list:
    """Profile rows of the numeric columns with more than one distinct value, in order."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return []
    return numeric_profile(df, columns, moments=False).where("min < max").orderBy("position").collect()


def varying_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns with more than one distinct value, in order; all-missing ones fall out too."""
    return [r["column"] for r in varying(df, columns)]


def low_cardinality(df: DataFrame, limit: int, columns: Sequence[str] | None = None) -> dict[str, int]:
    """Categorical columns with at most `limit` distinct values, with their exact counts.

    A sketch removes columns that are far above the limit, so exact counting never touches wide text.
    """
    columns = categorical_columns(df) if columns is None else list(columns)
    if not columns:
        return {}
    facts = known_facts(df)
    if facts and all(c in facts.rough for c in columns):
        rough = facts.rough
    else:
        row = df.agg(*[F.approx_count_distinct(col(c), 0.02).alias(f"d{i}") for i, c in enumerate(columns)]).first()
        rough = {c: row[i] for i, c in enumerate(columns)}
    near = [c for c in columns if rough[c] <= 2 * limit + 10]
    exact = dict(facts.exact) if facts else {}
    unknown = [c for c in near if c not in exact]
    if unknown:
        exact |= {r["column"]: r["distinct"] for r in distinct_counts(df, unknown).collect()}
    if facts:
        facts.exact.update(exact)
    return {c: exact[c] for c in near if exact[c] <= limit}
