"""Type split, missing-value rules, coercion and output formatting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALAR_CATEGORICAL = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
                       T.CharType, T.VarcharType)

CLIP_LIMIT = 1e12
UNKNOWN = "Unknown"

# Date layouts tried, in this order, after the ISO forms.
DATE_LAYOUTS = ["M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d-MMM-yyyy", "MMM d, yyyy", "yyyy/M/d"]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name, dots included."""
    return F.col(quoted(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything scalar that is not a number; nested and binary columns belong to neither class."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _SCALAR_CATEGORICAL)]


def column_classes(df: DataFrame) -> DataFrame:
    """Schema as rows: position, column, type, class."""
    numeric, categorical = set(numeric_columns(df)), set(categorical_columns(df))
    rows = [
        (i, f.name, f.dataType.simpleString(),
         "numeric" if f.name in numeric else "categorical" if f.name in categorical else "other")
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, class string")


def class_fill(df: DataFrame) -> DataFrame:
    """position, column, type, class, filled, rows: the classes with how much of each column is filled; one scan."""
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.count(col(f.name)).alias("filled"), F.count(F.lit(1)).alias("rows"))
                      for f in df.schema.fields])
    return column_classes(df).join(df.agg(cells.alias("s")).select(F.inline("s")), "column").select(
        "position", "column", "type", "class", "filled", "rows")


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def finite(value: Column) -> Column:
    """NULL for NaN and infinities of a floating column."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def finite_frame(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Non-finite values become NULL in all (or the named) floating columns; decimals become double."""
    wanted = set(df.columns if columns is None else columns)
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in wanted and is_floating(f.dataType):
            c = finite(c).alias(f.name)
        elif f.name in wanted and isinstance(f.dataType, T.DecimalType):
            c = c.cast("double").alias(f.name)
        out.append(c)
    return df.select(*out)


def clip(value: Column, lower: float, upper: float) -> Column:
    """Hold a finite value between two bounds; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(lower), F.least(F.lit(upper), value.cast("double"))))


# What counts as a number in text; the cast alone would also take type suffixes such as 1d or 2f.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(value: Column, data_type: T.DataType | None = None) -> Column:
    """Double, or NULL where the value is not a finite number. Whole numbers and doubles, if the type is given, do not
    go through their text, which would give the same value."""
    if isinstance(data_type, T.IntegralType):
        return value.cast("double")
    if isinstance(data_type, T.DoubleType):
        return finite(value)
    text = F.trim(value.cast("string"))
    return finite(F.when(text.rlike(NUMBER), text.try_cast("double")))


def to_time(value: Column, data_type: T.DataType) -> Column:
    """Timestamp, or NULL where the value cannot be read as one. Bare numbers are not dates."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    if not isinstance(data_type, T.StringType):
        return F.lit(None).cast("timestamp")
    text = F.trim(value)
    parsed = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(p)) for p in DATE_LAYOUTS]
    # No layout is longer than this or without a digit; other text is not parsed at all.
    possible = (F.length(text) <= 40) & text.rlike("[0-9]") & ~text.rlike(r"^[+-]?[0-9]+([.][0-9]*)?$")
    return F.when(possible, F.coalesce(*parsed))


def iso_text(value: Column) -> Column:
    """ISO-8601 text; microseconds only when there are any."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("second", value) == value, whole).otherwise(
        F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def iso_frame(df: DataFrame) -> DataFrame:
    """Timestamps and dates as ISO text."""
    times = [f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    return df.withColumns({c: iso_text(col(c).cast("timestamp")) for c in times}) if times else df


def coerce_numeric_columns(df: DataFrame) -> DataFrame:
    """Turn every text column holding at least one number into a double column; keep the others."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    seen = df.agg(*[F.count(to_number(col(c))).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    convert = {c: to_number(col(c)) for i, c in enumerate(texts) if seen[i] > 0}
    return df.withColumns(convert) if convert else df


def kpi_value(value: Column) -> Column:
    """Finite value rounded to 6 places, else NULL."""
    return F.round(finite(value.cast("double")), 6)


def plain_number(value: Column) -> Column:
    """Shortest plain decimal text: `12.5`, `3.0`."""
    return F.regexp_replace(
        F.round(value, 6).cast("decimal(38,6)").cast("string"), r"(\.[0-9]+?)0+$", "$1")


def kpi_text(value: Column) -> Column:
    """Whole values below 1e15 without a fraction, others as plain decimals."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(plain_number(value))


def compact_number(value: Column) -> Column:
    """1234567 -> `1.23M`: 2 places for B and M, 1 for K, whole numbers plain, 2 places otherwise.

    Exact binary halves round away from zero; they are nudged up because the formatter rounds them to even.
    """
    v = value.cast("double")
    size = F.abs(v)

    def fixed(x: Column, places: int) -> Column:
        half = F.pmod(x * F.lit(4.0 if places == 1 else 8.0), F.lit(2.0)) == 1.0
        return F.regexp_replace(F.format_number(F.when(half, x + 1e-7).otherwise(x), places), ",", "")

    sign = F.when(v < 0, "-").otherwise("")
    return (
        F.when(v.isNull(), None)
        .when(size >= 1e9, F.concat(sign, fixed(size / 1e9, 2), F.lit("B")))
        .when(size >= 1e6, F.concat(sign, fixed(size / 1e6, 2), F.lit("M")))
        .when(size >= 1e3, F.concat(sign, fixed(size / 1e3, 1), F.lit("K")))
        .when(v == F.floor(v), v.cast("bigint").cast("string"))
        .otherwise(F.concat(sign, fixed(size, 2)))
    )
