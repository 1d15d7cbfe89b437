"""One date layout for a whole text column.

A lattice of layouts - orders of day, month and year, separators, month names, clock times, fractions and zones - is
scored for all text columns in one scan. The layout that reads most values of a column holds for the whole column, so a
day-first column is never read month-first where a value happens to allow it. Values of another form are read by the
next layouts in order, but never by one that has day and month the other way round: such values stay unread and are
reported.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrata.functions.columns import col

CLOCK, HALF_DAY = "[ H:mm[:ss[.SSSSSS]]][XXX]", " h:mm[:ss] a"
NUMBER, NAME = "[0-9]{1,2}", "[A-Za-z]{3,9}"


@dataclass(frozen=True)
class Layout:
    """A date pattern, the shape its texts have, and its order of day and month where that is ambiguous."""
    name: str
    shape: str
    order: str = ""

    def read(self, text: Column) -> Column:
        """Timestamp, or NULL where the text has another form."""
        if self.name == "iso":
            value = F.try_to_timestamp(text)
        else:
            value = F.when(text.rlike("(?i)[ap]m$"), F.try_to_timestamp(F.upper(text) if "MMM" not in self.name else text, F.lit(self.name + HALF_DAY))).otherwise(
                F.try_to_timestamp(text, F.lit(self.name + CLOCK)))
        return F.when(text.rlike(self.shape), value)


def _lattice() -> list[Layout]:
    """All layouts; of two that read equally many values the earlier one is taken, so month-first goes before day-first."""
    out = [Layout("iso", "^[0-9]{4}-[0-9]{2}(-|$)")]
    end = "(?![0-9])"
    for sign in "/-.":
        at = "[.]" if sign == "." else sign
        out += [Layout(f"M{sign}d{sign}yyyy", f"^{NUMBER}{at}{NUMBER}{at}[0-9]{{4}}{end}", "month"),
                Layout(f"d{sign}M{sign}yyyy", f"^{NUMBER}{at}{NUMBER}{at}[0-9]{{4}}{end}", "day")]
        if sign != "-":
            out.append(Layout(f"yyyy{sign}M{sign}d", f"^[0-9]{{4}}{at}{NUMBER}{at}{NUMBER}{end}"))
    for month in ("MMM", "MMMM"):
        out += [Layout(f"d-{month}-yyyy", f"^{NUMBER}-{NAME}-[0-9]{{4}}{end}"), Layout(f"d {month} yyyy", f"^{NUMBER} {NAME} [0-9]{{4}}{end}"),
                Layout(f"{month} d, yyyy", f"^{NAME} {NUMBER}, [0-9]{{4}}{end}"), Layout(f"{month} d yyyy", f"^{NAME} {NUMBER} [0-9]{{4}}{end}")]
    return out


LAYOUTS = _lattice()
BY_NAME = {x.name: x for x in LAYOUTS}
# What no layout can read is found by one pattern.
SHAPES = "|".join(x.shape for x in LAYOUTS)


def _text(value: Column) -> Column:
    """Text that may be a date: no layout is longer than this, or without a digit."""
    text = F.trim(value)
    return F.when((F.length(text) <= 40) & text.rlike("[0-9]"), text)


def layout_scores(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, layout, place, read, readable, present of each text column and layout: values the layout reads, values
    any layout reads, and values there are. One scan."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, layout string, place int, read bigint, readable bigint, present bigint")
    cells = F.array(*[F.struct(F.lit(i).alias("ci"), col(c).isNotNull().alias("there"), _text(col(c)).alias("text")) for i, c in enumerate(texts)])
    long = df.select(F.inline(cells))
    bits = [F.when(x.read(F.col("text")).isNotNull(), F.lit(1 << k)).otherwise(0) for k, x in enumerate(LAYOUTS)]
    # Only few sets of layouts ever read one value, so values are counted by the set that reads them.
    mask = F.when(F.col("text").rlike(SHAPES), reduce(Column.bitwiseOR, bits)).otherwise(0).alias("mask")
    counted = long.select("ci", "there", mask).groupBy("ci", "mask").agg(F.count_if("there").alias("present"))
    grid = df.sparkSession.createDataFrame([(i, c, x.name, k, 1 << k) for i, c in enumerate(texts) for k, x in enumerate(LAYOUTS)],
                                           "ci int, column string, layout string, place int, bit int")
    of = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("present"))), F.lit(0)).cast("bigint")
    return F.broadcast(grid).join(counted, "ci", "left").groupBy("column", "layout", "place").agg(
        of(F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("read"), of(F.col("mask") != 0).alias("readable"), of(F.lit(True)).alias("present"))


def chosen_layouts(scores: DataFrame) -> DataFrame:
    """column, layout, read, readable, present: the best layout of each column that any layout reads."""
    best = F.max_by(F.struct("layout", "read"), F.struct("read", -F.col("place")))
    return (scores.where("readable > 0").groupBy("column").agg(best.alias("b"), F.first("readable").alias("readable"), F.first("present").alias("present"))
            .select("column", "b.layout", "b.read", "readable", "present"))


def column_layouts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """Layout of each text column that holds dates; one row per column is read."""
    return {r["column"]: r["layout"] for r in chosen_layouts(layout_scores(df, columns)).collect()}


def read_column(value: Column, layout: str) -> Column:
    """Timestamps of a text column: by its layout, then by the others that do not contradict it."""
    first = BY_NAME[layout]
    # Without an ambiguous order of its own a column may hold month-first values, as single values would be read.
    order = first.order or "month"
    text = _text(value)
    return F.coalesce(*[x.read(text) for x in [first, *LAYOUTS] if x is first or x.order in ("", order)])


def time_values(df: DataFrame, column: str, layout: str | None = None) -> Column:
    """Timestamps of a column of any type; a text column's layout is found first, if it is not given."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col(column).cast("timestamp")
    if isinstance(kind, T.StringType):
        layout = layout or column_layouts(df, [column]).get(column)
        if layout:
            return read_column(col(column), layout)
    return F.lit(None).cast("timestamp")


def dates_read(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The frame with its text columns of dates as timestamps, and a report: column, layout, read (by the layout),
    readable (by any), present. A column counts as one of dates if at least half of its values can be read."""
    report = chosen_layouts(layout_scores(df, columns)).where("2 * readable >= present")
    layouts = {r["column"]: r["layout"] for r in report.collect()}
    return df.withColumns({c: read_column(col(c), x) for c, x in layouts.items()}) if layouts else df, report
