"""Cleaning: finite values, clipping, constants, duplicates, filling and IQR capping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrata.functions.columns import (
    CLIP_LIMIT, UNKNOWN, clip, col, finite, finite_frame, numeric_columns)
from vistrata.operators.profile import missing_counts, numeric_profile
from vistrata.operators.quantiles import percentile_dict
from vistrata.session import stage

# Fixed value: fences lie this many interquartile ranges outside the quartiles.
FENCE = 1.5

MODEL_PREFIX = "_model_"
# Repeated fingerprints that are broadcast (16 bytes each).
PRINTS_BROADCAST = 1_000_000

REPORT_SCHEMA = "position int, step string, column string, n bigint, line string"


@dataclass
class Cleaned:
    frame: DataFrame
    report: DataFrame


def clip_numeric(df: DataFrame, columns: Sequence[str] | None = None, limit: float = CLIP_LIMIT) -> DataFrame:
    """Hold numeric columns to +-limit; types narrower than the limit pass unchanged."""
    wanted = numeric_columns(df) if columns is None else list(columns)
    out = {}
    for f in df.schema.fields:
        if f.name not in wanted:
            continue
        if isinstance(f.dataType, T.LongType):
            bound = int(limit)
            out[f.name] = F.when(col(f.name).isNotNull(), F.greatest(
                F.lit(-bound).cast("bigint"), F.least(F.lit(bound).cast("bigint"), col(f.name))))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = clip(col(f.name), -limit, limit)
    return df.withColumns(out) if out else df


def _exact(kind: T.DataType) -> bool:
    """Whether equal values of a type always have equal bytes; floats in nested values do not."""
    if isinstance(kind, T.StructType):
        return all(_exact(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _exact(kind.elementType)
    return not isinstance(kind, (T.FloatType, T.DoubleType, T.MapType, T.VariantType))


def fingerprint(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row, equal for equal rows."""
    cells = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            # -0.0 equals 0.0, and every NaN is the same.
            cells.append(F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c + F.lit(0.0)))
        elif _exact(f.dataType):
            cells.append(c)
    return [F.xxhash64(F.lit(seed), *cells) for seed in (1, 2)]


def without_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows. Maps have no equality in Spark and are compared as JSON.

    Fingerprints are counted first; only rows of repeated fingerprints are shuffled and compared whole, so a collision
    costs nothing but that comparison. The frame is read again for it and has to give the same rows each time.
    """
    maps = {f.name: F.to_json(col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.MapType)}
    plain = df.withColumns(maps) if maps else df
    marked = plain.select("*", *[h.alias(f"_print{i}") for i, h in enumerate(fingerprint(plain))])
    keys = ["_print0", "_print1"]
    repeated = stage(marked.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "repeated")
    found = repeated.count()
    if not found:
        return plain
    # Beyond the limit Spark joins by shuffle.
    sought = F.broadcast(repeated) if found <= PRINTS_BROADCAST else repeated
    twice = marked.join(sought, keys, "left_semi").select(*[col(c) for c in plain.columns]).dropDuplicates()
    return marked.join(sought, keys, "left_anti").select(*[col(c) for c in plain.columns]).unionByName(twice)


def fill_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become the column median; a column without values stays missing."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return df
    facts = numeric_profile(df, columns, moments=False).collect()
    medians = percentile_dict(df, [r["column"] for r in facts if r["missing"] > 0], [0.5])
    fills = {c: F.coalesce(col(c).cast("double"), F.lit(medians[c][0])) if c in medians else col(c).cast("double")
             for c in columns}
    return df.withColumns(fills)


def fill_text(df: DataFrame) -> DataFrame:
    """Missing text becomes `Unknown`; booleans and times have no such value and stay missing."""
    texts = {f.name: F.coalesce(col(f.name), F.lit(UNKNOWN)) for f in df.schema.fields
             if isinstance(f.dataType, T.StringType)}
    return df.withColumns(texts) if texts else df


def iqr_fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    fences = {}
    for c, (q1, q3) in percentile_dict(df, columns, [0.25, 0.75]).items():
        fences[c] = (q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))
    return fences


def cap_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Hold numeric columns to their IQR fences; capped columns are double."""
    columns = numeric_columns(df) if columns is None else list(columns)
    fences = iqr_fences(df, columns)
    caps = {c: clip(col(c), *fences[c]) for c in columns if c in fences}
    return df.withColumns(caps) if caps else df


def impute_for_model(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with one filled, finite model column per varying numeric column, and those columns' names.

    A column without two different values carries no information and gets no model column.
    """
    names = numeric_columns(df)
    facts = numeric_profile(df, names, moments=False).where("min < max").orderBy("position").collect() if names else []
    features = [r["column"] for r in facts]
    # Only columns with gaps need a median.
    medians = percentile_dict(df, [r["column"] for r in facts if r["missing"] > 0], [0.5])
    inputs = {}
    for c in features:
        v = col(c).cast("double")
        inputs[f"{MODEL_PREFIX}{c}"] = F.coalesce(finite(v), F.lit(medians[c][0])) if c in medians else v
    return df.withColumns(inputs) if inputs else df, features


def clean(df: DataFrame, exclude: Sequence[str] = ()) -> Cleaned:
    """Finite values, clip, drop constants, drop duplicates, fill, cap; with a report of what changed.

    Cleaned numeric columns are always double, so the schema does not depend on the data; `exclude` names
    numeric columns (keys) that keep their values. The deduplicated frame is staged once, and every later
    pass reads only the columns it needs.
    """
    spark = df.sparkSession
    measured = [c for c in numeric_columns(df) if c not in exclude]
    source = clip_numeric(finite_frame(df), measured)
    facts = numeric_profile(source, moments=False).collect() if numeric_columns(source) else []
    constants = [r["column"] for r in facts if r["count"] > 1 and r["min"] == r["max"] and r["column"] not in exclude]
    before = facts[0]["count"] + facts[0]["missing"] if facts else df.count()
    source = source.drop(*constants)
    measured = [c for c in measured if c not in constants]

    frame = stage(without_duplicates(source), "clean")
    after = frame.count()
    lines = [("drop_constant", c, 1, f"Dropped constant column {c}") for c in constants]
    lines.append(("duplicates", None, before - after, f"Duplicates removed: {before - after}"))

    missing = {r["column"]: r["missing"] for r in missing_counts(frame).collect() if r["missing"] > 0}
    levels = percentile_dict(frame, measured, [0.25, 0.5, 0.75])
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    fills, refilled = {}, []
    for c, n in missing.items():
        if c in measured:
            if c in levels:
                fills[c] = F.coalesce(col(c).cast("double"), F.lit(levels[c][1]))
                refilled.append(c)
            lines.append(("fill_median", c, n if c in levels else 0, f"Filled missing values in {c} using median"))
        elif isinstance(kinds[c], T.StringType):
            fills[c] = F.coalesce(col(c), F.lit(UNKNOWN))
            lines.append(("fill_unknown", c, n, f"Filled missing values in {c} with '{UNKNOWN}'"))
        else:
            lines.append(("left_missing", c, n, f"Left {n} missing values in {c}"))
    filled = frame.withColumns(fills) if fills else frame

    # Filling moves the quartiles of the filled columns only.
    quartiles = {c: (v[0], v[2]) for c, v in levels.items()}
    quartiles.update({c: tuple(v) for c, v in percentile_dict(filled, refilled, [0.25, 0.75]).items()})
    fences = {c: (q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)) for c, (q1, q3) in quartiles.items()}
    if fences:
        names = list(fences)
        outside = filled.agg(*[
            F.count_if((col(c) < fences[c][0]) | (col(c) > fences[c][1])).alias(f"o{i}")
            for i, c in enumerate(names)]).first()
        lines += [("cap", c, outside[i], f"Capped {outside[i]} outliers in column {c}")
                  for i, c in enumerate(names) if outside[i] > 0]
    numbers = {c: clip(col(c), *fences[c]) if c in fences else col(c).cast("double") for c in measured}
    result = filled.withColumns(numbers) if numbers else filled
    report = spark.createDataFrame([(i, *line) for i, line in enumerate(lines)], REPORT_SCHEMA)
    return Cleaned(result, report)
