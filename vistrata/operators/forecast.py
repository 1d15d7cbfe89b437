"""Additive trend-and-seasonality forecasts (model family of Taylor & Letham 2018), fitted in Spark.

y is a piecewise linear trend plus Fourier seasonality. Raw rows are first reduced to one weighted row per
series and time; the normal equations of all series are added up in one pass over these rows, in the order of
series and time, and solved one small matrix per series inside the tasks. The number of jobs does not depend on
the number of series, and a series of any length may span tasks. Priors enter as feature scales, so one ridge
penalty gives each group of terms its own strength.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vistrata.functions.columns import col, finite
from vistrata.session import stage

# Fixed values of the model.
HORIZON_DAYS = 30
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
SLOPE_PRIOR = 5.0
CHANGE_PRIOR = 0.05
SEASON_PRIOR = 10.0
INTERVAL_Z = 1.2815515655446004  # 80 % two-sided
DAY = 86_400.0
# name, period in days, Fourier order, shortest history in days, spacing must be below (days)
SEASONS = [
    ("yearly", 365.25, 10, 730.0, math.inf),
    ("weekly", 7.0, 3, 14.0, 7.0),
    ("daily", 1.0, 4, 2.0, 1.0),
]


def _seconds(ds: Column) -> Column:
    return F.unix_micros(ds) / F.lit(1e6)


def _spacing(history: DataFrame) -> DataFrame:
    """Smallest step between neighbouring times per series: exact above a day, else just below one.

    Works on one row per calendar day, so its window is bounded by the length of the calendar.
    """
    days = history.groupBy("series", F.to_date("ds").alias("day")).agg(
        F.min(_seconds(F.col("ds"))).alias("first"), F.max(_seconds(F.col("ds"))).alias("last"))
    order = Window.partitionBy("series").orderBy("day")
    step = F.least(F.col("first") - F.lag("last").over(order),
                   F.when(F.col("first") < F.col("last"), F.lit(DAY / 2)))
    return days.select("series", step.alias("step")).groupBy("series").agg(
        (F.min("step") / DAY).alias("spacing_days"))


# What a series' fit must know beforehand, one row per series.
FACTS = ["start", "end", "n", "times", "scale", "within", "spacing_days"]
RESULTS = ["yhat", "half", "trend"]


def _seasons(fact: dict) -> list:
    span, spacing = (fact["end"] - fact["start"]) / DAY, fact["spacing_days"]
    return [s for s in SEASONS if span >= s[3] and (math.inf if spacing is None else spacing) < s[4]]


def _changes(fact: dict) -> int:
    return min(CHANGEPOINTS, max(1, int(fact["times"] * CHANGEPOINT_RANGE) - 1))


def _terms(sec: np.ndarray, fact: dict) -> np.ndarray:
    """One, scaled slope, hinges and Fourier pairs of each time; priors are the scales."""
    t = (sec - fact["start"]) / (fact["end"] - fact["start"])
    changes = _changes(fact)
    hinges = CHANGEPOINT_RANGE * np.arange(1, changes + 1) / changes
    out = [np.ones((len(t), 1)), t[:, None] * SLOPE_PRIOR, np.maximum(t[:, None] - hinges, 0.0) * CHANGE_PRIOR]
    for _, period, order, _, _ in _seasons(fact):
        angle = sec[:, None] * (2.0 * math.pi * np.arange(1, order + 1) / period / DAY)
        out += [np.sin(angle) * SEASON_PRIOR, np.cos(angle) * SEASON_PRIOR]
    return np.concatenate(out, 1)


def _sums(sec: np.ndarray, label: np.ndarray, w: np.ndarray, fact: dict) -> np.ndarray:
    """Weighted products of all terms and the label with each other: everything the fit needs, and additive."""
    rows = np.concatenate((_terms(sec, fact), (label / (fact["scale"] or 1.0))[:, None]), 1)
    return (rows * w[:, None]).T @ rows


def _ridge(sums: np.ndarray, columns: np.ndarray, penalty: float) -> tuple[float, np.ndarray, float]:
    """Intercept, coefficients and mean squared error of the terms in `columns`; the intercept is free."""
    total, last = sums[0, 0], sums.shape[0] - 1
    mean, centre = sums[0, columns] / total, sums[0, last] / total
    xx = sums[np.ix_(columns, columns)] / total - np.outer(mean, mean)
    xy = sums[columns, last] / total - mean * centre
    yy = sums[last, last] / total - centre * centre
    b = np.linalg.solve(xx + penalty * np.eye(len(columns)), xy)
    return float(centre - mean @ b), b, max(float(yy - 2.0 * b @ xy + b @ xx @ b), 0.0)


def _solved(sums: np.ndarray, fact: dict, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """yhat, half the interval, and trend of the next daily steps."""
    changes, n, scale = _changes(fact), fact["n"], fact["scale"] or 1.0
    every = np.arange(1, sums.shape[0] - 1)
    # The noise level sets the penalty; a fit without changepoints measures it.
    within = max(fact["within"], 0.0) / n / scale**2
    _, _, rough = _ridge(sums, np.concatenate((every[:1], every[1 + changes:])), 1e-9)
    intercept, b, left = _ridge(sums, every, max((rough + within) / n, 1e-10))
    noise = left + within
    # Future slope changes keep the rate and mean size of the past ones; their variance grows with h^3.
    size = float(np.abs(b[1:1 + changes]).mean()) * CHANGE_PRIOR
    sec = fact["end"] + DAY * np.arange(1, horizon + 1)
    terms = _terms(sec, fact)[:, 1:]
    h = (sec - fact["end"]) / (fact["end"] - fact["start"])
    half = np.sqrt(noise + h**3 * (2.0 * changes * size * size / 3.0)) * INTERVAL_Z * scale
    return (intercept + terms @ b) * scale, half, (intercept + terms[:, :1 + changes] @ b[:1 + changes]) * scale


def _stretches(series: pa.Array) -> list[tuple[int, int]]:
    """Bounds of runs of equal neighbours."""
    codes = series.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(codes)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)]))


def _finished(rows: Iterator[tuple], horizon: int) -> Iterator[pa.RecordBatch]:
    """(series, last, fact, seen, sums) -> batches with the figures of each series seen whole and the sums of others."""
    def batch(part: list[tuple]) -> pa.RecordBatch:
        made = [_solved(sums, fact, horizon) if seen == fact["times"] else None for _, _, fact, seen, sums in part]
        cells = [pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.timestamp("us", "UTC"))]
        cells += [pa.array([r[2][c] for r in part], pa.float64()) for c in FACTS]
        cells += [pa.array([float(r[3]) for r in part]), pa.array([None if m else r[4].tobytes() for r, m in zip(part, made)], pa.binary())]
        cells += [pa.array([m[k] if m else None for m in made], pa.list_(pa.float64())) for k in range(len(RESULTS))]
        return pa.RecordBatch.from_arrays(cells, names=["series", "last", *FACTS, "seen", "sums", *RESULTS])

    part = []
    for row in rows:
        part.append(row)
        if len(part) == 200:
            yield batch(part)
            part = []
    if part:
        yield batch(part)


def _added(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Neighbouring parts of one series as one."""
    now = None
    for name, last, fact, seen, sums in parts:
        if now is not None and now[0] == name:
            now = (name, last, fact, now[3] + seen, now[4] + sums)
        else:
            if now is not None:
                yield now
            now = (name, last, fact, seen, sums)
    if now is not None:
        yield now


def _facts_at(batch: pa.RecordBatch, i: int) -> dict:
    return {c: batch.column(c)[i].as_py() for c in FACTS}


def _fitted(history: DataFrame, horizon: int) -> DataFrame:
    """One row per series: `series`, `last` and arrays of the forecast's figures.

    Rows stand in the order of series and time over all partitions. A task adds up the sums of its series, solves
    those it has seen whole, and hands on the sums of the others - at most its first and its last series.
    """
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            sec, mean, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sec", "mean", "w"))
            for a, b in _stretches(batch.column("series")):
                fact = _facts_at(batch, a)
                yield batch.column("series")[a].as_py(), batch.column("last")[a].as_py(), fact, b - a, _sums(sec[a:b], mean[a:b], w[a:b], fact)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                sums = np.frombuffer(batch.column("sums")[i].as_py())
                yield (batch.column("series")[i].as_py(), batch.column("last")[i].as_py(), _facts_at(batch, i),
                       batch.column("seen")[i].as_py(), sums.reshape(math.isqrt(len(sums)), -1))

    kinds = ", ".join(["series string, last timestamp", *(f"{c} double" for c in (*FACTS, "seen")), "sums binary",
                       *(f"{c} array<double>" for c in RESULTS)])
    ordered = history.repartitionByRange("series", "sec").sortWithinPartitions("series", "sec")
    first = stage(ordered.mapInArrow(lambda b: _finished(_added(parts(b)), horizon), kinds), "fits")
    shared = first.where("sums IS NOT NULL").repartition("series").sortWithinPartitions("series", "seen")
    whole = shared.mapInArrow(lambda b: _finished(_added(rest(b)), horizon), kinds)
    return first.where("sums IS NULL").unionByName(whole).select("series", "last", *RESULTS)


def forecast(series: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """(series, ds, y) history -> series, ds, yhat, yhat_lower, yhat_upper, trend for the next daily steps.

    Series of fewer than two times, or without a name, have no forecast.
    """
    history = stage(series.where("series IS NOT NULL").groupBy("series", "ds").agg(
        F.count("*").cast("double").alias("w"), F.avg("y").alias("mean"), F.sum(F.col("y") * F.col("y")).alias("sq")),
        "history")
    facts = history.groupBy("series").agg(
        F.min(_seconds(F.col("ds"))).alias("start"), F.max(_seconds(F.col("ds"))).alias("end"),
        F.max("ds").cast("timestamp").alias("last"), F.sum("w").alias("n"), F.count("*").cast("double").alias("times"),
        F.max(F.abs("mean")).alias("scale"),
        F.sum(F.col("sq") - F.col("w") * F.col("mean") * F.col("mean")).alias("within"))
    facts = facts.where("times >= 2").join(_spacing(history), "series", "left")
    rows = history.join(facts, "series").select("series", "last", *FACTS, _seconds(F.col("ds")).alias("sec"), "mean", "w")
    made = _fitted(rows, horizon).select("series", "last", F.posexplode(F.arrays_zip(*RESULTS)).alias("step", "made"))
    yhat, half = F.col("made.yhat"), F.col("made.half")
    return made.select("series", (F.col("last") + F.make_dt_interval(F.col("step") + 1)).cast(series.schema["ds"].dataType).alias("ds"),
                       yhat.alias("yhat"), (yhat - half).alias("yhat_lower"), (yhat + half).alias("yhat_upper"),
                       F.col("made.trend").alias("trend"))


def collect_forecasts(forecasts: DataFrame, keep: int = 60) -> DataFrame:
    """Last rows of each series with the shown columns, 4 places, non-finite values missing."""
    from vistrata.operators.preview import tail_per_series

    shown = ["yhat", "yhat_lower", "yhat_upper", "trend"]
    return tail_per_series(forecasts, "series", "ds", keep).select(
        "series", "ds", *[F.round(finite(col(c).cast("double")), 4).alias(c) for c in shown if c in forecasts.columns])


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """series, last_forecast, trend_pct from first to last value, uncertainty: half of the last interval."""
    first, last = F.min_by("yhat", "ds"), F.max_by("yhat", "ds")
    width = F.max_by(F.col("yhat_upper") - F.col("yhat_lower"), F.col("ds"))
    return forecasts.groupBy("series").agg(
        last.alias("last_forecast"),
        F.when(first == 0, F.lit(0.0)).otherwise((last - first) / F.abs(first) * 100).alias("trend_pct"),
        (width / 2).alias("uncertainty"))
