"""Anomalies, series and forecasts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistrata.catalog.aggregates import rounded
from vistrata.catalog.base import query
from vistrata.catalog.columns import messy
from vistrata.functions.columns import col
from vistrata.operators import forecast, isolation, sampling, series, statistics
from vistrata.plans import charts
from vistrata.plans.dashboard import dashboard

ITEMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def items(table):
    return table("lineitem").select("l_orderkey", "l_linenumber", *ITEMS)


@query("isolation_forest_nodes")
def _(spark, table):
    """Grown trees; no SQL form."""
    return isolation.fit(table("lineitem"), ITEMS).nodes


@query("isolation_forest_scores")
def _(spark, table):
    """Score and label of every row; no SQL form."""
    return isolation.detect(items(table)).scored


@query("anomalies")
def _(spark, table):
    """Flagged rows, missing and infinite values included; no SQL form."""
    return isolation.detect(messy(table("orders"))).anomalies


@query("anomaly_sample")
def _(spark, table):
    """The ten most isolated rows; no SQL form."""
    return isolation.anomaly_sample(isolation.detect(items(table)))


@query("anomaly_scatter")
def _(spark, table):
    """Normal and flagged points of the first two numeric columns; no SQL form."""
    made = charts.anomaly_scatter(isolation.detect(table("lineitem").select(*ITEMS)).labelled)
    return made["normal"].unionByName(made["anomaly"])


@query("forest_sample_weights", """SELECT k, true AS weighs FROM (VALUES (25599), (25600), (25601)) AS t(k)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def _(spark, table):
    """Share of a third of equal rows in samples on both sides of a size: within three points of a third."""
    size = 25_600
    rows = table("lineitem").crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "copy")))
    v = F.xxhash64("l_orderkey", "l_linenumber", "copy")
    rows = rows.select(F.when(F.pmod(v, F.lit(3)) == 0, F.lit(0)).otherwise(v).alias("v"))
    parts = []
    for k in (size - 1, size, size + 1):
        sample, n = sampling.drawn_rows(rows, ["v"], lambda n, k=k: [(0, p) for p in random.Random(k).sample(range(n), min(n, k))])
        share = F.avg((F.col("v") == 0).cast("int"))
        parts.append(sample.agg((F.abs(share - 1 / 3) < 0.03).alias("weighs")).select(F.lit(k).alias("k"), "weighs"))
    return parts[0].union(parts[1]).union(parts[2])


# The rule itself on given labels: the dearest items stand for flagged rows.
@query("anomaly_rows", "SELECT l_orderkey, l_linenumber, -1 AS anomaly FROM lineitem WHERE l_extendedprice > 100000")
def _(spark, table):
    label = F.when(F.col("l_extendedprice") > 100000, -1).otherwise(1)
    return isolation.anomaly_rows(table("lineitem").select("l_orderkey", "l_linenumber", label.alias("anomaly")))


@query("anomaly_overview", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}), 2) AS mean, round(min({c}), 4)::DOUBLE AS min, round(max({c}), 4)::DOUBLE AS max, round(stddev_samp({c}), 2) AS std
FROM lineitem WHERE l_extendedprice > 100000""" for c in ["l_orderkey", "l_linenumber", *ITEMS]))
def _(spark, table):
    out = isolation.anomaly_overview(items(table).where("l_extendedprice > 100000")).drop("position")
    return rounded(out, 2, "mean", "std")


@query("time_scores", """
SELECT 'event_id' AS "column", 0::BIGINT AS score UNION ALL SELECT 'user_id', 0 UNION ALL SELECT 'value', 0
UNION ALL SELECT 'props', 0 UNION ALL SELECT 'event_type', 0 UNION ALL SELECT 'ts', count(ts) FROM events""")
def _(spark, table):
    return series.time_scores(table("events"))


@query("time_column", "SELECT 'o_orderdate' AS time_column FROM orders HAVING count(o_orderdate) > 0")
def _(spark, table):
    df = table("orders")
    return spark.createDataFrame([(series.detect_time_column(df),)], "time_column string")


@query("forecast_metrics", """SELECT unnest(['value', 'user_id', 'event_id']) AS metric, unnest([1, 2, 3]) AS place
FROM (SELECT 1 FROM events HAVING count(value) >= 10)""")
def _(spark, table):
    df = table("events")
    names = series.detect_metrics(df, series.detect_time_column(df))
    return spark.createDataFrame([(m, i) for i, m in enumerate(names, 1)], "metric string, place int")


@query("prepared_series", """
WITH q AS (SELECT quantile_cont(value, 0.01) a, quantile_cont(value, 0.99) b, quantile_cont(user_id, 0.01) c, quantile_cont(user_id, 0.99) d FROM events)
SELECT 'value' AS series, epoch_us(ts) AS ds, value AS y FROM events, q WHERE value BETWEEN a AND b
UNION ALL SELECT 'user_id', epoch_us(ts), user_id::DOUBLE FROM events, q WHERE user_id BETWEEN c AND d""")
def _(spark, table):
    out = series.prepare_series(table("events"), "ts", ["value", "user_id", "event_type", "no_such"])
    return out.select("series", F.unix_micros("ds").alias("ds"), "y")


@query("forecast")
def _(spark, table):
    """Thirty daily steps of each event metric; fitted, so no SQL form."""
    events = table("events")
    time_column = series.detect_time_column(events)
    return forecast.forecast(series.prepare_series(events, time_column, series.detect_metrics(events, time_column)))


@query("forecast_daily_orders")
def _(spark, table):
    """Thirty daily steps of the order values; fitted, so no SQL form."""
    return forecast.forecast(series.prepare_series(table("orders"), "o_orderdate", ["o_totalprice"]))


# Collection and summary rules, checked on daily figures that stand for forecasts.
MADE = """made AS (SELECT o_orderpriority AS series, date_trunc('day', o_orderdate) AS ds, sum(o_totalprice) AS yhat,
  min(o_totalprice) AS yhat_lower, max(o_totalprice) AS yhat_upper, CASE WHEN count(*) > 1 THEN sum(o_totalprice) ELSE 'Infinity'::DOUBLE END AS trend
  FROM orders GROUP BY 1, 2)"""


def made(orders):
    price = F.col("o_totalprice")
    return orders.groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("day", "o_orderdate").alias("ds")).agg(
        F.sum(price).alias("yhat"), F.min(price).alias("yhat_lower"), F.max(price).alias("yhat_upper"),
        F.when(F.count("*") > 1, F.sum(price)).otherwise(float("inf")).alias("trend"))


@query("collect_forecasts", f"""WITH {MADE}
SELECT series, strftime(ds, '%Y-%m-%d') AS ds, round(yhat, 2) AS yhat, round(yhat_lower, 4) AS yhat_lower, round(yhat_upper, 4) AS yhat_upper,
CASE WHEN isfinite(trend) THEN round(trend, 2) END AS trend FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS r FROM made) WHERE r <= 60""")
def _(spark, table):
    out = forecast.collect_forecasts(made(table("orders")))
    return rounded(out.withColumn("ds", F.date_format("ds", "yyyy-MM-dd")), 2, "yhat", "trend")


@query("forecast_summary", f"""WITH {MADE}
SELECT series, round(arg_max(yhat, ds), 2) AS last_forecast, round((arg_max(yhat, ds) - arg_min(yhat, ds)) / abs(arg_min(yhat, ds)) * 100, 2) AS trend_pct,
round(arg_max(yhat_upper - yhat_lower, ds) / 2, 2) AS uncertainty FROM made GROUP BY 1""")
def _(spark, table):
    return rounded(forecast.forecast_summary(made(table("orders"))), 2, "last_forecast", "trend_pct", "uncertainty")


def checked(frames: dict) -> DataFrame:
    """part, rows, checksum of every frame: all of its cells are computed."""
    out = None
    for name, frame in frames.items():
        one = frame.select(F.xxhash64(F.to_json(F.struct(*[col(c) for c in frame.columns]))).cast("decimal(38,0)").alias("h")).agg(
            F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("checksum")).select(F.lit(name).alias("part"), "rows", "checksum")
        out = one if out is None else out.unionByName(one)
    return out


KEYS = ["o_orderkey", "o_custkey"]


@query("dashboard")
def _(spark, table):
    """The whole analysis of the orders: rows and checksum of every frame. No SQL form."""
    return checked(dashboard(table("orders"), exclude=KEYS).frames())


def preview_rows(n: str, shown: int) -> str:
    return f"CASE WHEN {n} <= {shown} THEN {n} ELSE 24 END"


DASHBOARD_ROWS = [
    ("cleaned", "n"), ("kpis", "2 * 3 + 2"), ("summary.shape", "1"), ("summary.columns", "6"), ("summary.numeric_statistics", "3"), ("labelled", "n"),
    ("summary.categorical_statistics", "3"), ("charts.histograms.bins", "3 * bins"), ("charts.histograms.statistics", "3"),
    ("charts.correlation.matrix", "9"), ("charts.correlation.statistics", "3"), ("charts.scatters.association", "2"), ("charts.scatters.rank_correlation", "2"),
    ("charts.scatters.points_o_orderkey_o_custkey", preview_rows("n", 120)), ("charts.scatters.points_o_custkey_o_totalprice", preview_rows("n", 120)),
    ("charts.bars.points", "states + priorities"), ("charts.pies.points", "states + priorities"), ("charts.bars.summary", "2"), ("charts.pies.summary", "2"),
    ("charts.group_means.avg_o_totalprice_by_o_orderstatus.points", "states"), ("charts.group_means.avg_o_totalprice_by_o_orderpriority.points", "priorities"),
    ("charts.group_means.avg_o_totalprice_by_o_orderstatus.per_group_detail", "states"), ("profile.columns", "7"), ("profile.shape", "1"), ("forecasts", "3 * 30"),
    ("anomalies.sample", "10")]


@query("dashboard_rows", """WITH f AS (SELECT count(*) AS n, least(30, greatest(5, floor(sqrt(count(*)))::BIGINT)) AS bins,
 count(DISTINCT o_orderstatus) AS states, count(DISTINCT o_orderpriority) AS priorities FROM orders) """ + " UNION ALL ".join(
    f"SELECT '{name}' AS part, ({rows})::BIGINT AS \"rows\" FROM f" for name, rows in DASHBOARD_ROWS))
def _(spark, table):
    """How many rows the parts of the analysis have whose size follows from counts."""
    frames = dashboard(table("orders"), exclude=KEYS).frames()
    out = None
    for name, _ in DASHBOARD_ROWS:
        one = frames[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("forecast_line", """SELECT o_orderpriority AS series, strftime(max(o_orderdate)::DATE + i::INT, '%Y-%m-%d') AS ds, true AS on_the_line, true AS inside
FROM orders, range(1, 31) r(i) GROUP BY 1, i""")
def _(spark, table):
    """A straight line over each priority's order days goes on as the same line, inside its bounds."""
    day = F.unix_date(F.to_date("o_orderdate"))
    line = lambda d: d * 2.5 + 40
    history = table("orders").select(F.col("o_orderpriority").alias("series"), F.date_trunc("day", "o_orderdate").alias("ds"), line(day).alias("y")).distinct()
    out = forecast.forecast(history)
    true = line(F.unix_date(F.to_date("ds")))
    return out.select("series", F.date_format("ds", "yyyy-MM-dd").alias("ds"), (F.abs(F.col("yhat") / true - 1) < 0.01).alias("on_the_line"),
                      ((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("inside"))


@query("forecast_line_by_customer", """SELECT o_custkey::VARCHAR AS series, strftime(DATE '2024-01-01' + (n + i)::INT, '%Y-%m-%d') AS ds, true AS on_the_line, true AS inside
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), range(1, 31) r(i) WHERE n >= 2""")
def _(spark, table):
    """Each customer's orders, one a day, on a line of the customer's own; it goes on for all with two orders or more."""
    key = F.col("o_custkey")
    line = lambda d, k: d * (1 + k % 7) + 100 * (1 + k % 5)
    day = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    start = F.unix_date(F.lit("2024-01-01").cast("date"))
    history = table("orders").select(key.cast("string").alias("series"), F.date_from_unix_date(start + day).cast("timestamp").alias("ds"),
                                     line(day, key).cast("double").alias("y"))
    out = forecast.forecast(history)
    true = line(F.unix_date(F.to_date("ds")) - start, F.col("series").cast("bigint"))
    return out.select("series", F.date_format("ds", "yyyy-MM-dd").alias("ds"), (F.abs(F.col("yhat") / true - 1) < 0.01).alias("on_the_line"),
                      ((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("inside"))


@query("forest_planted", """SELECT o_orderkey % 50 = 0 AS planted, count(*) AS rows, true AS as_expected FROM orders GROUP BY 1""")
def _(spark, table):
    """Rows moved far from the others are flagged, nearly all others are not; every row has a score in (0, 1)."""
    planted = F.col("o_orderkey") % 50 == 0
    spread = lambda seed: (F.pmod(F.xxhash64("o_orderkey", F.lit(seed)), F.lit(1000)) / 1000)
    far = F.when(planted, 30 + 9 * spread(3)).otherwise(0)
    rows = table("orders").select(planted.alias("planted"), (spread(1) + far).alias("x"), (spread(2) - far).alias("y"))
    found = isolation.detect(rows).scored
    flagged = F.avg((F.col("anomaly") == -1).cast("int"))
    scored = F.min(F.col("anomaly_score").between(0, 1))
    return found.groupBy("planted").agg(F.count("*").alias("rows"), (
        F.when(F.col("planted"), flagged > 0.99).otherwise(flagged < 0.05) & scored).alias("as_expected"))


@query("normality_tested", """SELECT 'l_quantity' AS "column", count(l_quantity) AS n, least(count(l_quantity), 5000)::BIGINT AS n_tested FROM lineitem
UNION ALL SELECT 's_acctbal', count(s_acctbal), least(count(s_acctbal), 5000)::BIGINT FROM supplier""")
def _(spark, table):
    """How many values the normality test had, above and below its limit."""
    parts = [statistics.normality(table(t), [c]).select("column", "n", "n_tested") for t, c in (("lineitem", "l_quantity"), ("supplier", "s_acctbal"))]
    return parts[0].unionByName(parts[1])


@query("anomaly_header", """SELECT count(*) AS count, 'event_id,ts,value' AS columns, 'event_id,value' AS numeric_columns FROM events WHERE value > 90""")
def _(spark, table):
    """Head of the anomaly list, on given labels."""
    rows = table("events").select("event_id", "ts", "value", F.when(F.col("value") > 90, -1).otherwise(1).alias("anomaly"))
    out = isolation.anomaly_header(isolation.anomaly_rows(rows).drop("anomaly"))
    return out.select("count", *(F.concat_ws(",", c).alias(c) for c in ("columns", "numeric_columns")))
