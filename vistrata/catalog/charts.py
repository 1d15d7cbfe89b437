"""Chart-ready frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistrata.catalog.aggregates import AUTO_BINS, PAIRS, bins_sql, each, rounded
from vistrata.catalog.base import query
from vistrata.operators import association
from vistrata.plans import charts


def points_sql(columns: list[str], source: str, limit: int, shown: int) -> str:
    """Top counts with shares of the shown total, for columns within the cardinality limit."""
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", rank::INT AS rank, value, count, round(count / sum(count) OVER () * 100, 4) AS proportion_pct
FROM (SELECT {c} AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {source} GROUP BY 1)
WHERE rank <= {shown} AND (SELECT count(DISTINCT {c}) FROM {source}) <= {limit}""" for c in columns)


PART_TEXT = ["p_name", "p_brand", "p_type"]


@query("chart_histogram_bins", bins_sql("o_totalprice", "orders", AUTO_BINS))
def _(spark, table):
    bins = charts.chart_histograms(table("orders").select("o_totalprice"))["bins"]
    return bins.drop("label")


@query("chart_histogram_statistics", each("""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 2) AS mean,
round(quantile_cont({c}, 0.95), 2)::DOUBLE AS p95 FROM orders""", ["o_totalprice"]))
def _(spark, table):
    out = charts.chart_histograms(table("orders").select("o_totalprice"))["statistics"]
    return rounded(out.select("column", "count", "mean", "p95"), 2, "mean", "p95")


@query("chart_bars", points_sql(PART_TEXT, "part", 20, 15))
def _(spark, table):
    return charts.chart_bars(table("part"))["points"]


@query("chart_pies", points_sql(PART_TEXT, "part", 10, 10))
def _(spark, table):
    return charts.chart_pies(table("part"))["points"]


@query("chart_bar_summary", f"""WITH p AS ({points_sql(PART_TEXT, "part", 20, 15)})
SELECT "column", count(*) AS total_categories, sum(count)::BIGINT AS total_count, arg_min(value, rank) AS dominant_category,
arg_min(proportion_pct, rank) AS dominant_proportion_pct FROM p GROUP BY 1""")
def _(spark, table):
    return charts.chart_bars(table("part"))["summary"]


@query("chart_bar_count_statistics", f"""WITH p AS ({points_sql(PART_TEXT, "part", 20, 15)}), m AS (SELECT "column" AS k, avg(count) AS mu, stddev_pop(count) AS sd FROM p GROUP BY 1)
SELECT "column", count(*) AS n, round(avg(count), 4) AS mean, round(coalesce(stddev_samp(count), 0), 4) AS std, min(count)::DOUBLE AS min, max(count)::DOUBLE AS max,
sum(count)::DOUBLE AS sum, round(quantile_cont(count, 0.25), 4)::DOUBLE AS q1, round(quantile_cont(count, 0.5), 4)::DOUBLE AS median, round(quantile_cont(count, 0.75), 4)::DOUBLE AS q3,
round(quantile_cont(count, 0.75) - quantile_cont(count, 0.25), 4)::DOUBLE AS iqr,
CASE WHEN count(*) >= 3 THEN round(avg(((count - mu) / sd)**3), 8) END AS skewness, CASE WHEN count(*) >= 4 THEN round(avg(((count - mu) / sd)**4) - 3, 8) END AS kurtosis
FROM p JOIN m ON "column" = k GROUP BY 1""")
def _(spark, table):
    out = charts.chart_bars(table("part"))["count_statistics"].select(
        "column", "n", "mean", "std", "min", "max", "sum", "q1", "median", "q3", "iqr", "skewness", "kurtosis")
    return rounded(rounded(out, 4, "mean", "std", "q1", "median", "q3", "iqr"), 8, "skewness", "kurtosis")


@query("scatter_points", """
WITH n AS (SELECT l_quantity AS x, l_extendedprice AS y, row_number() OVER (ORDER BY l_quantity, l_extendedprice) - 1 AS position, count(*) OVER () AS total_points FROM lineitem)
SELECT x, y, position, true AS truncated, total_points, 'Showing 24 of ' || total_points || ' points' AS note FROM n WHERE position < 12 OR position >= total_points - 12""")
def _(spark, table):
    return charts.scatter_points(table("lineitem"), "l_quantity", "l_extendedprice")


@query("chart_scatter_association", " UNION ALL ".join(
    f"SELECT '{x}' AS x_name, '{y}' AS y_name, round(corr({x}, {y}), 6) AS pearson_r, round(regr_slope({y}, {x}), 6) AS slope FROM lineitem" for x, y in PAIRS))
def _(spark, table):
    out = charts.chart_scatters(table("lineitem"))["association"]
    return rounded(out.select("x_name", "y_name", "pearson_r", "slope"), 6, "pearson_r", "slope")


@query("chart_scatter_rank_correlation", """
WITH r AS (SELECT (rank() OVER (ORDER BY p_partkey) + (count(*) OVER (PARTITION BY p_partkey) - 1) / 2) AS a,
 (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2) AS b,
 (rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2) AS c FROM part)
SELECT 'p_partkey' AS x_name, 'p_size' AS y_name, count(*) AS n, round(corr(a, b), 6) AS spearman_r FROM r
UNION ALL SELECT 'p_size', 'p_retailprice', count(*), round(corr(b, c), 6) FROM r""")
def _(spark, table):
    out = charts.chart_scatters(table("part"))["rank_correlation"].drop("spearman_p_value")
    return rounded(out, 6, "spearman_r")


@query("chart_group_means", """
WITH g AS (SELECT l_linestatus AS category, avg(l_quantity) AS mean FROM lineitem GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY mean DESC, category) - 1 AS position, count(*) OVER () AS total_points FROM g)
SELECT category, round(mean, 4) AS mean, position FROM n""")
def _(spark, table):
    made = charts.chart_group_means(table("lineitem"), [("l_linestatus", "l_quantity"), ("no_such", "l_quantity")])
    return rounded(made["avg_l_quantity_by_l_linestatus"]["points"].select("category", "mean", "position"), 4, "mean")


@query("chart_group_detail_default_pairs", " UNION ALL ".join(
    f"""SELECT 'avg_{m}_by_o_orderstatus' AS chart, o_orderstatus AS category, round(avg({m}), 2) AS mean, count({m}) AS count, round(quantile_cont({m}, 0.5), 2)::DOUBLE AS median
FROM orders GROUP BY 2 UNION ALL SELECT 'avg_{m}_by_o_orderpriority', o_orderpriority, round(avg({m}), 2), count({m}), round(quantile_cont({m}, 0.5), 2)::DOUBLE FROM orders GROUP BY 2"""
    for m in ("o_orderkey", "o_custkey", "o_totalprice")))
def _(spark, table):
    out = None
    for name, frames in charts.chart_group_means(table("orders")).items():
        one = frames["per_group_detail"].select(F.lit(name).alias("chart"), "category", "mean", "count", "median")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 2, "mean", "median")


@query("chart_correlation", """
SELECT 's_suppkey' AS row_name, 's_nationkey' AS column_name, round(corr(s_suppkey, s_nationkey), 6) AS r FROM supplier
UNION ALL SELECT 's_nationkey', 's_suppkey', round(corr(s_suppkey, s_nationkey), 6) FROM supplier
UNION ALL SELECT 's_suppkey', 's_acctbal', round(corr(s_suppkey, s_acctbal), 6) FROM supplier
UNION ALL SELECT 's_acctbal', 's_suppkey', round(corr(s_suppkey, s_acctbal), 6) FROM supplier
UNION ALL SELECT 's_nationkey', 's_acctbal', round(corr(s_nationkey, s_acctbal), 6) FROM supplier
UNION ALL SELECT 's_acctbal', 's_nationkey', round(corr(s_nationkey, s_acctbal), 6) FROM supplier
UNION ALL SELECT 's_suppkey', 's_suppkey', 1.0::DOUBLE UNION ALL SELECT 's_nationkey', 's_nationkey', 1.0::DOUBLE
UNION ALL SELECT 's_acctbal', 's_acctbal', 1.0::DOUBLE""")
def _(spark, table):
    return charts.chart_correlation(table("supplier"))["matrix"]


DAILY = "SELECT date_trunc('day', o_orderdate) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1"


def daily(orders):
    return orders.groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))


@query("chart_line_points", f"""WITH d AS ({DAILY}), n AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS position, count(*) OVER () AS total_points FROM d)
SELECT strftime(day, '%Y-%m-%d') AS x, round(total, 2) AS y, position FROM n WHERE total_points <= 120 OR position < 12 OR position >= total_points - 12""")
def _(spark, table):
    points = charts.chart_line(daily(table("orders")), "day", "total")["points"]
    return points.select(F.date_format("x", "yyyy-MM-dd").alias("x"), F.round("y", 2).alias("y"), "position")


@query("chart_line_trend", f"""WITH d AS ({DAILY})
SELECT CASE WHEN arg_max(total, day) > arg_min(total, day) THEN 'increasing' ELSE 'decreasing' END AS trend FROM d""")
def _(spark, table):
    return charts.chart_line(daily(table("orders")), "day", "total")["trend"]


@query("chart_bar_count_spread", f"""WITH p AS ({points_sql(PART_TEXT, "part", 20, 15)}),
q AS (SELECT "column" AS k, quantile_cont(count, 0.25) AS q1, quantile_cont(count, 0.75) AS q3, mode(count ORDER BY count) AS m FROM p GROUP BY 1)
SELECT "column", round(coalesce(var_samp(count), 0), 4) AS variance, (max(count) - min(count))::DOUBLE AS "range",
round(quantile_cont(count, 0.05), 4)::DOUBLE AS p5, round(quantile_cont(count, 0.1), 4)::DOUBLE AS p10, round(quantile_cont(count, 0.9), 4)::DOUBLE AS p90,
round(quantile_cont(count, 0.95), 4)::DOUBLE AS p95, round(any_value(q1 - 1.5 * (q3 - q1)), 4)::DOUBLE AS lower_fence, round(any_value(q3 + 1.5 * (q3 - q1)), 4)::DOUBLE AS upper_fence,
(count(*) FILTER (count < q1 - 1.5 * (q3 - q1) OR count > q3 + 1.5 * (q3 - q1)))::INT AS outlier_count,
round(coalesce(stddev_samp(count), 0) / avg(count) * 100, 4) AS coefficient_of_variation_pct
FROM p JOIN q ON "column" = k GROUP BY 1""")
def _(spark, table):
    """Spread, percentiles, fences and outliers of the shown counts."""
    out = charts.chart_bars(table("part"))["count_statistics"]
    names = ["variance", "range", "p5", "p10", "p90", "p95", "lower_fence", "upper_fence", "coefficient_of_variation_pct"]
    return rounded(out.select("column", "outlier_count", *names), 4, *(n for n in names if n != "range"))


@query("chart_group_mean_statistics", """WITH g AS (SELECT o_orderpriority AS c, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT count(*) AS total_categories, arg_max(c, m) AS dominant_category, round(max(m) / sum(m) * 100, 4) AS dominant_proportion_pct,
count(*) AS n, round(avg(m), 2) AS mean, round(stddev_samp(m), 2) AS std, round(quantile_cont(m, 0.5), 2) AS median FROM g""")
def _(spark, table):
    """Summary and statistics of the means of one chart."""
    made = charts.chart_group_means(table("orders"), [("o_orderpriority", "o_totalprice")])["avg_o_totalprice_by_o_orderpriority"]
    one = made["summary"].select("total_categories", "dominant_category", "dominant_proportion_pct").withColumn("column", F.lit("o_totalprice"))
    both = one.join(made["statistics"].select("column", "n", "mean", "std", "median"), "column").drop("column")
    return rounded(both, 2, "mean", "std", "median")


def shown(n: str, limit: int) -> str:
    """Points of a chart of a column's values: none above the limit."""
    return f"CASE WHEN {n} <= {limit} THEN {n} ELSE 0 END"


@query("chart_sections", f"""WITH f AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p,
 least(30, greatest(5, floor(sqrt(count(*)))::BIGINT)) AS bins FROM orders),
c AS (SELECT 'Hist O Custkey' AS name, 'distribution' AS category, bins AS points FROM f UNION ALL SELECT 'Hist O Totalprice', 'distribution', bins FROM f
UNION ALL SELECT 'Bar O Orderstatus', 'bar', {shown("s", 20)} FROM f UNION ALL SELECT 'Bar O Orderpriority', 'bar', {shown("p", 20)} FROM f
UNION ALL SELECT 'Pie O Orderstatus', 'pie', {shown("s", 10)} FROM f UNION ALL SELECT 'Pie O Orderpriority', 'pie', {shown("p", 10)} FROM f
UNION ALL SELECT 'Correlation Heatmap', 'correlation', 4 FROM f WHERE n > 1
UNION ALL SELECT 'Avg O Totalprice By O Orderstatus', 'other', CASE WHEN s <= 25 THEN s ELSE 24 END FROM f
UNION ALL SELECT 'Avg O Totalprice By O Orderpriority', 'other', CASE WHEN p <= 25 THEN p ELSE 24 END FROM f)
SELECT category, count(*) AS charts, sum(points)::BIGINT AS points, string_agg(name, ', ' ORDER BY name) AS names FROM c WHERE points > 0 GROUP BY 1""")
def _(spark, table):
    """The charts of the orders by category, with how many points they show."""
    orders = table("orders").select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    made = {"histograms": charts.chart_histograms(orders, orders), "bars": charts.chart_bars(orders), "pies": charts.chart_pies(orders),
            "correlation": charts.chart_correlation(orders, orders.withColumn("column", F.lit(""))),
            "group_means": charts.chart_group_means(orders, [("o_orderstatus", "o_totalprice"), ("o_orderpriority", "o_totalprice")])}
    return charts.chart_sections(charts.chart_index(made)).select("category", "charts", "points", F.concat_ws(", ", "names").alias("names"))
