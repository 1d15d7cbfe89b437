"""Key figures, profiles, statistics, counts and group detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistrata.catalog.base import query
from vistrata.catalog.columns import FINITE, MESSY, messy
from vistrata.functions.columns import col
from vistrata.operators import association, counts, groups, histogram, preview, profile, quantiles, states, statistics
from vistrata.plans import summary
from vistrata.plans.kpis import kpi_group_figures, kpi_groups, kpis

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def each(template: str, columns=NUMBERS) -> str:
    """One SELECT per column, `{c}` replaced by its name."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


def rounded(df, places, *names):
    return df.select(*[F.round(col(c), places).alias(c) if c in names else col(c) for c in df.columns])


@query("kpis", each("""SELECT 'SUM_{c}' AS metric, round(sum({c}), 2)::DOUBLE AS value FROM lineitem
UNION ALL SELECT 'AVG_{c}', round(avg({c}), 2) FROM lineitem""") + """
UNION ALL SELECT 'ROW_COUNT', count(*)::DOUBLE FROM lineitem UNION ALL SELECT 'COLUMN_COUNT', 11::DOUBLE""")
def _(spark, table):
    """Sums and means of every numeric column, row and column count."""
    return kpis(table("lineitem")).select("metric", F.round("value", 2).alias("value"))


@query("kpis_with_missing", f"""WITH {MESSY}, {FINITE}
SELECT 'SUM_id' AS metric, sum(id)::DOUBLE AS value FROM fin UNION ALL SELECT 'AVG_id', round(avg(id), 2) FROM fin
UNION ALL SELECT 'SUM_amount', round(sum(amount), 0) FROM fin UNION ALL SELECT 'AVG_amount', round(avg(amount), 0) FROM fin
UNION ALL SELECT 'SUM_qty', sum(qty)::DOUBLE FROM fin UNION ALL SELECT 'AVG_qty', round(avg(qty), 2) FROM fin
UNION ALL SELECT 'SUM_fixed', sum(fixed) FROM fin UNION ALL SELECT 'AVG_fixed', avg(fixed) FROM fin
UNION ALL SELECT 'ROW_COUNT', count(*)::DOUBLE FROM fin UNION ALL SELECT 'COLUMN_COUNT', 5::DOUBLE""")
def _(spark, table):
    value = F.when(F.col("metric").endswith("amount"), F.round("value", 0)).otherwise(F.round("value", 2))
    return kpis(messy(table("orders"))).select("metric", value.alias("value"))


@query("kpi_groups", """SELECT 'SUM' AS metric_group, count(*) AS metrics FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')
UNION ALL SELECT 'AVG', count(*) FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')
UNION ALL SELECT 'other', 2""")
def _(spark, table):
    return kpi_groups(kpis(table("lineitem")))


@query("kpi_group_figures", f"""WITH {MESSY}, {FINITE}, k AS (
SELECT 'SUM' AS metric_group, unnest([sum(id)::DOUBLE, sum(amount), sum(qty)::DOUBLE, sum(fixed)::DOUBLE, NULL]) AS value FROM fin
UNION ALL SELECT 'AVG', unnest([avg(id), avg(amount), avg(qty), avg(fixed), NULL]) FROM fin
UNION ALL SELECT 'other', unnest([count(*)::DOUBLE, 6]) FROM fin)
SELECT metric_group, count(*) AS metrics, count(*) - count(value) AS missing, round(min(value), 2) AS least, round(max(value), -1) AS greatest FROM k GROUP BY 1""")
def _(spark, table):
    """What the figures of each group show; a column without values has missing ones."""
    made = kpi_group_figures(kpis(messy(table("orders")).withColumn("empty", F.lit(None).cast("double"))))
    return made.withColumn("least", F.round("least", 2)).withColumn("greatest", F.round("greatest", -1))


@query("missing_counts", f"""WITH {MESSY}, {FINITE} SELECT 'id' AS "column", count(*) - count(id) AS missing FROM fin
UNION ALL SELECT 'amount', count(*) - count(amount) FROM fin UNION ALL SELECT 'qty', count(*) - count(qty) FROM fin
UNION ALL SELECT 'city', count(*) - count(city) FROM fin UNION ALL SELECT 'fixed', count(*) - count(fixed) FROM fin""")
def _(spark, table):
    return profile.missing_counts(messy(table("orders"))).drop("position")


@query("distinct_counts", each("""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct" FROM lineitem""",
                               [*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]))
def _(spark, table):
    return profile.distinct_counts(table("lineitem")).drop("position")


@query("basic_statistics", each("""SELECT '{c}' AS "column", count({c}) AS "count", round(sum({c}), 2)::DOUBLE AS "sum",
round(avg({c}), 4) AS mean, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(max({c}) - min({c}), 4)::DOUBLE AS "range" FROM lineitem"""))
def _(spark, table):
    out = profile.numeric_profile(table("lineitem"), moments=False)
    return rounded(rounded(out, 2, "sum"), 4, "mean", "range").drop("position", "missing")


@query("spread_and_moments", each("""SELECT '{c}' AS "column", round(stddev_samp({c}), 4) AS std,
round(var_samp({c}) / (max({c}) - min({c}))**2, 6) AS relative_variance,
round(avg((({c} - m) / s)**3), 6) AS skewness, round(avg((({c} - m) / s)**4) - 3, 6) AS kurtosis,
round(stddev_samp({c}) / avg({c}) * 100, 4) AS cv
FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem)"""))
def _(spark, table):
    out = profile.numeric_profile(table("lineitem"))
    return out.select("column", F.round("std", 4).alias("std"),
                      F.round(F.col("variance") / F.col("range") / F.col("range"), 6).alias("relative_variance"),
                      F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"),
                      F.round(F.col("std") / F.col("mean") * 100, 4).alias("cv"))


QUANTILES = each("""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.05), 4)::DOUBLE AS p5, round(quantile_cont({c}, 0.1), 4)::DOUBLE AS p10,
round(quantile_cont({c}, 0.25), 4)::DOUBLE AS p25, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS p50, round(quantile_cont({c}, 0.75), 4)::DOUBLE AS p75,
round(quantile_cont({c}, 0.9), 4)::DOUBLE AS p90, round(quantile_cont({c}, 0.95), 4)::DOUBLE AS p95 FROM lineitem""")
P = ["p5", "p10", "p25", "p50", "p75", "p90", "p95"]


@query("percentiles", QUANTILES)
def _(spark, table):
    out = statistics.percentile_table(table("lineitem"))
    return out.select("column", *[F.round(p, 4).alias(p) for p in P])


@query("percentiles_two_pass", QUANTILES)
def _(spark, table):
    """The same through the bucketed selection used on large inputs."""
    out = quantiles.percentiles(table("lineitem"), NUMBERS, [.05, .1, .25, .5, .75, .9, .95], one_pass_values=0)
    return out.select("column", *[F.round(F.col("values")[i], 4).alias(p) for i, p in enumerate(P)])


@query("group_percentiles_two_pass", """
SELECT o_custkey % 50 AS bucket, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90
FROM orders GROUP BY 1""")
def _(spark, table):
    df = table("orders").select((F.col("o_custkey") % 50).alias("bucket"), "o_totalprice")
    out = quantiles.percentiles(df, ["o_totalprice"], [.5, .9], keys=["bucket"], one_pass_values=0)
    return out.select("bucket", F.round(F.col("values")[0], 4).alias("median"), F.round(F.col("values")[1], 4).alias("p90"))


@query("fences_and_outliers", f"""WITH {MESSY}, {FINITE},
q AS (SELECT quantile_cont(amount, 0.25) a1, quantile_cont(amount, 0.75) a3 FROM fin),
f AS (SELECT a1 - 1.5 * (a3 - a1) AS lower_fence, a3 + 1.5 * (a3 - a1) AS upper_fence FROM q)
SELECT 'amount' AS "column", round(lower_fence, 2) AS lower_fence, round(upper_fence, 2) AS upper_fence,
(SELECT count(*) FROM fin WHERE amount < lower_fence OR amount > upper_fence) AS outlier_count,
(SELECT count(*) FROM (SELECT amount FROM fin WHERE amount < lower_fence OR amount > upper_fence ORDER BY amount LIMIT 20)) AS shown,
(SELECT max(amount) FROM (SELECT amount FROM fin WHERE amount < lower_fence OR amount > upper_fence ORDER BY amount LIMIT 20)) AS last_shown
FROM f""")
def _(spark, table):
    out = rounded(statistics.outliers(messy(table("orders")), ["amount"]), 2, "lower_fence", "upper_fence")
    return out.select("column", "lower_fence", "upper_fence", "outlier_count",
                      F.size("outliers_sample").cast("bigint").alias("shown"), F.array_max("outliers_sample").alias("last_shown"))


@query("modes", each("""SELECT '{c}' AS "column", {c}::DOUBLE AS mode, n AS mode_count FROM
(SELECT {c}, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, {c} LIMIT 1)"""))
def _(spark, table):
    return counts.modes(table("lineitem"), NUMBERS)


@query("describe", each("""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4)::DOUBLE AS p25, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS p50,
round(quantile_cont({c}, 0.75), 4)::DOUBLE AS p75, max({c})::DOUBLE AS max FROM lineitem""") + """
UNION ALL SELECT 'l_shipdate', count(s), round(avg(s), 4), NULL, min(s), round(quantile_cont(s, 0.25), 4), round(quantile_cont(s, 0.5), 4),
round(quantile_cont(s, 0.75), 4), max(s) FROM (SELECT epoch(l_shipdate) AS s FROM lineitem)""")
def _(spark, table):
    out = statistics.describe(table("lineitem")).drop("position")
    return rounded(out, 4, "mean", "std", "p25", "p50", "p75")


@query("describe_times", """WITH t AS (SELECT 'l_shipdate' AS "column", epoch(l_shipdate) AS s FROM lineitem UNION ALL SELECT 'ts', epoch(ts) FROM events
UNION ALL SELECT 'late', epoch(CASE WHEN value > 50 THEN ts END) FROM events)
SELECT "column", count(s) AS "count", """ + ", ".join(f"strftime(to_timestamp(floor(({x}) / 60) * 60) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS {n}" for n, x in (
    ("mean", "avg(s) + 0.01"), ("min", "min(s)"), ("p25", "quantile_cont(s, 0.25)"), ("p50", "quantile_cont(s, 0.5)"), ("p75", "quantile_cont(s, 0.75)"),
    ("max", "max(s)"))) + """ FROM t GROUP BY 1""")
def _(spark, table):
    """Time columns described as times, to the minute."""
    late = F.when(F.col("value") > 50, F.col("ts")).alias("late")
    made = statistics.describe_times(table("lineitem")).unionByName(statistics.describe_times(table("events").select("ts", late)))
    # A mean is a double: a hundredth of a second more keeps one on a full minute from falling below it.
    made = made.withColumn("mean", F.col("mean") + F.expr("interval 10 milliseconds"))
    return made.select("column", "count", *[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("mean", "min", "p25", "p50", "p75", "max")])


def quantile_sql(c: str, p: float) -> str:
    return f"round(quantile_cont({c}, {p}), 4)::DOUBLE"


@query("full_statistics", each("""SELECT '{c}' AS "column", count({c}) AS "count", 0::BIGINT AS missing, round(avg({c}), 4) AS mean,
(SELECT {c}::DOUBLE FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
(SELECT count(*) FROM lineitem GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS mode_count, round(var_samp({c}), 2) AS variance,
round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, (max({c}) - min({c}))::DOUBLE AS "range", round(sum({c}), 2)::DOUBLE AS "sum",
round(skewness_pop, 4) AS skewness, round(kurtosis_pop({c}), 4) AS kurtosis,
""".replace("round(skewness_pop, 4)", "round(skewness({c}) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 4)") + ", ".join(
    quantile_sql("{c}", p) + f" AS {n}" for n, p in [("p5", .05), ("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9), ("p95", .95), ("median", .5), ("q1", .25), ("q3", .75)]) + """,
round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4)::DOUBLE AS iqr,
round(quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4)::DOUBLE AS lower_fence,
round(quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4)::DOUBLE AS upper_fence,
round(stddev_samp({c}) / avg({c}) * 100, 2) AS coefficient_of_variation_pct,
(SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM lineitem)
 WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count,
(SELECT list(round(v, 4) ORDER BY v) FROM (SELECT {c}::DOUBLE AS v FROM lineitem, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM lineitem)
 WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) ORDER BY v LIMIT 20))::VARCHAR AS outliers_sample,
0.0::DOUBLE AS shapiro_p_value, false AS is_normal_distribution, true AS shapiro_in_range FROM lineitem"""))
def _(spark, table):
    """All columns with the operator's defaults; the normality statistic of drawn values is held to its range."""
    out = statistics.full_statistics(table("lineitem")).drop("position")
    out = rounded(rounded(out, 4, *[c for c, t in out.dtypes if t == "double" and c not in ("min", "max", "range", "mode")]), 2, "sum", "variance", "coefficient_of_variation_pct")
    sample = F.when(F.size("outliers_sample") > 0, F.concat(F.lit("["), F.array_join(F.transform("outliers_sample", lambda x: F.round(x, 4).cast("string")), ", "), F.lit("]")))
    return out.withColumn("outliers_sample", sample).withColumn("shapiro_in_range", F.col("shapiro_stat").between(0.5, 0.99)).drop("shapiro_stat")


@query("normality")
def _(spark, table):
    """Shapiro-Wilk per column; no SQL form."""
    return statistics.normality(table("lineitem"))


@query("normality_all_values")
def _(spark, table):
    """Shapiro-Francia over every value of each column; no SQL form."""
    return statistics.normality_all(table("lineitem"))


@query("query_statistics", each("""SELECT '{c}' AS "column", count({c}) AS "count", count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean,
round(quantile_cont({c}, 0.5), 4)::DOUBLE AS median, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max,
round(max({c}) - min({c}), 4) AS "range", round(quantile_cont({c}, 0.25), 4)::DOUBLE AS q1, round(quantile_cont({c}, 0.75), 4)::DOUBLE AS q3,
round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4)::DOUBLE AS iqr, round(skewness({c}), 5) AS skewness, round(kurtosis({c}), 5) AS kurtosis
FROM lineitem""", PRICES))
def _(spark, table):
    out = statistics.query_statistics(table("lineitem"), PRICES)
    return rounded(rounded(out, 4, "mean", "median", "std", "range", "q1", "q3", "iqr"), 5, "skewness", "kurtosis")


@query("percentile_ladder", """
WITH p AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, quantile_cont(o_totalprice, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) q FROM orders)
SELECT label, round(v, 4) AS value, round(greatest(2, least(100, (v - lo) / (hi - lo) * 100)), 4) AS position_pct
FROM (SELECT lo, hi, unnest(['p5', 'p10', 'Q1 (p25)', 'Median (p50)', 'Q3 (p75)', 'p90', 'p95']) AS label, unnest(q) AS v FROM p)""")
def _(spark, table):
    orders = table("orders")
    ends = profile.numeric_profile(orders, ["o_totalprice"], moments=False)
    both = statistics.percentile_table(orders, ["o_totalprice"]).join(ends, "column")
    return rounded(statistics.percentile_ladder(both).select("label", "value", "position_pct"), 4, "value", "position_pct")


@query("value_counts", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1")
def _(spark, table):
    return counts.value_counts(table("part"), "p_brand")


@query("top_values", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, table):
    return counts.top_values(table("part"), "p_brand", 15)


@query("counts_by_key", "SELECT p_size AS value, count(*) AS count FROM part GROUP BY 1")
def _(spark, table):
    return counts.counts_by_key(table("part"), "p_size")


@query("category_shares", """
WITH t AS (SELECT c_mktsegment AS name, count(*) AS count FROM customer GROUP BY 1)
SELECT name, count, round(count / sum(count) OVER () * 100, 4) AS proportion_pct FROM t""")
def _(spark, table):
    return counts.category_shares(counts.value_counts(table("customer"), "c_mktsegment"))


@query("category_summary", """
WITH t AS (SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1)
SELECT count(*) AS total_categories, sum(n)::DOUBLE AS total_count, (SELECT name FROM t ORDER BY n DESC, name LIMIT 1) AS dominant_category,
round(max(n) / sum(n) * 100, 4) AS dominant_proportion_pct FROM t""")
def _(spark, table):
    return counts.category_summary(counts.value_counts(table("customer"), "c_mktsegment"))


@query("group_means", "SELECT l_returnflag AS category, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def _(spark, table):
    return rounded(groups.group_means(table("lineitem"), "l_returnflag", "l_extendedprice"), 4, "mean")


@query("group_detail", """
SELECT l_returnflag AS category, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(l_extendedprice) AS count,
round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem GROUP BY 1""")
def _(spark, table):
    return rounded(groups.group_detail(table("lineitem"), "l_returnflag", "l_extendedprice"), 4, "mean", "std", "median")


def bins_sql(column: str, source: str, bins: str) -> str:
    return f"""SELECT '{column}' AS "column", g.bin::INT AS bin, round(g.bin * step + lo, 6)::DOUBLE AS low,
round(CASE WHEN g.bin = k - 1 THEN hi ELSE (g.bin + 1) * step + lo END, 6)::DOUBLE AS high, count(b.bin) AS count
FROM (SELECT *, unnest(range(k)) AS bin FROM (SELECT lo, hi, k, (hi - lo) / k AS step FROM
 (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi, {bins} AS k FROM {source}))) g
LEFT JOIN (SELECT CASE WHEN v < i * step + lo THEN i - 1 WHEN i < k - 1 AND v >= (i + 1) * step + lo THEN i + 1 ELSE i END AS bin
 FROM (SELECT v, lo, k, step, least(floor((v - lo) / step), k - 1)::BIGINT AS i FROM
  (SELECT {column}::DOUBLE AS v, lo, k, (hi - lo) / k AS step FROM {source}, (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi, {bins} AS k FROM {source})))) b
ON g.bin = b.bin GROUP BY ALL"""


AUTO_BINS = "least(30, greatest(5, floor(sqrt(count(*)))::BIGINT))"


@query("histograms", " UNION ALL ".join(bins_sql(c, "lineitem", AUTO_BINS) for c in NUMBERS))
def _(spark, table):
    return histogram.histograms(table("lineitem")).drop("label")


@query("histogram_labels", """
WITH e AS (SELECT min(value) AS lo, max(value) AS hi, least(30, greatest(5, floor(sqrt(count(*)))::BIGINT)) AS k FROM events),
g AS (SELECT lo, hi, k, (hi - lo) / k AS step, unnest(range(k)) AS bin FROM e)
SELECT bin::INT AS bin, round(bin * step + lo, 6)::VARCHAR || ' - ' || round(CASE WHEN bin = k - 1 THEN hi ELSE (bin + 1) * step + lo END, 6)::VARCHAR AS label FROM g""")
def _(spark, table):
    return histogram.histograms(table("events"), ["value"]).select("bin", "label")


@query("query_histogram", bins_sql("value", "events", "30::BIGINT"))
def _(spark, table):
    return histogram.histograms(table("events"), ["value"], bins=histogram.QUERY_BINS).drop("label")


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS row_name, '{b}' AS column_name, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)") + " AS r FROM lineitem"
    + " HAVING count(*) > 1" for a in NUMBERS for b in NUMBERS))
def _(spark, table):
    return association.correlation_matrix(table("lineitem"))


@query("correlation_matrix_wide", " UNION ALL ".join(
    f"SELECT '{a}' AS row_name, " + ", ".join(
        ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)") + f" AS {b}" for b in PRICES)
    + " FROM lineitem HAVING count(*) > 1" for a in PRICES))
def _(spark, table):
    return association.wide_matrix(association.correlation_matrix(table("lineitem"), PRICES), PRICES)


@query("correlation_with_missing", f"""WITH {MESSY}, {FINITE}
SELECT 'amount' AS x_name, 'qty' AS y_name, count(*) AS n, round(corr(amount, qty), 6) AS r FROM fin WHERE amount IS NOT NULL AND qty IS NOT NULL""")
def _(spark, table):
    out = association.linear_association(messy(table("orders")), [("amount", "qty")])
    return out.select("x_name", "y_name", "n", F.round("pearson_r", 6).alias("r"))


PAIRS = list(zip(NUMBERS, NUMBERS[1:]))[:4]


@query("linear_regression", " UNION ALL ".join(
    f"""SELECT '{x}' AS x_name, '{y}' AS y_name, count(*) AS n, round(corr({x}, {y}), 6) AS pearson_r, round(regr_r2({y}, {x}), 6) AS r_squared,
round(regr_slope({y}, {x}), 6) AS slope, round(regr_intercept({y}, {x}), 4) AS intercept,
round(sqrt((1 - regr_r2({y}, {x})) * regr_syy({y}, {x}) / regr_sxx({y}, {x}) / (count(*) - 2)), 6) AS std_error FROM lineitem""" for x, y in PAIRS))
def _(spark, table):
    out = association.linear_association(table("lineitem")).drop("position", "p_value")
    return rounded(rounded(out, 6, "pearson_r", "r_squared", "slope", "std_error"), 4, "intercept")


# Two-sided Student-t tail by Simpson's rule: with tan(a) = |t| / sqrt(df) it is 2 c * integral of cos^(df-1) from a to pi/2.
P_VALUE = """(SELECT 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * (pi() / 2 - a) / 60000 *
 sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(a + (pi() / 2 - a) * i / 20000), df - 1)) FROM range(20001) r(i))"""


@query("correlation_p_values", " UNION ALL ".join(
    f"""SELECT x_name, y_name, round({P_VALUE}, 5) AS p_value FROM (SELECT x_name, y_name, df, atan(abs(r) * sqrt(df / (1 - r * r)) / sqrt(df)) AS a FROM
(SELECT '{x}' AS x_name, '{y}' AS y_name, count(*)::DOUBLE - 2 AS df, corr({x}, {y}) AS r FROM lineitem))""" for x, y in PAIRS))
def _(spark, table):
    return rounded(association.linear_association(table("lineitem")).select("x_name", "y_name", "p_value"), 5, "p_value")


@query("spearman", """
WITH r AS (SELECT (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2) AS rx,
 (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2) AS ry FROM lineitem)
SELECT 'l_quantity' AS x_name, 'l_extendedprice' AS y_name, count(*) AS n, round(corr(rx, ry), 6) AS spearman_r FROM r""")
def _(spark, table):
    out = association.spearman(table("lineitem"), "l_quantity", "l_extendedprice")
    return rounded(out.drop("spearman_p_value"), 6, "spearman_r")


# Amount, quantity and key of the messy rows, none of them complete but the key.
LOOSE = ["id", "amount", "qty"]


@query("correlation_matrix_with_missing", f"WITH {MESSY}, {FINITE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS row_name, '{b}' AS column_name, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)") + " AS r FROM fin HAVING count(*) > 1"
    for a in LOOSE for b in LOOSE))
def _(spark, table):
    return association.correlation_matrix(messy(table("orders")))


def ranks_sql(x: str, y: str, source: str) -> str:
    rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"
    return f"""SELECT '{x}' AS x_name, '{y}' AS y_name, count(*) AS n, corr(rx, ry) AS r FROM
(SELECT {rank(x)} AS rx, {rank(y)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""


def all_pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(x, y) for i, x in enumerate(names) for y in names[i + 1:]]


@query("spearman_matrix", "SELECT x_name, y_name, n, round(r, 6) AS spearman_r FROM (" + " UNION ALL ".join(
    ranks_sql(x, y, "lineitem") for x, y in all_pairs(NUMBERS)) + ")")
def _(spark, table):
    out = association.spearman_pairs(table("lineitem"), all_pairs(NUMBERS))
    return rounded(out.drop("spearman_p_value"), 6, "spearman_r")


@query("spearman_with_missing", f"WITH {MESSY}, {FINITE} " + f"""SELECT x_name, y_name, n, round(r, 6) AS spearman_r, round({P_VALUE}, 5) AS spearman_p_value
FROM (SELECT *, n - 2.0::DOUBLE AS df, atan(abs(r) / sqrt(1 - r * r)) AS a FROM (""" + " UNION ALL ".join(ranks_sql(x, y, "fin") for x, y in all_pairs(LOOSE)) + "))")
def _(spark, table):
    out = association.spearman_pairs(messy(table("orders")), all_pairs(LOOSE))
    return rounded(rounded(out, 6, "spearman_r"), 5, "spearman_p_value")


@query("dataset_shape", """SELECT count(*) AS "rows", 11::INT AS "columns" FROM lineitem""")
def _(spark, table):
    return summary.dataset_shape(table("lineitem"))


def top5(c: str, source: str) -> str:
    return f"""(SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM {source} GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"""


@query("categorical_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values, count(*) - count({c}) AS missing_count, {top5(c, 'part')} AS top_values FROM part"""
    for c in ("p_name", "p_brand", "p_type")))
def _(spark, table):
    text = F.array_join(F.transform("top_values", lambda t: F.concat(t["value"], F.lit("="), t["count"].cast("string"))), ";")
    return summary.categorical_summary(table("part")).select("column", "unique_values", "missing_count", text.alias("top_values"))


@query("dataset_profile", each("""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique" FROM orders""",
                               ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def _(spark, table):
    return summary.dataset_profile(table("orders"))["columns"].select("column", "unique")


@query("merged_profile_states", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, true AS distinct_near, true AS median_near FROM lineitem""" for c in NUMBERS))
def _(spark, table):
    """Profiles of three loads, merged: exact figures, and sketches within their stated errors of the exact ones."""
    items = table("lineitem")
    loads = [states.profile_state(items.where(F.pmod("l_orderkey", F.lit(3)) == i), str(i)) for i in range(3)]
    made = states.read_states(states.merge_states(loads[0].unionByName(loads[1]).unionByName(loads[2])), [0.5]).where(F.col("column").isin(NUMBERS))
    exact = profile.distinct_counts(items, NUMBERS).select("column", F.col("distinct").alias("exact"))
    near = quantiles.percentiles(items, NUMBERS, [0.5 - 2 * states.RANK_ERROR, 0.5 + 2 * states.RANK_ERROR]).select("column", "values")
    out = made.join(exact, "column").join(near, "column").select(
        "column", "rows", "missing", "mean", "std", "min", "max", (F.abs(F.col("distinct") - F.col("exact")) <= 4 * states.DISTINCT_ERROR * F.col("exact") + 0.5).alias("distinct_near"),
        F.col("percentiles")[0].between(F.col("values")[0], F.col("values")[1]).alias("median_near"))
    return rounded(out, 4, "mean", "std")


@query("head_rows", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def _(spark, table):
    return preview.head(table("orders"), 200, [F.desc("o_totalprice"), "o_orderkey"])


@query("tail_per_series", """
SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 60""")
def _(spark, table):
    return preview.tail_per_series(table("orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 60)


@query("series_preview", """
WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey, o_totalprice, count(*) OVER () AS total_points FROM orders)
SELECT o_orderkey, o_totalprice, position, true AS truncated, total_points, 'Showing 24 of ' || total_points || ' points' AS note
FROM n WHERE position < 12 OR position >= total_points - 12""")
def _(spark, table):
    return preview.series_preview(table("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("category_preview", """
WITH t AS (SELECT p_size AS value, count(*) AS count FROM part GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY value) - 1 AS position, count(*) OVER () AS total_points FROM t)
SELECT value, count, position, total_points > 25 AS truncated, total_points, CASE WHEN total_points > 25 THEN 'Showing 24 of ' || total_points || ' points' END AS note
FROM n WHERE total_points <= 25 OR position < 12 OR position >= total_points - 12""")
def _(spark, table):
    return preview.category_preview(counts.value_counts(table("part"), "p_size"), ["value"])


@query("share_of_largest", """
WITH t AS (SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1)
SELECT value, count, round(count / max(count) OVER () * 100, 4) AS pct_of_largest FROM t""")
def _(spark, table):
    return rounded(preview.share_of_largest(counts.value_counts(table("customer"), "c_mktsegment"), "count"), 4, "pct_of_largest")
