"""Questions about one table and the charts of their answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistrata.catalog.aggregates import bins_sql, rounded
from vistrata.catalog.base import query
from vistrata.catalog.columns import texty
from vistrata.plans import query as Q
from vistrata.plans.kpis import kpis
from vistrata.plans.summary import dataset_profile, profile_text

BY_PRIORITY = "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority"


@query("sql_question", BY_PRIORITY)
def _(spark, table):
    return Q.sql_query(spark, BY_PRIORITY, orders=table("orders"))


@query("sql_question_over_views", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _(spark, table):
    orders = table("orders")
    Q.register(orders, orders.where("o_totalprice > 100000"), "loaded_orders")
    return Q.sql_query(spark, "SELECT o_orderstatus, count(*) AS n FROM loaded_orders GROUP BY o_orderstatus")


@query("frame_question", "SELECT l_returnflag, round(avg(l_extendedprice * (1 - l_discount)), 4) AS net FROM lineitem GROUP BY 1")
def _(spark, table):
    out = Q.frame_query(table("lineitem"), lambda df: df.groupBy("l_returnflag").agg(
        F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")))
    return rounded(out, 4, "net")


@query("frame_question_retry", """
SELECT event_type AS y, round(avg(CASE event_id % 6 WHEN 1 THEN 1000 WHEN 5 THEN event_id END), 4) AS mean FROM events GROUP BY 1""")
def _(spark, table):
    """Text that does not cast as it stands; the second run sees numbers."""
    out = Q.frame_query(texty(table("events")), lambda df: df.groupBy("y").agg(F.avg(F.col("x").cast("double") + F.col("x").cast("int") * 0).alias("mean"))
                        if dict(df.dtypes)["x"] == "string" else df.groupBy("y").agg(F.avg("x").alias("mean")))
    return rounded(out, 4, "mean")


@query("stage_question", """
SELECT o_orderstatus AS "_id.status", o_orderpriority AS "_id.priority", round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean,
min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders WHERE o_totalprice >= 1000 GROUP BY 1, 2
ORDER BY n DESC, "_id.status", "_id.priority" LIMIT 10""")
def _(spark, table):
    out = Q.stage_query(table("orders"), [
        {"$match": {"o_totalprice": {"$gte": 1000}}},
        {"$group": {"_id": {"status": "$o_orderstatus", "priority": "$o_orderpriority"}, "total": {"$sum": "$o_totalprice"},
                    "mean": {"$avg": "$o_totalprice"}, "low": {"$min": "$o_totalprice"}, "high": {"$max": "$o_totalprice"},
                    "n": {"$sum": 1}}},
        {"$sort": {"n": -1, "_id.status": 1, "_id.priority": 1}},
        {"$limit": 10},
    ])
    return rounded(rounded(out.withColumn("n", F.col("n").cast("bigint")), 2, "total"), 4, "mean")


@query("stage_question_project", "SELECT o_orderkey, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, table):
    return Q.stage_query(table("orders"), [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 50},
                                           {"$project": {"o_orderkey": 1, "price": "$o_totalprice"}}])


@query("shape_answer", """SELECT event_id, (props::JSON->>'k')::BIGINT AS props_k, value FROM events""")
def _(spark, table):
    nested = table("events").select("event_id", F.from_json("props", "k bigint").alias("props"), "value")
    return Q.shape(nested).table


@query("grouped_names", """SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 4) AS l_quantity_mean,
max(l_tax) AS l_tax_max, round(stddev_samp(l_tax), 6) AS l_tax_std FROM lineitem GROUP BY 1""")
def _(spark, table):
    out = Q.grouped_names(table("lineitem"), ["l_returnflag"], {"l_quantity": ["sum", "mean"], "l_tax": ["max", "std"]})
    return rounded(rounded(out, 4, "l_quantity_sum", "l_quantity_mean"), 6, "l_tax_std")


@query("response_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def _(spark, table):
    return Q.response(table("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])


def pie_or_bar(column: str) -> str:
    return f"CASE WHEN (SELECT count(DISTINCT {column}) FROM orders) <= 10 THEN 'pie' ELSE 'bar' END"


@query("chart_choice", f"""
SELECT * FROM (VALUES ('show price by status', true, 'bar', 'o_orderstatus', 'o_totalprice'), ('share as pie', true, {pie_or_bar("o_orderstatus")}, 'o_orderstatus', 'o_totalprice'),
 ('pie charts of customers', true, {pie_or_bar("o_custkey")}, 'o_custkey', 'o_custkey'),
 ('price trend', true, 'line', 'o_orderdate', 'o_totalprice'), ('plot price', true, 'histogram', 'o_totalprice', 'o_totalprice'),
 ('visualize price by status', true, 'bar', 'o_orderstatus', 'o_totalprice'), ('price charts, please', true, 'bar', 'o_orderstatus', 'o_totalprice'),
 ('scatter of both', true, 'scatter', 'o_custkey', 'o_totalprice'), ('how many', false, 'none', 'o_orderstatus', 'o_totalprice'))
 AS t(question, needed, kind, x, y) WHERE (SELECT count(*) FROM orders) > 0""")
def _(spark, table):
    """Charts for questions about the orders; whether a pie has few enough slices is counted."""
    orders = table("orders")
    asked = [("show price by status", orders.select("o_orderstatus", "o_totalprice"), None),
             ("share as pie", orders.select("o_orderstatus", "o_totalprice"), None),
             ("pie charts of customers", orders.select("o_custkey"), None),
             ("price trend", orders.select("o_orderdate", "o_totalprice"), None),
             ("plot price", orders.select("o_totalprice"), None),
             ("visualize price by status", orders.select("o_orderstatus", "o_totalprice"), None),
             ("price charts, please", orders.select("o_orderstatus", "o_totalprice"), None),
             ("scatter of both", orders.select("o_custkey", "o_totalprice"), "o_totalprice"),
             ("how many", orders.select("o_orderstatus", "o_totalprice"), None)]
    rows = []
    for question, df, y in asked:
        c = Q.choose_chart(question, df, y=y)
        rows.append((question, c.needed, c.kind, c.x, c.y))
    return spark.createDataFrame(rows, "question string, needed boolean, kind string, x string, y string")


def chart(kind, x, y=None):
    return Q.Chart(True, kind, x, y)


@query("answer_histogram", bins_sql("o_totalprice", "orders", "30::BIGINT"))
def _(spark, table):
    return Q.chart_rows(table("orders"), chart("histogram", "o_totalprice")).drop("label")


@query("answer_pie_counts", "SELECT p_brand AS x, count(*) AS y FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, table):
    return Q.chart_rows(table("part"), chart("pie", "p_brand"))


@query("answer_pie_rows", "SELECT o_orderkey AS x, o_totalprice AS y FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, table):
    return Q.chart_rows(table("orders"), chart("pie", "o_orderkey", "o_totalprice"), [F.desc("y"), "x"])


@query("answer_line_counts", "SELECT p_size AS x, count(*) AS y FROM part GROUP BY 1")
def _(spark, table):
    return Q.chart_rows(table("part"), chart("line", "p_size"))


@query("answer_line_rows", "SELECT event_id AS x, value AS y FROM events")
def _(spark, table):
    return Q.chart_rows(table("events"), chart("line", "event_id", "value"))


@query("answer_scatter", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def _(spark, table):
    return Q.chart_rows(table("lineitem"), chart("scatter", "l_quantity", "l_extendedprice"))


@query("answer_bar_counts", "SELECT p_brand AS x, count(*) AS y FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, table):
    return Q.chart_rows(table("part"), chart("scatter", "p_brand"))


@query("answer_bar_rows", "SELECT o_orderkey AS x, o_totalprice AS y FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, table):
    return Q.chart_rows(table("orders"), chart("bar", "o_orderkey", "o_totalprice"), [F.desc("y"), "x"])


@query("answer_payload_points", """
SELECT o_orderpriority AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1 ORDER BY 1 LIMIT 20""")
def _(spark, table):
    grouped = table("orders").groupBy(F.col("o_orderpriority").alias("_id")).agg(F.sum("o_totalprice").alias("total"))
    return rounded(Q.chart_payload(grouped, chart("bar", "_id", "total"), ["category"])["points"], 2, "y")


@query("answer_payload_statistics", """
SELECT 'value' AS "column", count(value) AS "count", round(avg(value), 4) AS mean, round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis FROM events""")
def _(spark, table):
    out = Q.chart_payload(table("events"), chart("bar", "event_type", "value"))["statistics"]
    return rounded(out.select("column", "count", "mean", "skewness", "kurtosis"), 4, "mean", "skewness", "kurtosis")


@query("question_context", """SELECT 'KPIs' AS section, count(*)::DOUBLE AS figure FROM orders
UNION ALL SELECT 'Insights', length('Most orders are open.')::DOUBLE FROM (SELECT 1 FROM orders HAVING count(*) > 0)
UNION ALL SELECT 'Dataset Profile', 6.0::DOUBLE FROM (SELECT 1 FROM orders HAVING count(*) > 0)""")
def _(spark, table):
    """The row count told, the given text's length, and how many columns the whole profile names."""
    df = table("orders")
    out = Q.context_lines(kpis(df), profile_text(dataset_profile(df)), insights="Most orders are open.")
    named = sum(F.contains("text", F.lit(c)).cast("int") for c in df.columns)
    figure = (F.when(F.col("section") == "KPIs", F.regexp_extract("text", "ROW_COUNT=([0-9.E]+)", 1).cast("double"))
              .when(F.col("section") == "Insights", F.length("text").cast("double")).otherwise(named.cast("double")))
    return out.select("section", figure.alias("figure"))


@query("frame_question_scalar", "SELECT count(*)::BIGINT AS rows, max(o_totalprice) AS dearest FROM orders")
def _(spark, table):
    """Scalar answers, shown as one row."""
    orders = table("orders")
    rows = Q.shape(Q.frame_query(orders, lambda d: d.count())).scalar
    dearest = Q.shape(Q.frame_query(orders, lambda d: d.agg(F.max("o_totalprice")).first()[0])).scalar
    return spark.range(1).select(F.lit(rows).cast("bigint").alias("rows"), F.lit(dearest).alias("dearest"))


@query("stage_question_expressions", """
SELECT l_returnflag AS "_id", round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n
FROM lineitem WHERE (l_quantity > 10 OR l_tax = 0) AND l_linestatus IS NOT NULL GROUP BY 1""")
def _(spark, table):
    revenue = {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}
    out = Q.stage_query(table("lineitem"), [
        {"$match": {"$or": [{"l_quantity": {"$gt": 10}}, {"l_tax": 0}], "l_linestatus": {"$exists": True}}},
        {"$group": {"_id": "$l_returnflag", "revenue": {"$sum": revenue}, "least": {"$first": "$l_quantity"},
                    "most": {"$last": "$l_quantity"}, "n": {"$count": {}}}}])
    return out.withColumn("revenue", F.round("revenue", 2))


@query("stage_question_missing", """SELECT 'missing' AS part, count(*) FILTER (o_orderkey % 3 = 0) AS n FROM orders
UNION ALL SELECT 'other', count(*) FILTER (o_orderkey % 3 = 0 OR o_orderstatus <> 'F') FROM orders""")
def _(spark, table):
    """Missing values equal None, and `$ne` keeps them."""
    rows = table("orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("s"))
    parts = [Q.stage_query(rows, [{"$match": {"s": test}}, {"$count": "n"}]).select(F.lit(name).alias("part"), "n")
             for name, test in (("missing", None), ("other", {"$ne": "F"}))]
    return parts[0].unionByName(parts[1])
