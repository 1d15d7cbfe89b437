"""Projections, casts, names and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistrata.catalog.base import query
from vistrata.functions import columns as C
from vistrata.functions import names as N
from vistrata.operators import cleaning, layouts, profile, series
from vistrata.plans.kpis import kpi_labels, kpis

# Rows with every kind of missing value, extremes, a constant column and exact copies, made from orders.
MESSY = """
base AS (SELECT o_orderkey AS id,
  CASE o_orderkey % 50 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE
    WHEN 3 THEN '-Infinity'::DOUBLE WHEN 4 THEN 1e15 WHEN 5 THEN -1e15 ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 7 END AS qty,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS city,
  7.0::DOUBLE AS fixed FROM orders),
messy AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE id % 10 = 0)"""

FINITE = """
fin AS (SELECT id, CASE WHEN isfinite(amount) THEN amount END AS amount, qty, city, fixed FROM messy)"""

CLEAN = f"""WITH {MESSY}, {FINITE},
uniq AS (SELECT DISTINCT id, CASE WHEN amount IS NOT NULL THEN greatest(-1e12, least(1e12, amount)) END AS amount, qty, city FROM fin),
med AS (SELECT quantile_cont(amount, 0.5) AS ma, quantile_cont(qty, 0.5) AS mq FROM uniq),
filled AS (SELECT id::DOUBLE AS id, coalesce(amount, ma) AS amount, coalesce(qty, mq)::DOUBLE AS qty,
  coalesce(city, 'Unknown') AS city FROM uniq, med),
q AS (SELECT quantile_cont(id, 0.25) i1, quantile_cont(id, 0.75) i3, quantile_cont(amount, 0.25) a1,
  quantile_cont(amount, 0.75) a3, quantile_cont(qty, 0.25) q1, quantile_cont(qty, 0.75) q3 FROM filled),
fence AS (SELECT i1 - 1.5 * (i3 - i1) il, i3 + 1.5 * (i3 - i1) iu, a1 - 1.5 * (a3 - a1) al,
  a3 + 1.5 * (a3 - a1) au, q1 - 1.5 * (q3 - q1) ql, q3 + 1.5 * (q3 - q1) qu FROM q)"""


def messy(orders):
    key = F.col("o_orderkey")
    m = F.pmod(key, F.lit(50))
    base = orders.select(
        key.alias("id"),
        F.when(m == 0, None).when(m == 1, float("nan")).when(m == 2, float("inf")).when(m == 3, float("-inf"))
        .when(m == 4, 1e15).when(m == 5, -1e15).otherwise(F.col("o_totalprice")).alias("amount"),
        F.when(key % 11 != 0, F.col("o_custkey") % 7).alias("qty"),
        F.when(key % 13 != 0, F.col("o_orderpriority")).alias("city"),
        F.lit(7.0).alias("fixed"))
    return base.unionByName(base.where("id % 10 = 0"))


@query("column_classes", """
SELECT (row_number() OVER () - 1)::INT AS position, column_name AS "column",
  CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'categorical' END AS class
FROM (DESCRIBE lineitem)""")
def _(spark, table):
    return C.column_classes(table("lineitem")).select("position", "column", "class")


@query("class_fill", f"""WITH {MESSY}, {FINITE}, n AS (SELECT count(*) AS rows FROM fin)
SELECT position, "column", class, filled, rows FROM n, (SELECT unnest([0, 1, 2, 3, 4])::INT AS position, unnest(['id', 'amount', 'qty', 'city', 'fixed']) AS "column",
 unnest(['numeric', 'numeric', 'numeric', 'categorical', 'numeric']) AS class, unnest([count(id), count(amount), count(qty), count(city), count(fixed)]) AS filled FROM fin)""")
def _(spark, table):
    """Columns by class, and how many of their cells are filled."""
    return C.class_fill(C.finite_frame(messy(table("orders")))).select("position", "column", "class", "filled", "rows")


@query("finite_values", f"WITH {MESSY}, {FINITE} SELECT id, amount, qty, city FROM fin")
def _(spark, table):
    return C.finite_frame(messy(table("orders"))).drop("fixed")


@query("clip_extremes", f"WITH {MESSY}, {FINITE} SELECT id, CASE WHEN amount IS NOT NULL THEN greatest(-1e12, least(1e12, amount)) END AS amount FROM fin")
def _(spark, table):
    return cleaning.clip_numeric(C.finite_frame(messy(table("orders")))).select("id", "amount")


@query("drop_constant_columns", f"""WITH {MESSY}, {FINITE}
SELECT id, amount, qty FROM fin WHERE (SELECT min(fixed) = max(fixed) FROM fin)""")
def _(spark, table):
    out = profile.drop_constant_numeric(C.finite_frame(messy(table("orders"))))
    return out.select([c for c in out.columns if c != "city"])


@query("varying_columns", f"""WITH {MESSY}, {FINITE}
SELECT 'id' AS "column" FROM fin HAVING min(id) < max(id)
UNION ALL SELECT 'amount' FROM fin HAVING min(amount) < max(amount)
UNION ALL SELECT 'qty' FROM fin HAVING min(qty) < max(qty)
UNION ALL SELECT 'fixed' FROM fin HAVING min(fixed) < max(fixed)""")
def _(spark, table):
    names = profile.varying_columns(messy(table("orders")))
    return spark.createDataFrame([(n,) for n in names], "column string")


@query("fill_median", f"""WITH {MESSY}, {FINITE}, m AS (SELECT quantile_cont(amount, 0.5) ma, quantile_cont(qty, 0.5) mq FROM fin)
SELECT id, round(coalesce(amount, ma), 6) AS amount, coalesce(qty, mq)::DOUBLE AS qty FROM fin, m""")
def _(spark, table):
    out = cleaning.fill_numeric(C.finite_frame(messy(table("orders"))), ["amount", "qty"])
    return out.select("id", F.round("amount", 6).alias("amount"), "qty")


@query("fill_unknown", f"WITH {MESSY} SELECT id, coalesce(city, 'Unknown') AS city FROM messy")
def _(spark, table):
    return cleaning.fill_text(messy(table("orders"))).select("id", "city")


@query("cap_outliers", f"""WITH {MESSY}, {FINITE}, q AS (SELECT quantile_cont(amount, 0.25) a1, quantile_cont(amount, 0.75) a3 FROM fin)
SELECT id, round(greatest(a1 - 1.5 * (a3 - a1), least(a3 + 1.5 * (a3 - a1), amount)), 6) AS amount
FROM fin, q WHERE amount IS NOT NULL""")
def _(spark, table):
    out = cleaning.cap_outliers(C.finite_frame(messy(table("orders"))), ["amount"])
    return out.where("amount IS NOT NULL").select("id", F.round("amount", 6).alias("amount"))


@query("outlier_predicate", f"""WITH {MESSY}, {FINITE}, q AS (SELECT quantile_cont(amount, 0.25) a1, quantile_cont(amount, 0.75) a3 FROM fin)
SELECT id, amount FROM fin, q WHERE amount < a1 - 1.5 * (a3 - a1) OR amount > a3 + 1.5 * (a3 - a1)""")
def _(spark, table):
    df = C.finite_frame(messy(table("orders")))
    low, high = cleaning.iqr_fences(df, ["amount"])["amount"]
    return df.where((F.col("amount") < low) | (F.col("amount") > high)).select("id", "amount")


@query("distinct_rows", f"WITH {MESSY}, {FINITE} SELECT DISTINCT id, amount, qty, city FROM fin")
def _(spark, table):
    return cleaning.without_duplicates(C.finite_frame(messy(table("orders"))).drop("fixed"))


@query("drop_missing_rows", f"""WITH {MESSY}, {FINITE}
SELECT id, amount, qty FROM fin WHERE amount IS NOT NULL AND qty IS NOT NULL""")
def _(spark, table):
    return C.finite_frame(messy(table("orders"))).dropna(subset=["amount", "qty"]).select("id", "amount", "qty")


@query("clean_table", f"""{CLEAN}
SELECT round(greatest(il, least(iu, id)), 6) AS id, round(greatest(al, least(au, amount)), 6) AS amount,
  round(greatest(ql, least(qu, qty)), 6) AS qty, city FROM filled, fence""")
def _(spark, table):
    out = cleaning.clean(messy(table("orders"))).frame
    return out.select(*[F.round(c, 6).alias(c) for c in ("id", "amount", "qty")], "city")


@query("cleaning_report", f"""{CLEAN},
n AS (SELECT (SELECT count(*) FROM messy) - (SELECT count(*) FROM uniq) AS d,
  (SELECT count(*) - count(amount) FROM uniq) AS ma, (SELECT count(*) - count(qty) FROM uniq) AS mq,
  (SELECT count(*) - count(city) FROM uniq) AS mc,
  (SELECT count(*) FILTER (amount < al OR amount > au) FROM filled, fence) AS oa)
SELECT 'drop_constant' AS step, 'fixed' AS "column", 1::BIGINT AS n, 'Dropped constant column fixed' AS line
UNION ALL SELECT 'duplicates', NULL, d, 'Duplicates removed: ' || d FROM n
UNION ALL SELECT 'fill_median', 'amount', ma, 'Filled missing values in amount using median' FROM n
UNION ALL SELECT 'fill_median', 'qty', mq, 'Filled missing values in qty using median' FROM n
UNION ALL SELECT 'fill_unknown', 'city', mc, 'Filled missing values in city with ''Unknown''' FROM n
UNION ALL SELECT 'cap', 'amount', oa, 'Capped ' || oa || ' outliers in column amount' FROM n""")
def _(spark, table):
    return cleaning.clean(messy(table("orders"))).report.drop("position")


@query("model_inputs", f"""WITH {MESSY}, {FINITE}, m AS (SELECT quantile_cont(amount, 0.5) ma, quantile_cont(qty, 0.5) mq FROM fin)
SELECT id::DOUBLE AS _model_id, round(coalesce(amount, ma), 6) AS _model_amount, coalesce(qty, mq)::DOUBLE AS _model_qty
FROM fin, m""")
def _(spark, table):
    out, features = cleaning.impute_for_model(messy(table("orders")))
    out = out.select([f"_model_{c}" for c in features])
    return out.withColumn("_model_amount", F.round("_model_amount", 6))


TEXTY = """t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'abc' WHEN 1 THEN '1e3' WHEN 2 THEN 'inf'
  WHEN 3 THEN '' WHEN 4 THEN 'NaN' ELSE event_id::VARCHAR END AS x, event_type AS y FROM events)"""


def texty(events):
    m = F.col("event_id") % 6
    return events.select("event_id", F.when(m == 0, "abc").when(m == 1, "1e3").when(m == 2, "inf").when(m == 3, "")
                         .when(m == 4, "NaN").otherwise(F.col("event_id").cast("string")).alias("x"),
                         F.col("event_type").alias("y"))


@query("coerce_number", f"""WITH {TEXTY}
SELECT event_id, CASE WHEN isfinite(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE) END AS x FROM t""")
def _(spark, table):
    return texty(table("events")).select("event_id", C.to_number(F.col("x")).alias("x"))


@query("coerce_numeric_columns", f"""WITH {TEXTY}
SELECT event_id, CASE WHEN isfinite(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE) END AS x, y FROM t""")
def _(spark, table):
    return C.coerce_numeric_columns(texty(table("events")))


DATED = """t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN 'soon' ELSE o_orderkey::VARCHAR END AS day FROM orders)"""


@query("coerce_time", f"""WITH {DATED} SELECT o_orderkey, coalesce(try_cast(CASE WHEN day LIKE '%-%' THEN day END AS TIMESTAMP),
  try_strptime(day, '%m/%d/%Y')) AS day FROM t""")
def _(spark, table):
    m, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    df = table("orders").select("o_orderkey", F.when(m == 0, F.date_format(day, "yyyy-MM-dd"))
                                .when(m == 1, F.date_format(day, "M/d/yyyy")).when(m == 2, "soon")
                                .otherwise(F.col("o_orderkey").cast("string")).alias("day"))
    return df.withColumn("day", C.to_time(F.col("day"), df.schema["day"].dataType).cast("timestamp_ntz"))


# Order dates written out in layouts of their own; every fourth `loose` value has the other order of day and month.
WRITTEN = """
WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 4 = 0 AS odd FROM orders)"""


def written(orders):
    day, odd = F.col("o_orderdate"), F.col("o_orderkey") % 4 == 0
    text = lambda form: F.date_format(day, form)
    return orders.select(
        "o_orderkey", text("dd/MM/yyyy").alias("day_first"), text("M/d/yyyy h:mm a").alias("month_first"), text("d MMM yyyy").alias("named"),
        text("dd.MM.yyyy HH:mm:ss.SSS").alias("dotted"), text("yyyy-MM-dd'T'HH:mm:ssXXX").alias("iso"),
        F.when(odd, text("MM/dd/yyyy")).otherwise(text("dd/MM/yyyy")).alias("loose"), F.col("o_orderpriority").alias("words"))


@query("column_layouts", f"""{WRITTEN},
n AS (SELECT count(*) AS n, count(*) FILTER (day(d) <= 12) AS low, count(*) FILTER (NOT odd OR day(d) <= 12) AS mixed FROM t)
SELECT * FROM (SELECT unnest(['day_first', 'month_first', 'named', 'dotted', 'iso', 'loose']) AS "column",
 unnest(['d/M/yyyy', 'M/d/yyyy', 'd MMM yyyy', 'd.M.yyyy', 'iso', 'd/M/yyyy']) AS layout, unnest([n, n, n, n, n, mixed]) AS read,
 n AS readable, n AS present FROM n)""")
def _(spark, table):
    """The layout of each text column, how many values it reads and how many any layout reads."""
    return layouts.chosen_layouts(layouts.layout_scores(written(table("orders"))))


@query("dates_by_layout", f"""{WRITTEN}
SELECT o_orderkey, d::VARCHAR AS day_first, d::VARCHAR AS month_first, d::VARCHAR AS named, d::VARCHAR AS dotted, d::VARCHAR AS iso,
CASE WHEN NOT odd THEN d::VARCHAR WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d))::VARCHAR END AS loose FROM t""")
def _(spark, table):
    """Columns of dates read as a whole: values that contradict the column's order of day and month stay unread."""
    made, _ = layouts.dates_read(written(table("orders")))
    return made.select("o_orderkey", *[F.to_date(c).cast("string").alias(c) for c in ("day_first", "month_first", "named", "dotted", "iso", "loose")])


@query("kpi_value_text", """
SELECT o_orderkey, CASE WHEN v = floor(v) AND abs(v) < 1e15 THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS text
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice) ELSE round(o_totalprice, 6) END AS v FROM orders)""")
def _(spark, table):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.round("o_totalprice")).otherwise(F.col("o_totalprice"))
    return table("orders").select("o_orderkey", C.kpi_text(C.kpi_value(v)).alias("text"))


@query("iso_times", """
SELECT event_id, CASE WHEN date_trunc('second', ts) = ts THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts FROM events""")
def _(spark, table):
    return C.iso_frame(table("events").select("event_id", "ts"))


@query("underscore_names", """SELECT event_id AS event_id, value AS "value_raw" FROM events""")
def _(spark, table):
    return N.underscore_names(table("events").select(F.col("event_id").alias("event.id"),
                                                     F.col("value").alias("value.raw")))


@query("category_for_id", "SELECT o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1")
def _(spark, table):
    grouped = table("orders").groupBy(F.col("o_orderstatus").alias("_id")).agg(F.count("*").alias("n"))
    return N.category_for_id(grouped)


NESTED = """SELECT event_id, {0} AS "props.k", user_id AS "who.user.id", event_type AS "who.kind" FROM events"""


def documents(events):
    """Events as nested documents with an id."""
    return events.select(
        F.concat(F.lit("doc"), F.col("event_id").cast("string")).alias("_id"), "event_id",
        F.from_json("props", "k bigint").alias("props"),
        F.struct(F.struct(F.col("user_id").alias("id")).alias("user"), F.col("event_type").alias("kind")).alias("who"))


@query("flatten_documents", NESTED.format("(props::JSON->>'k')::BIGINT"))
def _(spark, table):
    return N.drop_document_id(N.flatten(documents(table("events"))))


@query("flatten_one_level", """SELECT event_id, (props::JSON->>'k')::BIGINT AS "props.k", event_type AS "who.kind" FROM events""")
def _(spark, table):
    return N.flatten(documents(table("events")), depth=1).select("event_id", F.col("`props.k`"), F.col("`who.kind`"))


@query("row_index", "SELECT row_number() OVER (ORDER BY o_totalprice) - 1 AS \"index\", o_totalprice FROM orders")
def _(spark, table):
    return N.with_row_index(table("orders").select("o_totalprice"))


@query("display_names", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Forecast: ' WHEN 1 THEN 'Anomaly: Anomaly ' ELSE 'Hist ' END
  || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'forecasting' WHEN 1 THEN 'anomaly' ELSE 'distribution' END AS category
FROM part""")
def _(spark, table):
    prefix = F.when(F.col("p_partkey") % 3 == 0, "forecast_").when(F.col("p_partkey") % 3 == 1, "anomaly_").otherwise("hist_")
    stem = F.concat(prefix, F.translate("p_name", " ", "_"))
    return table("part").select("p_partkey", N.display_name(stem).alias("name"), N.chart_category(stem).alias("category"))


@query("compact_numbers", """
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice * 100000 WHEN 1 THEN -o_totalprice * 100
  WHEN 2 THEN o_totalprice WHEN 3 THEN floor(o_totalprice / 1000) ELSE o_totalprice / 1000 END AS v FROM orders),
s AS (SELECT *, abs(v) AS a, CASE WHEN v < 0 THEN '-' ELSE '' END AS sign FROM v),
p AS (SELECT *, CASE WHEN a >= 1e9 THEN a / 1e9 WHEN a >= 1e6 THEN a / 1e6 WHEN a >= 1e3 THEN a / 1e3 ELSE a END AS x,
  CASE WHEN a >= 1e6 THEN 2 WHEN a >= 1e3 THEN 1 ELSE 2 END AS d FROM s),
h AS (SELECT *, CASE WHEN d = 1 AND (x * 4) % 2 = 1 OR d = 2 AND (x * 8) % 2 = 1 THEN x + 1e-7 ELSE x END AS y FROM p)
SELECT o_orderkey, CASE WHEN a < 1e3 AND v = floor(v) THEN v::BIGINT::VARCHAR
  WHEN d = 1 THEN sign || printf('%.1f', y) || 'K'
  ELSE sign || printf('%.2f', y) || CASE WHEN a >= 1e9 THEN 'B' WHEN a >= 1e6 THEN 'M' ELSE '' END END AS text FROM h""")
def _(spark, table):
    m, p = F.col("o_orderkey") % 5, F.col("o_totalprice")
    v = (F.when(m == 0, p * 100000).when(m == 1, -p * 100).when(m == 2, p).when(m == 3, F.floor(p / 1000).cast("double"))
         .otherwise(p / 1000))
    return table("orders").select("o_orderkey", C.compact_number(v).alias("text"))


@query("metric_labels", """
SELECT 'SUM' AS metric_group, 'o_totalprice' AS label, round(sum(o_totalprice), 2) AS value FROM orders
UNION ALL SELECT 'AVG', 'o_totalprice', round(avg(o_totalprice), 2) FROM orders
UNION ALL SELECT 'other', 'ROW_COUNT', count(*)::DOUBLE FROM orders
UNION ALL SELECT 'other', 'COLUMN_COUNT', 2.0::DOUBLE""")
def _(spark, table):
    out = kpi_labels(kpis(table("orders").select("o_totalprice", "o_orderstatus")))
    return out.select("metric_group", "label", F.round("value", 2).alias("value"))


@query("trim_extremes", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) lo, quantile_cont(o_totalprice, 0.99) hi FROM orders)
SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice BETWEEN lo AND hi""")
def _(spark, table):
    return series.trim_extremes(table("orders"), "o_totalprice").select("o_orderkey", "o_totalprice")


@query("cardinality_gates", """
SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS "distinct" FROM lineitem HAVING count(DISTINCT l_returnflag) <= 20
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem HAVING count(DISTINCT l_linestatus) <= 20
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem HAVING count(DISTINCT l_shipdate) <= 20""")
def _(spark, table):
    found = profile.low_cardinality(table("lineitem"), 20)
    return spark.createDataFrame(list(found.items()), "column string, distinct bigint")


@query("metric_gates", """
SELECT 'event_id' AS "column", count(event_id) AS numbers FROM events HAVING count(event_id) >= 10 AND min(event_id) < max(event_id)
UNION ALL SELECT 'user_id', count(user_id) FROM events HAVING count(user_id) >= 10 AND min(user_id) < max(user_id)
UNION ALL SELECT 'value', count(value) FROM events HAVING count(value) >= 10 AND min(value) < max(value)""")
def _(spark, table):
    return series.metric_scores(table("events"), "ts")
