"""Sources and sinks as round trips over the driver tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from vistrata.catalog.aggregates import rounded
from vistrata.catalog.base import query
from vistrata.catalog.columns import NESTED, documents, messy
from vistrata.catalog.models import MADE, made
from vistrata.operators import cleaning
from vistrata.plans import charts, summary
from vistrata.plans.kpis import kpis
from vistrata.session import staging_path
from vistrata.sources import load, sinks


@query("csv_scan", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, table):
    path = staging_path(spark, "customer") + ".csv"
    sinks.write_rows(table("customer"), path)
    return load.load_table(spark, path)


@query("csv_scan_missing_words", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 2 THEN o_totalprice END AS price, o_orderkey % 2 = 0 AS even,
CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS status FROM orders""")
def _(spark, table):
    key = F.col("o_orderkey")
    text = (F.when(key % 5 == 0, "NA").when(key % 5 == 1, "inf").when(key % 5 == 2, "")
            .otherwise(F.col("o_totalprice").cast("string")))
    path = staging_path(spark, "words") + ".csv"
    sinks.write_rows(table("orders").select(
        "o_orderkey", text.alias("price"), F.when(key % 2 == 0, "True").otherwise("False").alias("even"),
        F.when(key % 7 == 0, "null").otherwise(F.col("o_orderstatus")).alias("status")), path)
    return load.load_table(spark, path)


@query("csv_scan_multiline", "SELECT c_custkey, 'Line one' || chr(10) || '\"' || c_name || '\", two' AS note, c_acctbal FROM customer")
def _(spark, table):
    """Line breaks and quotes inside quoted cells."""
    note = F.concat(F.lit('Line one\n"'), "c_name", F.lit('", two'))
    path = staging_path(spark, "multiline") + ".csv"
    table("customer").select("c_custkey", note.alias("note"), "c_acctbal").write.csv(path, header=True, escape='"')
    return load.load_table(spark, path)


@query("csv_scan_codes", """SELECT o_orderkey, (o_orderkey % 9) || substr('dfDF', (o_orderkey % 4)::INT + 1, 1) AS code,
 9000000000000000000 + o_orderkey AS long_id, ('1e' || o_orderkey % 3)::DOUBLE AS power FROM orders""")
def _(spark, table):
    """Codes that end like typed numbers stay text; ids of 19 digits keep every digit."""
    key = F.col("o_orderkey")
    code = F.concat((key % 9).cast("string"), F.substring(F.lit("dfDF"), (key % 4 + 1).cast("int"), F.lit(1)))
    long_id = F.lit(9000000000000000000).cast("bigint") + key
    path = staging_path(spark, "codes") + ".csv"
    sinks.write_rows(table("orders").select("o_orderkey", code.alias("code"), long_id.alias("long_id"),
                                            F.concat(F.lit("1e"), (key % 3).cast("string")).alias("power")), path)
    return load.load_table(spark, path)


def workbook(rows: pd.DataFrame) -> bytes:
    """A minimal workbook: shared, inline, number, boolean and date cells."""
    names = list(rows.columns)
    body = ["<row r='1'>" + "".join(f"<c r='{chr(65 + i)}1' t='inlineStr'><is><t>{escape(n)}</t></is></c>"
                                    for i, n in enumerate(names)) + "</row>"]
    for r, values in enumerate(rows.itertuples(index=False), 2):
        cells = []
        for i, v in enumerate(values):
            place = f"{chr(65 + i)}{r}"
            if isinstance(v, pd.Timestamp):
                cells.append(f"<c r='{place}' s='1'><v>{(v - pd.Timestamp('1899-12-30')) / pd.Timedelta(days=1)}</v></c>")
            elif isinstance(v, str):
                cells.append(f"<c r='{place}' t='inlineStr'><is><t>{escape(v)}</t></is></c>")
            elif v == v and v is not None:
                cells.append(f"<c r='{place}'><v>{v!r}</v></c>" if isinstance(v, float) else f"<c r='{place}'><v>{v}</v></c>")
        body.append(f"<row r='{r}'>{''.join(cells)}</row>")
    main = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f"<workbook {main} xmlns:r='{office}'><sheets><sheet name='First' sheetId='1' r:id='rId1'/></sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>"
                      f"<Relationship Id='rId1' Type='{office}/worksheet' Target='worksheets/sheet1.xml'/></Relationships>")
        book.writestr("xl/styles.xml", f"<styleSheet {main}><cellXfs><xf numFmtId='0'/><xf numFmtId='22'/></cellXfs></styleSheet>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(body)}</sheetData></worksheet>")
    return out.getvalue()


@query("excel_scan", """SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate FROM orders""")
def _(spark, table):
    """Orders packed into one workbook per customer group, and read back."""
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        sheet = part.drop(columns=["g"])
        return pd.DataFrame({"path": [f"{part['g'].iloc[0]}.xlsx"], "content": [workbook(sheet)]})

    rows = table("orders").select((F.col("o_custkey") % 40).alias("g"), "o_orderkey", "o_orderstatus", "o_totalprice",
                                  F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return load.read_workbooks(rows.groupBy("g").applyInPandas(pack, "path string, content binary"))


@query("excel_scan_mixed_headers", """SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END AS s_acctbal FROM supplier""")
def _(spark, table):
    """Workbooks whose columns come in another order, or lack one."""
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        g = part["g"].iloc[0]
        names = ["s_suppkey", "s_name", "s_acctbal"] if g else ["s_name", "s_suppkey"]
        return pd.DataFrame({"path": [f"{g}.xlsx"], "content": [workbook(part[names])]})

    rows = table("supplier").select((F.col("s_suppkey") % 2).alias("g"), "s_suppkey", "s_name", "s_acctbal")
    return load.read_workbooks(rows.groupBy("g").applyInPandas(pack, "path string, content binary")).select("s_suppkey", "s_name", "s_acctbal")


@query("document_scan", NESTED.format("(props::JSON->>'k')::BIGINT"))
def _(spark, table):
    """Nested documents written in two batches, read, flattened, without their id."""
    path = staging_path(spark, "documents")
    docs = documents(table("events"))
    sinks.write_documents(docs.where("event_id % 2 = 0"), path)
    sinks.write_documents(docs.where("event_id % 2 = 1"), path)
    return load.read_documents(spark, path).select("event_id", F.col("`props.k`"), F.col("`who.user.id`"), F.col("`who.kind`"))


@query("document_scan_mixed", """SELECT event_id, CASE WHEN event_id % 10 NOT IN (3, 7) THEN value END AS amount,
CASE event_id % 10 WHEN 3 THEN 'none of it' WHEN 7 THEN '{"of":' || user_id || '}' END AS amount_other,
CASE WHEN event_id % 5 < 3 THEN event_type WHEN event_id % 5 = 3 THEN user_id::VARCHAR ELSE 'true' END AS words FROM events""")
def _(spark, table):
    """Documents whose fields are a number, a text or an object by row."""
    path = staging_path(spark, "mixed")
    e = table("events")
    kind, m = F.col("event_id") % 10, F.col("event_id") % 5
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    amount = (F.when(kind == 3, F.lit('"none of it"')).when(kind == 7, F.concat(F.lit('{"of":'), F.col("user_id").cast("string"), F.lit("}")))
              .otherwise(F.col("value").cast("string")))
    words = F.when(m < 3, quote(F.col("event_type"))).when(m == 3, F.col("user_id").cast("string")).otherwise(F.lit("true"))
    line = F.concat(F.lit('{"_id":"x","event_id":'), F.col("event_id").cast("string"), F.lit(',"in":{"amount":'), amount, F.lit(',"words":'), words, F.lit("}}"))
    e.select(line.alias("value")).write.text(path)
    return load.read_documents(spark, path).select("event_id", F.col("`in.amount`").alias("amount"), F.col("`in.amount_other`").alias("amount_other"),
                                                   F.col("`in.words`").alias("words"))


@query("kpi_sink", """
SELECT 'SUM_p_partkey' AS "Metric", sum(p_partkey)::BIGINT::VARCHAR AS "Value" FROM part
UNION ALL SELECT 'AVG_p_partkey', CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE round(v, 6)::VARCHAR END FROM (SELECT avg(p_partkey) AS v FROM part)
UNION ALL SELECT 'SUM_p_size', sum(p_size)::BIGINT::VARCHAR FROM part
UNION ALL SELECT 'AVG_p_size', CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE round(v, 6)::VARCHAR END FROM (SELECT avg(p_size) AS v FROM part)
UNION ALL SELECT 'ROW_COUNT', count(*)::VARCHAR FROM part UNION ALL SELECT 'COLUMN_COUNT', '2'""")
def _(spark, table):
    path = staging_path(spark, "kpis")
    sinks.write_kpis(kpis(table("part").select("p_partkey", "p_size")), path)
    return spark.read.csv(path, header=True)


@query("anomaly_sink", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, value FROM events WHERE value > 90")
def _(spark, table):
    path = staging_path(spark, "anomalies")
    sinks.write_rows(table("events").where("value > 90").select("event_id", "ts", "value"), path)
    out = spark.read.csv(path, header=True, schema="event_id bigint, ts string, value double")
    return out


@query("forecast_sink", f"""WITH {MADE} SELECT series, strftime(ds, '%Y-%m-%dT%H:%M:%S') AS ds, round(yhat, 2) AS yhat FROM made""")
def _(spark, table):
    path = staging_path(spark, "forecasts")
    sinks.write_forecasts(made(table("orders")).select("series", "ds", "yhat"), path)
    out = spark.read.csv(path, header=True, schema="ds string, yhat double, series string")
    return rounded(out.select("series", "ds", "yhat"), 2, "yhat")


@query("chart_sink", """SELECT 'bar_p_type' AS chart, p_type AS value, count(*) AS count FROM part GROUP BY 2""")
def _(spark, table):
    path = staging_path(spark, "charts")
    points = charts.chart_bars(table("part").select("p_type"))["points"]
    sinks.write_chart_folders(points.withColumn("chart", F.concat(F.lit("bar_"), "column")), path)
    return spark.read.json(path).select("chart", "value", "count")


@query("report_sink", """WITH d AS (SELECT count(*) FILTER (o_orderkey % 10 = 0) AS n FROM orders)
SELECT 'DATA CLEANING REPORT' AS line UNION ALL SELECT 'Dropped constant column fixed' UNION ALL SELECT 'Duplicates removed: ' || n FROM d""")
def _(spark, table):
    path = staging_path(spark, "report")
    df = messy(table("orders")).select("id", "fixed")
    sinks.write_report(cleaning.clean(df).report, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("profile_sink", """SELECT 's_suppkey' AS "column", count(DISTINCT s_suppkey) AS "unique" FROM supplier
UNION ALL SELECT 's_name', count(DISTINCT s_name) FROM supplier UNION ALL SELECT 's_nationkey', count(DISTINCT s_nationkey) FROM supplier
UNION ALL SELECT 's_acctbal', count(DISTINCT s_acctbal) FROM supplier""")
def _(spark, table):
    path = staging_path(spark, "profile")
    sinks.write_json(summary.dataset_profile(table("supplier"))["columns"], path)
    return spark.read.json(path).select("column", "unique")


@query("summary_sink", """SELECT 'c_mktsegment' AS "column", count(DISTINCT c_mktsegment) AS unique_values FROM customer
UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM customer""")
def _(spark, table):
    path = staging_path(spark, "summary")
    sinks.write_json(summary.dataset_summary(table("customer"))["categorical_statistics"], path)
    return spark.read.json(path).select("column", "unique_values")
