"""Date layouts of whole columns, chart words, and what counts as a query."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vistrata.operators import layouts, series
from vistrata.plans import query as Q


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def read(spark, values):
    df = column(spark, values)
    return [r["t"] for r in df.select(layouts.time_values(df, "t").alias("t")).collect()]


def test_day_first_holds_for_the_column(spark):
    assert read(spark, ["03/02/2024", "13/02/2024", "01/12/2024"]) == [datetime(2024, 2, 3), datetime(2024, 2, 13), datetime(2024, 12, 1)]
    # Nothing tells: month first.
    assert read(spark, ["03/02/2024", "01/12/2024"]) == [datetime(2024, 3, 2), datetime(2024, 1, 12)]
    # A value of the other order stays unread; other forms are read.
    assert read(spark, ["13/02/2024", "14/02/2024", "02/25/2024", "2024-03-05", "soon", None, "12"]) == [
        datetime(2024, 2, 13), datetime(2024, 2, 14), None, datetime(2024, 3, 5), None, None, None]


@pytest.mark.parametrize("text, want", [
    ("13-02-2024 5:06", datetime(2024, 2, 13, 5, 6)), ("13.02.2024 05:06:07.25", datetime(2024, 2, 13, 5, 6, 7, 250000)),
    ("2/13/2024 5:06 PM", datetime(2024, 2, 13, 17, 6)), ("2/13/2024 5:06:07 am", datetime(2024, 2, 13, 5, 6, 7)),
    ("February 13, 2024", datetime(2024, 2, 13)), ("13-Feb-2024", datetime(2024, 2, 13)), ("2024/2/13 05:06", datetime(2024, 2, 13, 5, 6)),
    ("2024-02-13T05:06:07+02:00", datetime(2024, 2, 13, 3, 6, 7)), ("2/13/2024 05:06+02:00", datetime(2024, 2, 13, 3, 6))])
def test_forms(spark, text, want):
    assert read(spark, [text]) == [want]


def test_report_and_odd_columns(spark):
    df = spark.createDataFrame([("13/02/2024", "x 1", "1", 5), ("02/14/2024", None, "2", 6), ("15/02/2024", "", "3", 7)], "a string, b string, c string, d int")
    made, report = layouts.dates_read(df)
    assert [tuple(r) for r in report.collect()] == [("a", "d/M/yyyy", 2, 3, 3)]
    assert dict(made.dtypes) == {"a": "timestamp", "b": "string", "c": "string", "d": "int"}
    empty, none = layouts.dates_read(df.limit(0))
    assert empty.count() == 0 and none.count() == 0
    assert layouts.dates_read(df.select("d"))[0].columns == ["d"]


def test_series_of_a_day_first_column(spark):
    df = spark.range(1, 60).select(F.date_format(F.date_from_unix_date((F.col("id") + 19000).cast("int")), "dd/MM/yyyy").alias("day"), F.col("id").cast("double").alias("v"))
    assert series.detect_time_column(df) == "day"
    assert series.prepare_series(df, "day", ["v"]).agg(F.countDistinct("ds")).first()[0] == 57


@pytest.mark.parametrize("text, chart", [
    ("visualize a by b", True), ("Visualise the data", True), ("a visualization of it", True), ("charts please", True), ("plotted by day", True),
    ("graphing it", True), ("as shown here", True), ("scatterplot of both", True), ("trends", True), ("how many barcodes", False), ("piece of work", False),
    ("the showroom", False), ("", False), ("graphite sales", False)])
def test_chart_words(text, chart):
    assert bool(Q.CHART_WORDS.search(text)) == chart


@pytest.mark.parametrize("sql, fine", [
    ("/* c */ select /* insert into */ 1", True), ("-- drop table x\nSELECT 'insert into t' AS a", True), ("WITH a AS (SELECT 1 AS x) SELECT * FROM a", True),
    ("(SELECT 1) UNION ALL (SELECT 2)", True), ("VALUES (1), (2)", True), ("FROM range(3) SELECT id", True),
    ("DROP TABLE t", False), ("INSERT INTO t SELECT 1", False), ("WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT * FROM a", False),
    ("FROM range(3) INSERT INTO t SELECT id", False), ("CREATE TABLE t AS SELECT 1", False), ("SET x=1", False), ("INSERT OVERWRITE t VALUES (1)", False)])
def test_queries_and_statements(spark, sql, fine):
    assert Q.is_query(spark, sql) == fine
    if fine:
        assert Q.sql_query(spark, sql).count() > 0
    else:
        with pytest.raises(ValueError):
            Q.sql_query(spark, sql)


def test_scores_count_values_by_the_layouts_that_read_them(spark):
    """One count per set of layouts, not one per layout and column; columns of an empty frame keep their rows."""
    df = spark.createDataFrame([("03/02/2024", "1-URGENT"), ("13/02/2024", None), ("2024-02-01", "x" * 50), (None, "5-LOW 2024")], "a string, b string")
    made = layouts.layout_scores(df)
    rows = {(r["column"], r["layout"]): (r["read"], r["readable"], r["present"]) for r in made.collect()}
    assert len(rows) == 2 * len(layouts.LAYOUTS)
    assert rows["a", "M/d/yyyy"] == (1, 3, 3) and rows["a", "d/M/yyyy"] == (2, 3, 3) and rows["a", "iso"] == (1, 3, 3)
    assert all(x == (0, 0, 3) for (c, _), x in rows.items() if c == "b")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("count_if") + made._jdf.queryExecution().optimizedPlan().toString().count("sum(") <= 4
    assert {tuple(r)[3:] for r in layouts.layout_scores(df.limit(0)).collect()} == {(0, 0, 0)}
