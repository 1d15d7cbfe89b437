"""One small literal frame per branch."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vistrata.functions import columns as C
from vistrata.functions import names as N
from vistrata.operators import association, cleaning, counts, groups, histogram, preview, profile, quantiles, series, statistics
from vistrata.plans import charts
from vistrata.plans import query as Q
from vistrata.plans.kpis import kpi_group_figures, kpis
from vistrata.plans.summary import categorical_summary, dataset_profile, profile_text

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def messy(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 10.0, 1, "a", True, t), (1, 10.0, 1, "a", True, t), (2, NAN, 2, None, None, t), (3, INF, None, "b", False, None),
            (4, -INF, 4, "b", True, t), (5, 1e15, 5, "c", True, t), (6, -1e15, 6, "c", False, t), (7, None, 7, "d", True, t)]
    return spark.createDataFrame(rows, "id bigint, amount double, qty int, city string, flag boolean, t timestamp")


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_classes(messy):
    assert C.numeric_columns(messy) == ["id", "amount", "qty"]
    assert C.categorical_columns(messy) == ["city", "flag", "t"]


def test_clean(spark, messy):
    out = cleaning.clean(messy)
    rows = {r["id"]: r for r in out.frame.collect()}
    assert len(rows) == 7
    assert out.frame.schema["qty"].dataType.simpleString() == "double"
    assert rows[2.0]["city"] == "Unknown" and rows[2.0]["flag"] is None and rows[3.0]["t"] is None
    assert all(r["amount"] is not None and abs(r["amount"]) <= 1e12 for r in rows.values())
    assert rows[2.0]["amount"] == 10.0 and rows[3.0]["qty"] == 4.5
    lines = column(out.report.orderBy("position"), "line")
    assert "Duplicates removed: 1" in lines
    assert "Left 1 missing values in flag" in lines
    # Equal quartiles collapse `amount` to one value, so a second run drops it.
    again = cleaning.clean(out.frame)
    assert again.frame.columns == ["id", "qty", "city", "flag", "t"]
    assert again.frame.where("qty IS NULL OR city IS NULL").count() == 0


def test_clean_keeps_excluded_keys(messy):
    out = cleaning.clean(messy, exclude=["id"])
    assert out.frame.schema["id"].dataType.simpleString() == "bigint"
    assert sorted(column(out.frame, "id")) == [1, 2, 3, 4, 5, 6, 7]


def test_maps_are_compared_as_text(spark):
    df = spark.sql("SELECT map('a', 1) AS m, 1 AS v UNION ALL SELECT map('a', 1), 1 UNION ALL SELECT map('b', 1), 1")
    assert cleaning.without_duplicates(df).count() == 2


def test_constant_columns(spark):
    df = spark.createDataFrame([(7.0, 1.0, None), (7.0, 2.0, None)], "a double, b double, c double")
    assert profile.constant_numeric_columns(df) == ["a"]
    assert profile.varying_columns(df) == ["b"]
    one = spark.createDataFrame([(7.0,)], "a double")
    assert profile.constant_numeric_columns(one) == []
    row = statistics.full_statistics(one).first()
    assert (row["std"], row["variance"], row["skewness"], row["kurtosis"], row["count"]) == (0.0, 0.0, None, None, 1)
    same = profile.numeric_profile(spark.createDataFrame([(0.1,)] * 7, "a double")).first()
    assert (same["variance"], same["skewness"], same["kurtosis"]) == (0.0, None, None)


def test_all_missing_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert [r["column"] for r in statistics.full_statistics(df).collect()] == ["b"]
    assert [r["value"] for r in kpis(df).where("metric LIKE '%_a'").collect()] == [None, None]
    assert cleaning.clean(df).report.where("column = 'a'").first()["n"] == 0


def test_iqr_zero_collapses(spark):
    df = spark.createDataFrame([(5.0,)] * 90 + [(float(i),) for i in range(10)], "v double").withColumn(
        "id", F.monotonically_increasing_id())
    assert set(column(cleaning.cap_outliers(df, ["v"]), "v")) == {5.0}


def test_mode_and_top_ties(spark):
    df = spark.createDataFrame([("b", 2.0), ("b", 2.0), ("a", 1.0), ("a", 1.0), ("c", 3.0)], "k string, v double")
    assert counts.modes(df, ["v"]).first()["mode"] == 1.0
    assert column(counts.top_values(df, "k", 2), "value") == ["a", "b"]
    summary = counts.category_summary(counts.value_counts(df, "k")).first()
    assert summary["dominant_category"] == "a" and summary["total_count"] == 5.0


def test_mode_of_negatives(spark):
    df = spark.createDataFrame([(-3.0,), (-3.0,), (-1.0,), (-1.0,), (0.0,)], "v double")
    assert counts.modes(df, ["v"]).first()["mode"] == -3.0


@pytest.mark.parametrize("values, expected", [
    ([0.0, 1.0, 2.0, 3.0, 4.0, 5.0], [1, 1, 1, 1, 2]),
    ([3.0] * 4, [0, 0, 4, 0, 0]),
    ([3.0], [0, 0, 1, 0, 0]),
])
def test_histogram_edges(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert column(histogram.histograms(df).orderBy("bin"), "count") == expected


def test_histogram_labels(spark):
    df = spark.createDataFrame([(0.0,), (10000000.0,)], "v double")
    assert column(histogram.histograms(df).orderBy("bin"), "label")[0] == "0.0 - 2000000.0"


def test_texty_numbers(spark):
    df = spark.createDataFrame([("1", "a"), ("1e3", "b"), ("abc", "c"), ("", None), ("inf", "d"), ("NaN", "e")], "x string, y string")
    out = C.coerce_numeric_columns(df)
    assert column(out, "x") == [1.0, 1000.0, None, None, None, None]
    assert out.schema["y"].dataType.simpleString() == "string"


def test_time_detection(spark):
    df = spark.createDataFrame([("2024-01-02", 5.0, 20240101, "x"), ("1/5/2024", 6.0, 20240102, "12345")],
                               "order_date string, funds double, id bigint, note string")
    assert series.detect_time_column(df) == "order_date"
    scores = {r["column"]: r["score"] for r in series.time_scores(df).collect()}
    assert scores == {"order_date": 12, "funds": 0, "id": 0, "note": 0}
    assert series.detect_time_column(df.select("funds", "id")) is None


@pytest.mark.parametrize("rows, usable", [(19, False), (24, True)])
def test_short_series(spark, rows, usable):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(days=i), float(i), 1.0) for i in range(rows)], "ds timestamp, y double, c double")
    assert (series.prepare_series(df, "ds", ["y", "c"]).count() > 0) is usable


def test_metric_needs_ten_numbers(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(9)], "y double, c double")
    assert series.detect_metrics(df, None) == []


def test_nested_documents(spark):
    df = spark.read.json(spark.sparkContext.parallelize([
        '{"_id": "1", "a": {"b": 1, "c": {"d": 2}}, "e": [1, 2]}', '{"_id": "2", "e": []}']))
    flat = N.drop_document_id(N.flatten(df))
    assert sorted(flat.columns) == ["a.b", "a.c.d", "e"]
    assert sorted(N.flatten(df, depth=1).columns) == ["_id", "a.b", "a.c", "e"]
    assert sorted(N.underscore_names(flat).columns) == ["a_b", "a_c_d", "e"]


@pytest.mark.parametrize("n, limit, shown", [(24, 25, 24), (25, 25, 25), (26, 25, 24), (120, 120, 120), (121, 120, 24)])
def test_series_preview(spark, n, limit, shown):
    df = spark.range(n).select(F.col("id").alias("x"), F.col("id").cast("double").alias("y"))
    out = preview.series_preview(df, ["x"], limit)
    rows = out.orderBy("position").collect()
    assert len(rows) == shown
    assert [r["position"] for r in rows] == [r["x"] for r in rows]
    assert rows[0]["truncated"] is (n > limit) and rows[-1]["x"] == n - 1


@pytest.mark.parametrize("n", [5, 40])
def test_falling_preview(spark, n):
    df = spark.range(n).select((F.col("id") % 20).alias("v"), F.col("id").alias("k"))
    rows = preview.series_preview(df, ["v", "k"], 25, descending=["v"]).orderBy("position").collect()
    want = sorted(((i % 20, i) for i in range(n)), key=lambda t: (-t[0], t[1]))
    want = want if n <= 25 else want[:12] + want[-12:]
    assert [(r["v"], r["k"]) for r in rows] == want


@pytest.mark.parametrize("n, bar, pie", [(10, True, True), (11, True, False), (20, True, False), (21, False, False)])
def test_cardinality_gates(spark, n, bar, pie):
    df = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("c")).unionByName(
        spark.sql("SELECT CAST(NULL AS string) AS c"))
    assert (charts.chart_bars(df)["points"].count() == min(n, 15)) is bar
    assert (charts.chart_pies(df)["points"].count() == n) is pie


def test_shares_sum_to_hundred(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    points = charts.chart_pies(df)["points"]
    assert math.isclose(sum(column(points, "proportion_pct")), 100.0, abs_tol=1e-3)


def test_scatter_uses_first_four_pairs(spark):
    df = spark.range(30).select(*[(F.col("id") * i + F.col("id") % i).cast("double").alias(f"c{i}") for i in range(1, 11)])
    assert association.adjacent_pairs(df) == [("c1", "c2"), ("c2", "c3"), ("c3", "c4"), ("c4", "c5")]


def test_correlation_matrix_is_symmetric(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 1.0, 5.0, 3.0), (3.0, 4.0, 5.0, 9.0), (4.0, 3.0, 5.0, 1.0)],
                               "a double, b double, k double, m double")
    cells = {(r["row_name"], r["column_name"]): r["r"] for r in association.correlation_matrix(df).collect()}
    assert {a for a, _ in cells} == {"a", "b", "m"}
    assert all(cells[a, b] == cells[b, a] for a, b in cells) and all(cells[a, a] == 1.0 for a in ("a", "b", "m"))
    assert cells["a", "b"] == 0.6


def test_constant_side_gives_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    row = association.linear_association(df, [("a", "b")]).first()
    assert row["pearson_r"] is None and row["slope"] == 0.0
    assert association.spearman(df, "a", "b").first()["spearman_r"] is None


def test_group_detail_skips_missing_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 9.0)], "k string, v double")
    rows = {r["category"]: r for r in groups.group_detail(df, "k", "v").collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["median"] == 2.0 and rows["b"]["count"] == 0 and rows["b"]["median"] is None
    assert column(groups.group_means(df, "k", "v"), "category") == ["a", "b"]


def test_percentiles_of_few_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    for limit in (0, 10 ** 6):
        got = quantiles.percentiles(df, ["v"], [0.0, 0.25, 0.5, 1.0], one_pass_values=limit).first()
        assert list(got["values"]) == [1.0, 1.5, 2.0, 4.0] and got["n"] == 3


def test_categorical_summary_of_times(spark, messy):
    rows = {r["column"]: r for r in categorical_summary(messy).collect()}
    assert rows["t"]["unique_values"] == 1 and rows["t"]["missing_count"] == 1
    assert [(t["value"], t["count"]) for t in rows["city"]["top_values"]] == [("a", 2), ("b", 2), ("c", 2), ("d", 1)]


@pytest.mark.parametrize("value, text", [
    (1.25e9, "1.25B"), (2_500_000.0, "2.50M"), (12250.0, "12.3K"), (12350.0, "12.3K"), (-1500.0, "-1.5K"), (42.0, "42"),
    (0.125, "0.13"), (3.14159, "3.14"), (None, None), (999.5, "999.50")])
def test_compact_number(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(C.compact_number(F.col("v"))).first()[0] == text


@pytest.mark.parametrize("value, text", [(3.0, "3"), (2.5, "2.5"), (1e15, "1000000000000000.0"), (0.1234567, "0.123457"), (-7.0, "-7")])
def test_kpi_text(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(C.kpi_text(C.kpi_value(F.col("v")))).first()[0] == text


def test_names(spark):
    df = spark.createDataFrame([("forecast_unit_price",), ("anomaly_visual",), ("hist_x",), ("avg_a_by_b",)], "s string")
    rows = [(r[0], r[1]) for r in df.select(N.display_name(F.col("s")), N.chart_category(F.col("s"))).collect()]
    assert rows == [("Forecast: Unit Price", "forecasting"), ("Anomaly: Anomaly Visual", "anomaly"),
                    ("Hist X", "distribution"), ("Avg A By B", "other")]


def test_shape_of_scalars_and_empty_tables(spark):
    assert Q.shape(5).scalar == 5
    empty = Q.shape(spark.range(0))
    assert empty.table is None and empty.row_count == 0
    full = Q.shape(spark.range(500))
    assert full.rows.count() == 200 and full.row_count == 500 and full.columns == ["id"]


def test_unknown_stage(spark):
    with pytest.raises(ValueError):
        Q.stage_query(spark.range(1), [{"$out": "x"}])


def test_group_without_key(spark):
    row = Q.stage_query(spark.range(4), [{"$group": {"_id": None, "n": {"$sum": 1}, "top": {"$max": "$id"}}}]).first()
    assert (row["_id"], row["n"], row["top"]) == (None, 4, 3)


def test_row_index(spark):
    out = N.with_row_index(spark.createDataFrame([("b",), ("a",), ("b",)], "v string"))
    assert sorted((r["index"], r["v"]) for r in out.collect()) == [(0, "a"), (1, "b"), (2, "b")]
    assert N.with_row_index(spark.range(2).selectExpr("id", "id AS x")).columns == ["id", "x"]


def test_questions_take_only_queries(spark):
    spark.range(3).createOrReplaceTempView("kept")
    assert Q.sql_query(spark, "-- note\n(SELECT count(*) AS n FROM kept)", kept=spark.range(5)).first()["n"] == 5
    assert spark.table("kept").count() == 3
    for statement in ("DROP VIEW kept", "CREATE TABLE x AS SELECT 1", "SET a=1", "WITH q AS (SELECT 1) INSERT INTO kept SELECT * FROM q"):
        with pytest.raises(ValueError):
            Q.sql_query(spark, statement)


def test_stages_unwind_and_refuse(spark):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "x")], "id int, tags array<string>, s string")
    assert Q.stage_query(df, [{"$unwind": "$tags"}, {"$group": {"_id": None, "all": {"$push": "$tags"}}}]).first()["all"] == ["a", "b"]
    assert Q.stage_query(df, [{"$match": {"s": {"$in": [None]}}}]).count() == 1
    assert Q.stage_query(df, [{"$match": {"s": {"$nin": ["x"]}}}, {"$project": {"twice": {"$multiply": ["$id", 2]}}}]).first()["twice"] == 2
    for stages in ([{"$lookup": {}}], [{"$match": {"id": {"$near": 1}}}], [{"$group": {"_id": None, "x": {"$median": "$id"}}}]):
        with pytest.raises(ValueError, match="unsupported"):
            Q.stage_query(df, stages)


def test_pie_only_for_few_slices(spark):
    few, many = (spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")) for n in (10, 11))
    assert [Q.choose_chart("share as pie", d).kind for d in (few, many)] == ["pie", "bar"]


def test_times_are_described_as_times(spark):
    t = datetime(2024, 1, 1, 12, 30, 0, 250_001)
    rows = [(1, t, None), (2, t + timedelta(days=2), None), (3, None, None)]
    df = spark.createDataFrame(rows, "id bigint, t timestamp, u timestamp")
    at = F.date_format("mean", "yyyy-MM-dd HH:mm"), F.date_format("max", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    want = {("t", 2, "2024-01-02 12:30", "2024-01-03 12:30:00.250001"), ("u", 0, None, None)}
    assert set(map(tuple, statistics.describe_times(df).select("column", "count", *at).collect())) == want
    assert set(map(tuple, statistics.describe_times(df, statistics.describe(df)).select("column", "count", *at).collect())) == want
    # Without a numeric column there is no describe table, but times are still told.
    assert {r["count"] for r in dataset_profile(df.drop("id"))["times"].collect()} == {0, 2}
    assert {r["count"] for r in statistics.describe_times(df.limit(0)).collect()} == {0}
    assert statistics.describe_times(df.select("id")).count() == 0
    lines = column(profile_text(dataset_profile(df)).where("line LIKE 't %' AND line LIKE '%mean=%'"), "line")
    assert lines == ["t count=2 mean=2024-01-02T12:30:00 min=2024-01-01T12:30:00 p25=2024-01-02T00:30:00 p50=2024-01-02T12:30:00 "
                     "p75=2024-01-03T00:30:00 max=2024-01-03T12:30:00"]


def test_chart_sections(spark):
    bins = spark.createDataFrame([("a", 0), ("a", 1), ("b.c", 0)], "column string, bin int")
    points = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    made = {"histograms": {"bins": bins}, "scatters": {"association": bins, "points_a_b": points}, "correlation": {},
            "anomaly_scatter": {"normal": points, "anomaly": points.limit(0)}}
    series = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "series string, yhat double")
    index = charts.chart_index(made, series)
    assert {tuple(r) for r in index.collect()} == {
        ("hist_a", "Hist A", "distribution", 2), ("hist_b.c", "Hist B.c", "distribution", 1), ("scatter_a_b", "Scatter A B", "scatter", 1),
        ("anomaly_scatter", "Anomaly: Anomaly Scatter", "anomaly", 1), ("forecast_a", "Forecast: A", "forecasting", 2)}
    sections = charts.chart_sections(index).orderBy("position").collect()
    assert [(r.category, r.charts, r.points) for r in sections] == [("forecasting", 1, 2), ("anomaly", 1, 1), ("scatter", 1, 1), ("distribution", 2, 3)]
    assert charts.chart_sections(charts.chart_index({"scatters": {"points_a_b": points.limit(0)}})).count() == 0


def test_class_fill_and_figures_of_groups(messy):
    got = {r["column"]: (r["class"], r["filled"], r["rows"]) for r in C.class_fill(C.finite_frame(messy)).collect()}
    assert got["amount"] == ("numeric", 4, 8) and got["flag"] == ("categorical", 7, 8) and len(got) == 6
    assert {r["filled"] for r in C.class_fill(messy.limit(0)).collect()} == {0}
    figures = {r.metric_group: r for r in kpi_group_figures(kpis(messy.withColumn("none", F.lit(None).cast("double")))).collect()}
    assert (figures["SUM"].metrics, figures["AVG"].missing, figures["other"].greatest) == (4, 1, 8.0)
