"""Properties of fitted models and closed-form values."""

import math
import random
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vistrata.functions.formulas import correlation_p, normal_quantile, shapiro_francia_p, shapiro_wilk
from vistrata.operators import association, forecast, groups, isolation, profile, quantiles, sampling, series, statistics
from vistrata.plans.dashboard import dashboard
from vistrata.plans.kpis import kpis
from vistrata.plans.summary import dataset_shape


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x, y = np.concatenate([rng.normal(0, 1, 1000), rng.normal(25, 1, 20)]), np.concatenate(
        [rng.normal(0, 1, 1000), rng.normal(-25, 1, 20)])
    return spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "planted": [False] * 1000 + [True] * 20}))


def test_planted_outliers_rank_first(planted):
    found = isolation.detect(planted)
    top = found.scored.orderBy(F.desc("anomaly_score")).limit(20)
    assert top.where("planted").count() == 20
    assert found.anomalies.count() == 51
    assert found.anomalies.where("planted").count() == 20
    assert set(found.labelled.columns) == {"x", "y", "planted", "anomaly"}


def test_labels_do_not_depend_on_partitioning(planted):
    def labels(n):
        return sorted((r["x"], r["anomaly"]) for r in isolation.detect(planted.repartition(n)).scored.collect())

    assert labels(3) == labels(7)


def test_seed_changes_trees(planted):
    a, b = (sorted(map(tuple, isolation.fit(planted, ["x", "y"], trees=3, seed=s).nodes.collect())) for s in (0, 1))
    assert a != b


def test_missing_values_are_scored_but_kept(spark):
    df = spark.range(300).select(F.when(F.col("id") % 10 != 0, F.sin("id")).alias("v"), F.cos("id").alias("w"))
    scored = isolation.detect(df).scored
    assert scored.where("v IS NULL").count() == 30
    assert scored.where("anomaly_score IS NULL").count() == 0


def test_large_sample_gives_each_tree_its_own_rows(spark):
    df = spark.range(5000).select(F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    made = isolation.fit(df, ["a", "b"], trees=10, rows_per_tree=64)
    assert made.nodes.select("tree").distinct().count() == 10
    assert made.nodes.where("node > 126").count() == 0


@pytest.mark.parametrize("k", [2999, 3000, 5999, 6000, 6001, 12_000])
def test_sample_weighs_copies_as_the_data(spark, k):
    """Half of all rows are copies of one row; they are half of a sample of any size, below and above the row count."""
    df = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))

    def draw(n):
        return [(0, p) for p in random.Random(3).sample(range(n), min(n, k))]

    sample, n = sampling.drawn_rows(df, ["v"], draw)
    assert n == 6000 and sample.count() == min(k, 6000)
    copies = sample.where("v = -1").count()
    assert abs(copies - min(k, 6000) / 2) < 120
    assert sample.where("v <> -1").distinct().count() == min(k, 6000) - copies


def wave(days, slope=2.0):
    start = datetime(2024, 1, 1)
    return [("s", start + timedelta(days=t), slope * t + 5 * math.sin(2 * math.pi * t / 7)) for t in range(days)]


def test_line_and_week_are_recovered(spark):
    df = spark.createDataFrame(wave(200), "series string, ds timestamp, y double")
    rows = forecast.forecast(df).orderBy("ds").collect()
    assert len(rows) == 30
    assert [r["ds"] for r in rows] == [datetime(2024, 1, 1) + timedelta(days=200 + i) for i in range(30)]
    for i, r in enumerate(rows):
        t = 200 + i
        assert abs(r["yhat"] - (2 * t + 5 * math.sin(2 * math.pi * t / 7))) < 1.0
        assert abs(r["trend"] - 2 * t) < 1.0
        assert r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"]


def test_interval_widens_and_covers(spark):
    rng = np.random.default_rng(3)
    rows = [("s", datetime(2024, 1, 1) + timedelta(days=t), 100 + t + rng.normal(0, 10)) for t in range(300)]
    out = forecast.forecast(spark.createDataFrame(rows, "series string, ds timestamp, y double")).orderBy("ds").collect()
    widths = [r["yhat_upper"] - r["yhat_lower"] for r in out]
    assert widths == sorted(widths) and 20 < widths[0] < 32
    assert abs(out[0]["yhat"] - 400) < 20


def test_copies_of_a_time_weigh(spark):
    rows = [("s", datetime(2024, 1, 1) + timedelta(days=t % 40), float(t % 40)) for t in range(400)]
    out = forecast.forecast(spark.createDataFrame(rows, "series string, ds timestamp, y double")).orderBy("ds").first()
    assert out["ds"] == datetime(2024, 2, 10) and abs(out["yhat"] - 40) < 0.5


def test_summary_and_tail(spark):
    rows = [("s", datetime(2024, 1, 1) + timedelta(days=i), 10.0 + i, 9.0 + i, 12.0 + i, float("inf")) for i in range(70)]
    df = spark.createDataFrame(rows, "series string, ds timestamp, yhat double, yhat_lower double, yhat_upper double, trend double")
    kept = forecast.collect_forecasts(df)
    assert kept.count() == 60 and kept.where("trend IS NOT NULL").count() == 0
    row = forecast.forecast_summary(kept).first()
    assert row["last_forecast"] == 79.0 and row["uncertainty"] == 1.5
    assert math.isclose(row["trend_pct"], 59 / 20 * 100)


@pytest.mark.parametrize("values, w, p", [
    ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.79, 0.0067),
    (list(range(1, 11)), 0.9702, 0.8924),
])
def test_shapiro_wilk(values, w, p):
    got = shapiro_wilk(np.array(values, dtype=float))
    assert abs(got[0] - w) < 5e-3 and abs(got[1] - p) < 2e-3


def test_shapiro_wilk_bounds():
    assert shapiro_wilk(np.ones(10)) == (1.0, 1.0)
    skewed = shapiro_wilk(np.exp(np.linspace(0, 8, 500)))
    assert skewed[1] < 1e-10
    w, p = shapiro_wilk(np.array([1.0, 2.0, 4.0]))
    assert 0.75 < w <= 1 and 0 < p < 1


# Two-sided t quantiles from standard tables: (degrees of freedom, t, p).
@pytest.mark.parametrize("df, t, p", [(1, 12.706, 0.05), (5, 2.571, 0.05), (10, 3.169, 0.01), (30, 1.697, 0.10), (120, 2.617, 0.01)])
def test_correlation_p(df, t, p):
    r = t / math.sqrt(df + t * t)
    assert abs(correlation_p(r, df + 2) - p) < 1e-4
    assert correlation_p(1.0, 10) == 0.0 and correlation_p(None, 10) is None


def test_moments_match_numpy(spark):
    x = np.random.default_rng(5).lognormal(3, 1, 2000) + 1e6
    row = profile.numeric_profile(spark.createDataFrame(pd.DataFrame({"v": x}))).first()
    d = x - x.mean()
    assert math.isclose(row["variance"], x.var(ddof=1), rel_tol=1e-9)
    assert math.isclose(row["skewness"], (d ** 3).mean() / (d ** 2).mean() ** 1.5, rel_tol=1e-8)
    assert math.isclose(row["kurtosis"], (d ** 4).mean() / (d ** 2).mean() ** 2 - 3, rel_tol=1e-8)


def test_spearman_with_a_hot_value(spark, monkeypatch):
    """A third of x is one value; ranks come through both the broadcast and the shuffled side."""
    rng = np.random.default_rng(8)
    x = np.where(np.arange(3000) % 3 == 0, 7.0, rng.normal(size=3000).round(2))
    y = x * 0.3 + rng.normal(size=3000).round(3)
    pdf = pd.DataFrame({"x": x, "y": y})
    want = pdf["x"].rank().corr(pdf["y"].rank())
    df = spark.createDataFrame(pdf)
    assert math.isclose(association.spearman(df, "x", "y").first()["spearman_r"], want, rel_tol=1e-9)
    monkeypatch.setattr(association, "BROADCAST_ROWS", 10)
    assert math.isclose(association.spearman(df, "x", "y").first()["spearman_r"], want, rel_tol=1e-9)


def test_ranks_join_only_the_columns_that_memory_does_not_hold(spark, monkeypatch):
    """x and w have few values and are looked up; y, with a value that a third of its rows hold, is joined."""
    monkeypatch.setattr(association, "BROADCAST_ROWS", 50)
    staged = {}
    monkeypatch.setattr(association, "stage", lambda df, label, plain=association.stage: staged.setdefault(label, plain(df, label)))
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"x": rng.integers(0, 9, 2000) / 2, "y": np.where(np.arange(2000) % 3 == 0, -0.0, rng.normal(size=2000)), "w": rng.integers(0, 5, 2000) * 1.0})
    pdf["x"] += (pdf["y"] > 0.5) * 3
    df = spark.createDataFrame(pdf).withColumn("w", F.when(F.col("w") < 4, F.col("w"))).repartition(5)
    pdf.loc[pdf["w"] == 4, "w"] = None
    made = association.spearman_pairs(df, [("x", "y"), ("x", "w")]).collect()
    assert [r["n"] for r in made] == [2000, int(pdf["w"].count())]
    for r in made:
        both = pdf[[r["x_name"], r["y_name"]]].dropna().rank()
        assert math.isclose(r["spearman_r"], both.iloc[:, 0].corr(both.iloc[:, 1]), rel_tol=1e-9)
    assert staged["ranks"].select("ci").distinct().count() == 1


def test_value_table_sorts_its_values_once(spark):
    values = quantiles.value_table(spark.range(100).withColumnRenamed("id", "v"), ["v"])
    assert "Window" not in values.frame._jdf.queryExecution().executedPlan().toString()
    assert values.percentiles([0.5]).first()["values"] == [49.5]


def test_dashboard(spark, table):
    board = dashboard(table("orders"), exclude=["o_orderkey", "o_custkey"])
    assert board.cleaned.count() == 1500
    assert board.labelled.where("anomaly = -1").count() == 75
    assert board.forecasts.groupBy("series").count().where("count = 30").count() == 3
    assert {"o_orderstatus", "o_orderpriority"} == {r["column"] for r in board.charts["bars"]["summary"].collect()}
    assert board.profile["columns"].where("column = 'anomaly'").count() == 1
    assert board.kpis.where("metric LIKE '%anomaly%'").count() == 0
    assert series.detect_time_column(board.cleaned) == "o_orderdate"


def plain_fit(rows, horizon=30):
    """The model's own least squares on whole rows, in one matrix."""
    start, end = min(r[0] for r in rows), max(r[0] for r in rows)
    times = sorted({r[0] for r in rows})
    spacing = min((b - a for a, b in zip(times, times[1:])), default=math.inf)
    scale = max(abs(np.mean([y for t, y in rows if t == x])) for x in times) or 1.0
    changes = min(25, max(1, int(len(times) * 0.8) - 1))
    seasons = [s for s in forecast.SEASONS if end - start >= s[3] and spacing < s[4]]

    def terms(days):
        t = (days - start) / (end - start)
        out = [t * 5.0] + [np.maximum(t - 0.8 * (j + 1) / changes, 0) * 0.05 for j in range(changes)]
        for _, period, order, _, _ in seasons:
            out += [f(2 * math.pi * k * days / period) * 10.0 for k in range(1, order + 1) for f in (np.sin, np.cos)]
        return np.stack(out, 1)

    def ridge(x, y, penalty):
        centred = x - x.mean(0)
        b = np.linalg.solve(centred.T @ centred / len(y) + penalty * np.eye(x.shape[1]), centred.T @ (y - y.mean()) / len(y))
        return y.mean() - x.mean(0) @ b, b, np.mean((y - y.mean() - centred @ b) ** 2)

    days, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows]) / scale
    x = terms(days)
    keep = [0, *range(1 + changes, x.shape[1])]
    rough = ridge(x[:, keep], y, 1e-9)[2]
    a, b, _ = ridge(x, y, max(rough / len(y), 1e-10))
    return (a + terms(end + np.arange(1.0, horizon + 1)) @ b) * scale


def test_grouped_fit_is_the_plain_fit(spark, monkeypatch):
    """Series of many lengths, spread over tasks so that long ones span several, against one matrix per series."""
    rng, rows = np.random.default_rng(8), []
    for s, (n, copies) in enumerate([(2, 1), (3, 2), (15, 1), (40, 3), (800, 2), (1500, 1)]):
        rows += [(f"s{s}", 19000 + t, float(10 * s + 0.1 * t + 3 * math.sin(t / 7) + rng.normal())) for t in range(n) for _ in range(copies)]
    df = spark.createDataFrame(rows, "series string, day int, y double").select("series", F.date_from_unix_date("day").cast("timestamp").alias("ds"), "y")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = forecast.forecast(df).orderBy("series", "ds").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s in range(6):
        want = plain_fit([(d, y) for name, d, y in rows if name == f"s{s}"])
        got = [r["yhat"] for r in made if r["series"] == f"s{s}"]
        assert len(got) == 30 and np.allclose(got, want, rtol=1e-5, atol=1e-4)


def jobs(spark, run):
    spark.sparkContext.setJobGroup(name := f"group {random.random()}", name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_number_of_jobs_does_not_follow_the_series(spark):
    def series(n):
        return spark.range(30 * n).select((F.col("id") % n).cast("string").alias("series"),
                                          F.date_from_unix_date((F.col("id") / n).cast("int")).cast("timestamp").alias("ds"), F.col("id").cast("double").alias("y"))

    few, many = (jobs(spark, lambda n=n: forecast.forecast(series(n)).collect()) for n in (3, 500))
    assert many <= few + 2


def test_series_without_name_or_with_one_time(spark):
    rows = [(None, datetime(2024, 1, i), 1.0) for i in range(1, 9)] + [("one", datetime(2024, 1, 1), 1.0)] * 3 + [
        ("flat", datetime(2024, 1, i), 0.0) for i in range(1, 4)]
    out = forecast.forecast(spark.createDataFrame(rows, "series string, ds timestamp, y double"))
    assert {r["series"] for r in out.select("series").distinct().collect()} == {"flat"}
    assert out.agg(F.max(F.abs("yhat"))).first()[0] < 1e-9
    assert forecast.forecast(out.limit(0).select("series", "ds", F.col("yhat").alias("y"))).count() == 0


def wide_frame(spark, k, rows, gaps):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(rows, k)).cumsum(1).round(2) + 1e5
    if gaps:
        x[rng.random(x.shape) < 0.2] = np.nan
        x[:, 3] = 5.0
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(k)]))


@pytest.mark.parametrize("k, gaps", [(70, False), (300, True)])
def test_matrix_of_many_columns(spark, k, gaps):
    df = wide_frame(spark, k, 120, gaps)
    want = df.toPandas().drop(columns=["c3"] if gaps else []).corr()
    got = association.correlation_matrix(df.repartition(20)).toPandas().pivot(index="row_name", columns="column_name", values="r")
    got = got.loc[want.index, want.columns].to_numpy()
    assert np.nanmax(np.abs(got - want.to_numpy())) < 2e-6 and (np.isnan(got) == want.isna().to_numpy()).all()


def test_number_of_scans_does_not_follow_the_columns(spark):
    few, many = (jobs(spark, lambda k=k: association.correlation_matrix(wide_frame(spark, k, 50, False)).collect()) for k in (5, 60))
    assert few == many


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_ranks_of_all_pairs(spark, monkeypatch, limit):
    """Ties, gaps and a value holding a third of the rows, by look-up and by join, in a fixed number of jobs."""
    monkeypatch.setattr(association, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({f"c{i}": np.where(np.arange(900) % 3 == 0, 7.0, rng.normal(size=900).round(1)) for i in range(6)})
    pdf["c1"] += pdf["c0"]
    pdf.loc[rng.random(900) < 0.3, "c2"] = None
    pdf.loc[rng.random(900) < 0.3, "c4"] = None
    df = spark.createDataFrame(pdf).repartition(5)
    pairs = [(a, b) for a in pdf for b in pdf if a < b] + [("c4", "c2")]
    for r in association.spearman_pairs(df, pairs).collect():
        both = pdf[[r["x_name"], r["y_name"]]].dropna().rank()
        want = both.iloc[:, 0].corr(both.iloc[:, 1])
        assert r["n"] == len(both) and math.isclose(r["spearman_r"], want, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r["spearman_p_value"], correlation_p(want, len(both)), rel_tol=1e-6, abs_tol=1e-12)
    assert association.spearman_pairs(df, pairs).count() == 16
    few, many = (jobs(spark, lambda p=p: association.spearman_pairs(df, p).collect()) for p in (pairs[:2], pairs))
    assert abs(few - many) <= 1


def plain_francia(x):
    x, n = np.sort(x), len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    return float((m * (x - x.mean())).sum() ** 2 / ((m * m).sum() * ((x - x.mean()) ** 2).sum()))


@pytest.mark.parametrize("limit", [4096, 3])
def test_normality_over_all_values(spark, monkeypatch, limit):
    """Against sorted values in one list: bell, skewed, tied, a value holding a third, gaps; runs scored singly and as integrals."""
    monkeypatch.setattr(statistics, "SINGLE_SCORES", limit)
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"bell": rng.normal(5, 2, 9000), "skew": rng.lognormal(0, 1, 9000), "tied": rng.normal(0, 3, 9000).round(),
                        "hot": np.where(np.arange(9000) % 3 == 0, 0.5, rng.normal(size=9000)), "flat": 3.0})
    pdf.loc[rng.random(9000) < 0.2, "tied"] = np.nan
    got = {r["column"]: r for r in statistics.normality_all(spark.createDataFrame(pdf)).collect()}
    for c in ("bell", "skew", "tied", "hot"):
        want = plain_francia(pdf[c].dropna().to_numpy())
        assert got[c]["n"] == pdf[c].count() and abs(got[c]["francia_stat"] - want) < (1e-9 if limit > 3 else 2e-4)
    assert got["bell"]["is_normal_distribution"] and not any(got[c]["is_normal_distribution"] for c in ("skew", "tied", "hot", "flat"))


def test_normal_quantile_and_francia_p():
    u = np.concatenate((np.linspace(1e-9, 1 - 1e-9, 1001), [1e-300, 1e-15, 0.075, 0.925]))
    assert np.allclose(normal_quantile(u), [NormalDist().inv_cdf(x) for x in u], rtol=1e-12, atol=1e-12)
    # Normal samples are refused about as often as the level says.
    rng = np.random.default_rng(2)
    refused = sum(shapiro_francia_p(plain_francia(rng.normal(size=50)), 50) < 0.05 for _ in range(400))
    assert 8 <= refused <= 36 and shapiro_francia_p(0.9, 4) is None and shapiro_francia_p(1.0, 9) == 1.0


def test_short_columns_have_no_normality(spark):
    df = spark.createDataFrame([(float(i), None if i else 1.0) for i in range(4)], "a double, b double")
    assert statistics.normality_all(df).count() == 0


def test_facts_give_what_scans_give(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.normal(1e6, 3, 4000), "b": rng.integers(0, 9, 4000), "c": 5.0, "d": np.nan, "t": rng.choice(["x", "y", None], 4000)})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("t", F.when(F.col("t") != "NaN", F.col("t")))
    known = profile.with_facts(df.select("*"))
    for moments in (False, True):
        got, want = (profile.numeric_profile(x, moments=moments).orderBy("position").collect() for x in (known, df))
        for g, w in zip(got, want):
            assert all((x is None) == (y is None) and (x is None or x == y or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9)) for x, y in zip(g, w))
    for ask in (lambda x: sorted(map(tuple, profile.missing_counts(x).collect())), lambda x: profile.low_cardinality(x, 20),
                lambda x: [tuple(r) for r in dataset_shape(x).collect()]):
        assert ask(known) == ask(df)
    assert [r["metric"] for r in kpis(known).collect()] == [r["metric"] for r in kpis(df).collect()]
    empty = profile.with_facts(df.limit(0))
    assert dataset_shape(empty).first()["rows"] == 0 and profile.numeric_profile(empty).count() == profile.numeric_profile(df.limit(0)).count()


def test_dashboard_profiles_each_frame_once(spark, table, monkeypatch):
    """One scan gathers the figures of the cleaned frame and one more those of the label; cleaning and anomalies aside,
    no step scans for them again."""
    gathered, scanned = [], []
    gather, per_column = profile.gather_facts, profile.per_column
    monkeypatch.setattr(profile, "gather_facts", lambda df: gathered.append(df.columns) or gather(df))
    monkeypatch.setattr(profile, "per_column", lambda df, *a, **b: scanned.append(df.columns) or per_column(df, *a, **b))
    board = dashboard(table("orders"), exclude=["o_orderkey", "o_custkey"])
    assert gathered == [board.cleaned.columns, ["anomaly"]]
    # Cleaning looks at the raw frame, the overview at the flagged rows, the profile at the times.
    assert len(scanned) <= 5
    assert board.profile["statistics"].count() == 5 and len(board.frames()) > 25


def test_dashboard_counts_values_and_groups_once(spark, table, monkeypatch):
    """One value table serves statistics, ranks, series and profile; one pair of scans serves all metrics of a category."""
    made, keyed = [], []
    staged, within = quantiles.range_staged, groups.percentiles
    monkeypatch.setattr(quantiles, "range_staged", lambda df, by, label, *a: made.append(label) or staged(df, by, label, *a))
    monkeypatch.setattr(groups, "percentiles", lambda df, columns, *a, **b: keyed.append(len(columns)) or within(df, columns, *a, **b))
    orders = table("orders")
    board = dashboard(orders, exclude=["o_orderkey", "o_custkey"])
    assert made == ["values"] and keyed == [3, 3]
    fresh = board.labelled.select("*")
    known = {r["column"]: r["unique"] for r in board.profile["columns"].collect()}
    assert known == {r["column"]: r["distinct"] for r in profile.distinct_counts(fresh).collect()}
    levels = lambda described: {r["column"]: (r["p25"], r["p50"], r["p75"]) for r in described.collect()}
    assert levels(board.profile["statistics"]) == levels(statistics.describe(fresh))
    cells = board.charts["group_means"]["avg_o_totalprice_by_o_orderstatus"]["per_group_detail"]
    exact = lambda detail: {r["category"]: (r["min"], r["max"], r["count"], r["median"]) for r in detail.collect()}
    assert exact(cells) == exact(groups.group_detail(fresh, "o_orderstatus", "o_totalprice"))


def test_distinct_counts_of_a_value_table_are_those_of_the_column(spark):
    """Whole numbers that doubles merge, and columns with NaN, are counted themselves."""
    df = spark.createDataFrame([(2**53 + i, float(i % 2), float("nan") if i == 3 else -0.0, i) for i in range(4)],
                               "wide bigint, x double, gaps double, i int").repartition(2)
    known = profile.with_facts(df.select("*"))
    quantiles.value_table(known, ["wide", "x", "gaps", "i"])
    tell = lambda x: {r["column"]: r["distinct"] for r in profile.distinct_counts(x).collect()}
    assert tell(known) == tell(df) == {"wide": 4, "x": 2, "gaps": 2, "i": 4}
    assert set(profile._known_distinct(known)) == {"x", "i"}
    levels = lambda x: {r["column"]: (r["n"], list(r["values"])) for r in quantiles.percentiles(x, ["i", "x"], [0.01, 0.5]).collect()}
    assert levels(known) == levels(df)


@pytest.mark.parametrize("gap", [False, True])
def test_series_of_a_known_frame_are_those_of_the_plain_one(spark, gap):
    """Percentiles are the column's own only where every row has a time; numbers are read by their type."""
    df = spark.range(200).select(
        F.when((F.col("id") > 20) | F.lit(not gap), F.timestamp_seconds(F.col("id") * 86_400)).alias("at"),
        (F.col("id") % 50 * 1.1).alias("x"), F.when(F.col("id") % 7 == 0, F.col("id") % 60).alias("n"))
    known = profile.with_facts(df.select("*"))
    quantiles.value_table(known, ["x", "n"])
    made = [sorted(map(str, series.prepare_series(d, "at", ["n", "x"]).collect())) for d in (known, df)]
    assert made[0] == made[1] and made[0]
    assert "RLIKE" not in series.metric_scores(df, "at")._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit", [0, 1000])
def test_group_percentiles_beyond_one_pass_on_both_sides_of_the_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "TARGETS_BROADCAST", limit)
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1009).cast("double").alias("v"), (F.col("id") % 2).alias("w"))
    got = quantiles.percentiles(df, ["v", "w"], [0.1, 0.5], keys=["k"], one_pass_values=10, buckets=16)
    want = quantiles.percentiles(df, ["v", "w"], [0.1, 0.5], keys=["k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ("strategy=broadcast" in got._jdf.queryExecution().optimizedPlan().toString()) is (limit > 0)
