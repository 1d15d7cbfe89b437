"""Plans and skew: what must hold when the data is large."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vistrata.operators import cleaning, counts, preview, profile, quantiles, ranks, sampling, series
from vistrata.plans.kpis import kpis
from vistrata.plans.summary import categorical_summary
from vistrata.session import staging_path, staging_root

PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_figures_read_once_and_only_numbers(table):
    text = plan(kpis(table("lineitem")))
    assert text.count("FileScan") == 1
    assert "l_shipdate" not in re.search(r"ReadSchema: struct<[^>\n]*", text).group()
    assert text.count("Exchange") == 1


def test_filters_reach_the_scan(table):
    text = plan(preview.head(table("orders").where("o_totalprice > 400000"), 5, ["o_orderkey"]))
    assert "GreaterThan(o_totalprice,400000.0)" in text
    assert "TakeOrderedAndProject" in text


def test_tails_are_cut_before_the_shuffle(table):
    assert "WindowGroupLimit" in plan(preview.tail_per_series(table("orders"), "o_orderpriority", "o_orderkey", 60))
    assert "WindowGroupLimit" in plan(counts.top_values_per_column(table("part"), ["p_brand", "p_type"], 5))


def test_no_window_over_raw_rows(table):
    parts = ranks.range_staged(table("orders").select("o_totalprice"), ["o_totalprice"], "t")
    text = plan(ranks.with_running_total(parts, ["o_totalprice"], F.lit(1), "before"))
    single = [line for line in text.splitlines() if "Exchange SinglePartition" in line]
    # Only the per-partition totals meet in one task.
    assert len(single) <= 1
    assert "hashpartitioning(_part" in text


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(2)
    n = 30_000
    v = np.where(np.arange(n) % 3 == 0, 1.5, rng.lognormal(2, 3, n))
    g = np.where(np.arange(n) % 3 != 1, 0, rng.integers(1, 200, n))
    return pd.DataFrame({"g": g, "v": v, "w": rng.normal(size=n)})


@pytest.mark.parametrize("buckets", [2, 64, 1000])
def test_percentiles_with_a_hot_value(spark, skewed, buckets):
    df = spark.createDataFrame(skewed).repartition(6)
    got = {r["column"]: list(r["values"]) for r in quantiles.percentiles(
        df, ["v", "w"], PROBS, one_pass_values=0, buckets=buckets).collect()}
    for c in ("v", "w"):
        assert np.allclose(got[c], np.percentile(skewed[c], [100 * p for p in PROBS]), rtol=1e-12)


def test_percentiles_of_a_large_table_with_an_empty_column(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("e", F.lit(None).cast("double")).repartition(6)
    for columns in (["v", "e"], ["e"]):
        got = {r["column"]: list(r["values"]) for r in quantiles.percentiles(df, columns, PROBS, one_pass_values=0).collect()}
        assert sorted(got) == [c for c in columns if c == "v"]
        assert all(np.allclose(got[c], np.percentile(skewed[c], [100 * p for p in PROBS]), rtol=1e-12) for c in got)


def test_series_of_a_large_table_with_a_text_metric(spark, monkeypatch):
    """The text has no numbers, and the table is beyond the size of one pass."""
    monkeypatch.setattr(quantiles, "ONE_PASS_VALUES", 0)
    rows = spark.range(1000).select(F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("y"), F.lit("word").alias("kind"))
    made = series.prepare_series(rows, "ts", ["y", "kind"]).collect()
    assert sorted(r["y"] for r in made) == [float(i) for i in range(10, 990)]
    assert {r["series"] for r in made} == {"y"}


def test_group_percentiles_with_a_hot_group(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(6)
    want = skewed.groupby("g")["v"].quantile([0.25, 0.5]).unstack()
    for limit in (0, 10 ** 9):
        got = {r["g"]: list(r["values"]) for r in quantiles.percentiles(
            df, ["v"], [0.25, 0.5], keys=["g"], one_pass_values=limit).collect()}
        assert set(got) == set(want.index)
        assert all(np.allclose(got[g], want.loc[g], rtol=1e-12) for g in got)


def test_drawn_rows_stage_counts_not_rows(spark, monkeypatch):
    """A third of the rows is one value; positions are those of the rows in the order of hash and value."""
    monkeypatch.setattr(sampling, "RUN_BITS", 5, raising=False)
    staged = []
    monkeypatch.setattr(ranks, "stage", lambda df, label, plain=ranks.stage: staged.append(plain(df, label)) or staged[-1])
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"), F.lit("x").alias("w")).repartition(5)
    wanted = [(g, p) for g in range(2) for p in range(g, 6000, 401)]
    made, n = sampling.drawn_rows(rows, ["v", "w"], lambda n: wanted, seed=3)
    ordered = rows.select(sampling.row_hash(rows, ["v", "w"], 3).alias("h"), "v").orderBy("h", "v").collect()
    assert n == 6000
    assert sorted((r["_group"], r["_hash"], r["v"]) for r in made.collect()) == sorted((g, *ordered[p]) for g, p in wanted)
    assert sum(df.count() for df in staged) <= 32


def test_value_table_positions(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(5)
    values = quantiles.value_table(df, ["v", "w"])
    got = {r["column"]: list(r["values"]) for r in values.percentiles(PROBS).collect()}
    for c in ("v", "w"):
        assert np.allclose(got[c], np.percentile(skewed[c], [100 * p for p in PROBS]), rtol=1e-12)


def test_value_samples_keep_the_weight_of_copies(spark, skewed):
    df = spark.createDataFrame(skewed)
    for n in (3, 8):
        sample = quantiles.value_table(df.repartition(n), ["v", "w"]).sample(2000)
        got = sorted((r["column"], r["value"]) for r in sample.collect())
        assert len(got) == 4000
        hot = sum(1 for c, v in got if c == "v" and v == 1.5)
        assert 580 < hot < 760
        if n == 3:
            first = got
    assert got == first
    few = quantiles.value_table(df.limit(100), ["v"]).sample(2000)
    assert few.count() == 100


def test_summary_reuses_its_shuffle(table):
    assert "ReusedExchange" in plan_run(categorical_summary(table("part")))


def plan_run(df) -> str:
    """Plan after it ran, as exchanges are reused at run time."""
    df.collect()
    return plan(df)


def test_positions_with_unbounded_ties(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("v"))
    out = ranks.global_position(df, "v", "at")
    got = out.agg(F.count_distinct("at"), F.min("at"), F.max("at")).first()
    assert tuple(got) == (9000, 0, 8999)
    assert out.where((F.col("v") == 0) & (F.col("at") >= 3000)).count() == 0


def test_average_ranks(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 1), (3.0, 3)], "value double, count bigint")
    got = {r["value"]: r["rank"] for r in ranks.average_ranks(df, "value", "count").collect()}
    assert got == {1.0: 1.5, 2.0: 3.0, 3.0: 5.0}


class Cluster:
    """The two things staging asks of a session."""

    def __init__(self, master, folder):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder or default)})


def test_staging_folder_is_the_clusters():
    assert staging_root(Cluster("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert staging_root(Cluster("local[2]", "/shared")) == "/shared"
    assert staging_root(Cluster("yarn", None)) is None
    with pytest.raises(ValueError):
        staging_path(Cluster("yarn", None), "x")


def test_exact_gate_ignores_wide_text(spark):
    df = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("long"), (F.col("id") % 4).cast("string").alias("short"))
    assert profile.low_cardinality(df, 20) == {"short": 4}


def rows_twice(spark):
    rows = [(1, 0.0, "a", [1]), (1, -0.0, "a", [1]), (2, float("nan"), None, None), (2, float("nan"), None, None), (3, 1.5, "", []), (4, None, "b", [2, 3])]
    df = spark.createDataFrame(rows * 3 + [(i, float(i), "x", [i]) for i in range(100, 400)], "k int, v double, t string, l array<int>")
    return df.withColumn("s", F.struct("v", "t")).withColumn("m", F.create_map(F.lit("q"), F.col("k")))


@pytest.mark.parametrize("case", ["plain", "collisions", "shuffled"])
def test_duplicates_by_fingerprint(spark, monkeypatch, case):
    """The same rows as comparing all rows whole, when all fingerprints collide and beyond the broadcast limit as well."""
    if case == "collisions":
        monkeypatch.setattr(cleaning, "fingerprint", lambda df: [F.lit(1).cast("bigint"), F.lit(2).cast("bigint")])
    if case == "shuffled":
        monkeypatch.setattr(cleaning, "PRINTS_BROADCAST", 0)
    df = rows_twice(spark)
    want = df.withColumn("m", F.to_json("m")).dropDuplicates()
    got = cleaning.without_duplicates(df)
    assert got.columns == want.columns and got.count() == want.count() == 304
    assert got.exceptAll(want).count() == 0 and cleaning.without_duplicates(df.limit(0)).count() == 0


def test_single_rows_are_never_shuffled(spark, table):
    df = table("lineitem").unionByName(table("lineitem").where("l_orderkey % 100 = 0"))
    made = cleaning.without_duplicates(df)
    text = plan(made)
    # The branch of single rows reads and filters; only the few repeated rows meet in an exchange.
    single = text.split("LeftAnti")[1].split("LeftSemi")[0]
    assert "LeftAnti" in text and "hashpartitioning" not in single and made.count() == table("lineitem").count()
