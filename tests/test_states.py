"""Profile states: parts merged are the whole, and sketches keep their stated errors."""

import functools

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.operators import profile, states


@pytest.fixture(scope="module")
def parts(spark):
    items = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    cuts = [F.col("l_orderkey") % 3 == i for i in range(3)]
    return items, [items.where(c) for c in cuts]


def rows(df):
    return {r["column"]: r for r in df.collect()}


def merged(frames):
    return states.merge_states(functools.reduce(DataFrame.unionByName, [states.profile_state(f, f"load {i}") for i, f in enumerate(frames)]))


def test_merged_parts_are_the_whole(parts):
    whole, pieces = parts
    one, many = rows(states.read_states(states.profile_state(whole))), rows(states.read_states(merged(pieces)))
    assert set(one) == set(many) == set(whole.columns)
    for c in one:
        assert (one[c]["rows"], one[c]["missing"], one[c]["min"], one[c]["max"]) == (many[c]["rows"], many[c]["missing"], many[c]["min"], many[c]["max"])
        for f in ("mean", "std"):
            assert (one[c][f] is None) == (many[c][f] is None) and (one[c][f] is None or one[c][f] == pytest.approx(many[c][f], rel=1e-9))
    again = states.merge_states(merged(pieces[:2]).unionByName(states.profile_state(pieces[2], "third")))
    assert {c: r["rows"] for c, r in rows(states.read_states(again)).items()} == {c: r["rows"] for c, r in many.items()}


def test_stated_errors_hold(parts):
    whole, pieces = parts
    exact = {r["column"]: r["distinct"] for r in profile.distinct_counts(whole).collect()}
    got = rows(states.read_states(merged(pieces)))
    n = whole.count()
    for c in whole.columns:
        assert abs(got[c]["distinct"] - exact[c]) <= 4 * states.DISTINCT_ERROR * exact[c] + 0.5
    names = [c for c in whole.columns if got[c]["percentiles"]]
    checks = [(c, p, v) for c in names for p, v in zip(states.PERCENTILES, got[c]["percentiles"])]
    ranks = whole.agg(*[x for i, (c, p, v) in enumerate(checks) for x in (F.count_if(F.col(c) < v).alias(f"a{i}"), F.count_if(F.col(c) <= v).alias(f"b{i}"))]).first()
    assert len(names) == 8
    for i, (c, p, v) in enumerate(checks):
        assert ranks[f"a{i}"] - 2 * states.RANK_ERROR * n <= p * n <= ranks[f"b{i}"] + 2 * states.RANK_ERROR * n


def test_odd_columns(spark):
    df = spark.createDataFrame([(1, None, float("nan"), "x", True), (2, None, 1.5, None, None)], "a int, b double, c double, d string, e boolean")
    got = rows(states.read_states(states.merge_states(states.profile_state(df, "1").unionByName(states.profile_state(df.select("a", "d"), "2")))))
    assert [(got[c]["rows"], got[c]["missing"], got[c]["distinct"]) for c in "abcde"] == [(4, 0, 2), (4, 4, 0), (4, 3, 1), (4, 2, 1), (4, 3, 1)]
    assert got["b"]["mean"] is None and got["b"]["percentiles"] is None and got["c"]["mean"] == 1.5
    empty = states.read_states(states.profile_state(df.limit(0)))
    assert {r["rows"] for r in empty.collect()} == {0}
