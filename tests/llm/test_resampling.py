"""Bit-sliced importance resampling against a plain form."""

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD, SF_DIR

from vistrata.llm import resampling
from vistrata.llm.arrays import Block

MORE = ODD + [(30, "A b" * 40 + " É" + "é" * 70 + " x"), (31, "tie " * 30), (31, "tie " * 30), (32, "0" * 64 + " " + "1" * 63 + " z" * 25), (33, "\x7f\x00·a")]


def check(made, docs, target):
    want, drawn = brute.resampling(docs, target)
    rows = made.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in rows), key=repr) == sorted(want, key=repr)
    taken = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in taken] == list(range(1, len(drawn) + 1)) and [(r.score, r.doc_id) for r in taken] == drawn


@pytest.mark.parametrize("case", ["odd", "real", "no target"])
def test_against_plain_form(spark, case):
    if case == "real":
        docs, target = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    else:
        docs = spark.createDataFrame(MORE, "doc_id bigint, text string")
        docs = docs.select("*", *(F.lit(c).alias(c) for c in ("weight", "score", "rank", "_down", "_before", "_part", "_tie", "n_words")))
        target = spark.createDataFrame([] if case == "no target" else [(1, None), (2, MORE[6][1]), (2, "TIE tie")], "item_id bigint, text string")
    check(resampling.resampled(docs, target), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()],
          [r.text for r in target.collect()])


def test_checksums_of_pairs():
    text = "one two " + "é" * 31 + " " + "a" * 62 + " " + "b" * 63 + " " + "c" * 64 + " " + "d" * 65 + " z " + "e" * 9000
    raw = np.frombuffer(text.encode(), np.uint8)
    buckets, rows, n = resampling.features(Block(raw, np.array([0, len(raw)]), 0, 1, lower=True))
    assert buckets.tolist() == [zlib.crc32(f.encode()) % resampling.BUCKETS for f in brute.runs_of_words(text)[1]] and n.tolist() == [9]


def test_sums_are_exact_for_any_counts():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 5, (7, resampling.BUCKETS)) * rng.choice([0, 1, 70_000], (7, resampling.BUCKETS))
    gain = rng.integers(-20_000, 20_000, resampling.BUCKETS)
    assert (resampling.sums_of_gains(table, resampling.gain_planes(gain)) == table @ gain).all()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    made = resampling.resampled(none, none)
    assert made.count() == 0 and made.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
