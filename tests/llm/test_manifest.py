"""Merkle manifest against a plain form."""

import brute
import pytest
from pyspark.sql import functions as F

from vistrata.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
KINDS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def audited(spark, rows):
    docs = spark.createDataFrame(rows, KINDS)
    # Columns whose names the operator uses inside.
    docs = docs.select("*", *(F.lit(c).alias(c) for c in ("g", "pos", "n", "node", "at", "block", "top", "root", "siblings", "leaf", "_part")))
    return sorted((tuple(r) for r in merkle.audited(docs).collect()), key=repr)


def rows_of(n, lang, start=0):
    return [(start + i, f"s{i % 3}", lang, i, f"text {i} é") for i in range(n)]


ODD = [(1, None, None, None, None), (2, "s", None, 4, ""), (3, "s", "en", 0, "ü\n \x00"), (None, "s", "en", 2, "no id"), (None, "s", "en", 2, "no id"),
       (3, "s", "en", 0, "ü\n \x00"), (3, "s", "en", 0, "other"), (-5, "s", "", 7, "x" * 300_000), (4, "s", "é", 2**63 - 1, "-"), (5, "s", "z", 1, "1:-")]


@pytest.mark.parametrize("rows", [
    ODD, rows_of(1, "en"), rows_of(2, None), rows_of(65, "en") + rows_of(64, "de", 500) + rows_of(1, "fr", 900),
    ODD + rows_of(300, "en", 100),
], ids=["odd", "one", "two", "uneven", "rounds"])
def test_against_plain_form(spark, rows):
    assert audited(spark, rows) == sorted(brute.merkle(rows), key=repr)


def test_more_rounds_and_languages_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", 2)
    rows = rows_of(70, "en") + [(1000 + i, "s", f"l{i:02d}", i, "t") for i in range(19)]
    assert audited(spark, rows) == sorted(brute.merkle(rows), key=repr)


def test_empty_table(spark):
    assert audited(spark, []) == []


def test_windows_hold_one_block(spark, capsys):
    """No window is partitioned by language alone, and the levels of a round share one shuffle."""
    docs = spark.createDataFrame(rows_of(10, "en"), KINDS)
    nodes = docs.select(F.col("lang").alias("g"), F.lit(10).cast("bigint").alias("n"), F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("node"))
    merkle._round(nodes).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "hashpartitioning(g" in plan and ", block" in plan
