"""Exact percentiles with linear interpolation, for whole columns or within groups.

Order statistics are read from counts of distinct values. Below a checked size one window per group does it.
Beyond, two distributed passes keep every task small:

1. count rows per (group, column, bucket); bucket limits come from a small sample and steer balance only;
2. read again only the buckets holding a wanted rank and count their distinct values.

Every shuffle carries counts combined before it, so a value or group holding much of the data stays small.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vistrata.functions.columns import col
from vistrata.operators.profile import known_facts, number_columns
from vistrata.operators.ranks import range_staged, with_running_total
from vistrata.session import stage

ONE_PASS_VALUES = 5_000_000
ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS, MAX_BUCKETS = 64, 16_384
# Buckets of groups that hold a wanted rank, as many as are broadcast.
TARGETS_BROADCAST = 100_000


def percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (),
                one_pass_values: int | None = None, buckets: int | None = None) -> DataFrame:
    """One row per (keys, column) that has values: `keys..., column, n, values` (one per probability).

    Rows with a missing key belong to no group. Whole columns whose value table the frame's facts hold are read there.
    """
    limit = ONE_PASS_VALUES if one_pass_values is None else one_pass_values
    columns, names = list(columns), [f"k{i}" for i in range(len(keys))]
    facts = None if keys else known_facts(df)
    held = [c for c in columns if c in facts.values.columns] if facts and facts.values is not None else []
    if held:
        known, rest = facts.values.only(held).percentiles(probs), [c for c in columns if c not in held]
        return known.unionByName(percentiles(df, rest, probs, (), one_pass_values, buckets)) if rest else known
    wide = df.select(*[col(k).alias(n) for n, k in zip(names, keys)], *number_columns(df, columns))
    for n in names:
        wide = wide.where(F.col(n).isNotNull())
    rows = df.count()
    if rows * len(columns) <= limit:
        out = _one_pass(_long(wide, names, columns), names, probs)
    else:
        out = _two_pass(wide, names, columns, probs, rows, buckets)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], named(columns), "n", "values")


def percentile_dict(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """The same for whole columns, as a few driver scalars to be used as literals."""
    if not columns:
        return {}
    return {r["column"]: list(r["values"]) for r in percentiles(df, columns, probs).collect()}


def named(columns: Sequence[str]) -> Column:
    """Column number -> name."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("ci") + 1).alias("column")


@dataclass
class ValueTable:
    """Distinct values of columns: frame of ci, value, vc, before, n; the columns; their present and distinct values."""
    frame: DataFrame
    columns: list[str]
    sizes: list[int]
    distinct: list[int]

    def percentiles(self, probs: Sequence[float]) -> DataFrame:
        return read_ranks(self.frame, ["ci"], probs).select(named(self.columns), "n", "values")

    def only(self, columns: Sequence[str]) -> ValueTable:
        """The part of some columns, numbered in their order."""
        if list(columns) == self.columns:
            return self
        places = [self.columns.index(c) for c in columns]
        at = (F.array_position(F.array(*map(F.lit, places)), F.col("ci")) - 1).cast("int")
        return ValueTable(self.frame.where(F.col("ci").isin(places)).withColumn("ci", at), list(columns),
                          [self.sizes[i] for i in places], [self.distinct[i] for i in places])

    def named(self) -> DataFrame:
        return self.frame.select(named(self.columns), "value", "vc")

    def sample(self, k: int, seed: int = 0) -> DataFrame:
        """(column, value): k random values of each column, or all when there are no more.

        Random ranks are drawn and looked up, so copies weigh as in the data and the result does not
        depend on partitioning. Ranks meet values in slots of n / k ranks; a value with many copies spans
        several slots, which adds at most k rows per column.
        """
        rows = []
        for i, n in enumerate(self.sizes):
            picked = random.Random(seed * 1_000_003 + i).sample(range(n), k) if n > k else range(n)
            width = max(1, n // k)
            rows += [(i, r // width, r) for r in picked]
        wanted = self.frame.sparkSession.createDataFrame(
            pd.DataFrame(rows, columns=["ci", "slot", "rank"]), "ci int, slot bigint, rank bigint")
        width = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") / k))
        last = F.floor((F.col("before") + F.col("vc") - 1) / width)
        slots = self.frame.withColumn("slot", F.explode(F.sequence(F.floor(F.col("before") / width), last)))
        # k rows per column are broadcast.
        hit = slots.join(F.broadcast(wanted), ["ci", "slot"]).where(
            (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("vc")))
        return hit.select(named(self.columns), "value")


def value_table(df: DataFrame, columns: Sequence[str]) -> ValueTable:
    """Distinct values of each column with counts and positions, staged.

    One shuffle of counts serves percentiles, modes, outliers, ranks and samples alike; the table is
    range-partitioned, so positions come from per-partition totals. A frame that carries facts keeps its table there.
    """
    facts = known_facts(df, columns)
    if facts and facts.values is not None and set(columns) <= set(facts.values.columns):
        return facts.values.only(columns)
    wide = df.select(*number_columns(df, columns))
    counts = _long(wide, [], columns).groupBy("ci", "value").agg(F.count("*").alias("vc"))
    parts = range_staged(counts, ["ci", "value"], "values")
    placed = with_running_total(parts, ["ci", "value"], F.col("vc"), "before")
    found = {r["ci"]: r for r in parts.groupBy("ci").agg(F.sum("vc").alias("n"), F.count("*").alias("values")).collect()}
    sizes, distinct = ([found[i][c] if i in found else 0 for i in range(len(columns))] for c in ("n", "values"))
    extents = df.sparkSession.createDataFrame(
        [(i, sum(sizes[:i]), n) for i, n in enumerate(sizes)], "ci int, start bigint, n bigint")
    frame = placed.join(F.broadcast(extents), "ci").select(
        "ci", "value", "vc", (F.col("before") - F.col("start")).alias("before"), "n")
    # Every reader would sort the values again.
    frame = stage(frame, "positions")
    made = ValueTable(frame, list(columns), sizes, distinct)
    if facts:
        facts.values = made
    return made


def read_ranks(placed: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Percentiles from value, vc, before and n rows: the values at the two ranks around each position."""
    def at(rank: str) -> str:
        return f"max(CASE WHEN {rank} >= before AND {rank} < before + vc THEN value END)"

    pairs = _rank_pairs(probs)
    found = placed.where(_any_rank(pairs, "before", "vc")).groupBy(*group).agg(
        F.max("n").alias("n"), F.expr(f"array({', '.join(at(low) for low, _ in pairs)})").alias("lows"),
        F.expr(f"array({', '.join(at(high) for _, high in pairs)})").alias("highs"))
    values = [
        f"CASE WHEN lows[{i}] = highs[{i}] THEN lows[{i}] ELSE "
        f"(1 - ({_position(p)} - floor({_position(p)}))) * lows[{i}] + ({_position(p)} - floor({_position(p)})) * highs[{i}] END"
        for i, p in enumerate(probs)
    ]
    return found.select(*group, "n", F.expr(f"array({', '.join(values)})").alias("values"))


def _position(p: float) -> str:
    return f"({float(p)!r}D * (n - 1))"


def _rank_pairs(probs: Sequence[float]) -> list[tuple[str, str]]:
    lows = [f"floor{_position(p)}" for p in probs]
    return [(low, f"least({low} + 1, n - 1)") for low in lows]


def _any_rank(pairs: list[tuple[str, str]], start: str, size: str) -> Column:
    """Whether a run of `size` sorted rows from `start` on holds one of the rank pairs."""
    return F.expr(" OR ".join(f"({low} < {start} + {size} AND {high} >= {start})" for low, high in pairs))


def _long(wide: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("ci"), F.col(f"v{i}").alias("value")) for i in range(len(columns))])
    return wide.select(*keys, F.inline(cells)).where("value IS NOT NULL")


def _one_pass(long: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    group = [*keys, "ci"]
    counted = long.groupBy(*group, "value").agg(F.count("*").alias("vc"))
    # Bounded: the whole input is below the checked size.
    whole = Window.partitionBy(*group)
    placed = counted.withColumn("before", F.sum("vc").over(whole.orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("vc")).withColumn("n", F.sum("vc").over(whole))
    return read_ranks(placed, group, probs)


def _limits(wide: DataFrame, columns: Sequence[str], rows: int, buckets: int) -> list[list[float]]:
    """Inner bucket limits of each column, from a sample sized by the number of buckets; a column without a sampled
    value has one limit, since there must be one."""
    share = min(1.0, 100.0 * buckets / max(rows, 1))
    sample = wide.sample(fraction=share, seed=7) if share < 1.0 else wide
    at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    got = sample.agg(*[F.percentile_approx(f"v{i}", at, 10 * buckets).alias(f"v{i}")
                       for i in range(len(columns))]).first()
    return [sorted(set(got[f"v{i}"] or [0.0])) for i in range(len(columns))]


def _two_pass(wide: DataFrame, keys: list[str], columns: Sequence[str], probs: Sequence[float],
              rows: int, buckets: int | None) -> DataFrame:
    if buckets is None:
        buckets = int(min(MAX_BUCKETS, max(MIN_BUCKETS, rows // ROWS_PER_BUCKET)))
    k = len(columns)
    bucketed = Bucketizer(
        splitsArray=[[float("-inf"), *edge, float("inf")] for edge in _limits(wide, columns, rows, buckets)],
        inputCols=[f"v{i}" for i in range(k)], outputCols=[f"b{i}" for i in range(k)],
        handleInvalid="keep",
    ).transform(wide)
    cells = F.array(*[
        F.struct(F.lit(i).alias("ci"), F.col(f"b{i}").cast("int").alias("bucket"), F.col(f"v{i}").alias("value"))
        for i in range(k)
    ])
    long = bucketed.select(*keys, F.inline(cells)).where("value IS NOT NULL")

    group = [*keys, "ci"]
    histogram = long.groupBy(*group, "bucket").agg(F.count("*").alias("c"))
    # At most one row per bucket and group.
    whole = Window.partitionBy(*group)
    placed = histogram.withColumn("start", F.sum("c").over(whole.orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("c")).withColumn("n", F.sum("c").over(whole))
    targets = placed.where(_any_rank(_rank_pairs(probs), "start", "c")).select(*group, "bucket", "start", "n")
    where = [*group, "bucket"]
    many = False
    if keys:
        # At most two buckets per probability, column and group.
        targets = stage(targets, "targets")
        many = targets.count() > TARGETS_BROADCAST
    if many:
        # Too many groups to broadcast their targets: count first, so that no raw row is shuffled and copies of one
        # value are one row before they meet a target.
        counted = long.groupBy(*where, "value").agg(F.count("*").alias("vc")).join(targets, where)
    else:
        counted = (long.join(F.broadcast(targets), where)
                   .groupBy(*where, "start", "n", "value").agg(F.count("*").alias("vc")))
    inside = Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return read_ranks(counted.withColumn("before", F.col("start") + F.sum("vc").over(inside) - F.col("vc")),
                      group, probs)
