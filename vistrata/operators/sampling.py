"""Bounded row samples by position, so that they do not change with the partitioning."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from vistrata.functions.columns import col
from vistrata.operators.ranks import range_staged, with_running_total

# Runs of rows by the leading bits of their hash: counts of one task are this many rows at most, and a sample of 25,600
# rows reads one run in forty again.
RUN_BITS = 20


def row_hash(df: DataFrame, columns: list[str], seed: int) -> Column:
    """64-bit hash of some columns; maps are hashed by their JSON text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.xxhash64(F.lit(seed), *[F.to_json(col(c)) if isinstance(kinds[c], T.MapType) else col(c) for c in columns])


def _met(placed: DataFrame, size: str, wanted: DataFrame, width: int) -> DataFrame:
    """Rows that stand at `_before` and take `size` positions each, by the wanted positions among these."""
    # Positions meet rows in slots of `width` positions; a row of many positions spans several slots.
    last = F.floor((F.col("_before") + F.col(size) - 1) / width)
    slots = placed.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_before") / width), last)))
    return slots.join(F.broadcast(wanted), "_slot").where(
        (F.col("_position") >= F.col("_before")) & (F.col("_position") < F.col("_before") + F.col(size)))


def drawn_rows(df: DataFrame, columns: list[str], draw: Callable[[int], list[tuple[int, int]]], seed: int = 0) -> tuple[DataFrame, int]:
    """The rows of `columns` at drawn positions, each with its group `_group` and `_hash`; and the number of rows.

    `draw(n)` gives (group, position) pairs, positions from 0 to n - 1; their number must be bounded, since they are
    broadcast. Rows stand in the order of a seeded hash of their values and copies of a row take as many positions as
    there are, so they weigh as in the data at every size.

    The frame is read twice and never shuffled as a whole. The first scan counts rows by run, the leading bits of the
    hash; the second keeps the rows of runs that hold a drawn position. Copies are counted before they are shuffled.
    """
    hashed = df.select(*[col(c) for c in columns], row_hash(df, columns, seed).alias("_hash"))
    hashed = hashed.withColumn("_run", F.shiftright("_hash", 64 - RUN_BITS).cast("int"))
    runs = range_staged(hashed.groupBy("_run").agg(F.count("*").alias("_rows")), ["_run"], "runs")
    n = runs.agg(F.sum("_rows")).first()[0] or 0
    drawn = draw(n)
    if not drawn:
        return hashed.select(F.lit(0).alias("_group"), "_hash", *[col(c) for c in columns]).limit(0), n
    # A slot holds one position on average, so rows of many positions add at most as many slots as there are drawn ones.
    width = max(1, n // len(drawn))
    wanted = df.sparkSession.createDataFrame(
        pd.DataFrame([(g, p // width, p) for g, p in drawn], columns=["_group", "_slot", "_position"]), "_group int, _slot bigint, _position bigint")
    starts = _met(with_running_total(runs, ["_run"], F.col("_rows"), "_before"), "_rows", wanted, width).select("_run", F.col("_before").alias("_start")).distinct()
    # No more runs than drawn positions.
    near = hashed.join(F.broadcast(starts), "_run").groupBy("_run", "_start", "_hash", *[col(c) for c in columns]).agg(F.count("*").alias("_copies"))
    inside = Window.partitionBy("_run").orderBy("_hash", *[col(c) for c in columns]).rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    return _met(placed, "_copies", wanted, width).select("_group", "_hash", *[col(c) for c in columns]), n
