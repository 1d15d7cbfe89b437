"""Connected components of links between long ids, by joins only: smallest neighbour, then pointer jumping.

Labels are written to the shared folder after each round, so that a lost executor costs one round at most. A hub
with many links is one side of an equi-join, which adaptive execution can split; no neighbour list is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.session import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, label of every linked id; label is the smallest id reachable. No links: no rows."""
    there = links.select(F.col(a).alias("id"), F.col(b).alias("other"))
    both = stage(there.union(there.select("other", "id")).where("id <> other").distinct(), "links")
    labels = stage(both.groupBy("id").agg(F.min("other").alias("low"))
                   .select("id", F.least("id", "low").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        near = (both.join(labels.select(F.col("id").alias("other"), F.col("label").alias("seen")), "other")
                .groupBy("id").agg(F.min("seen").alias("seen")))
        least = labels.join(near, "id").select("id", "label", F.least("label", "seen").alias("next"))
        ends = labels.select(F.col("id").alias("next"), F.col("label").alias("jump"))
        labels = stage(least.join(ends, "next").select("id", F.least("next", "jump").alias("new"), "label")
                       .select("id", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels")
    return labels.select("id", "label")
