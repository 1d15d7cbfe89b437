"""Seeded isolation forest (Liu, Ting & Zhou 2008).

Trees grow in parallel, one Spark group per tree, from bounded samples by position. The node table is
small (100 trees of at most 511 nodes) and is broadcast; scoring ships only the numeric columns to Python
in Arrow batches and touches every row once.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.functions.columns import col, numeric_columns
from vistrata.operators.cleaning import MODEL_PREFIX, impute_for_model
from vistrata.operators.profile import numeric_profile
from vistrata.operators.quantiles import percentile_dict
from vistrata.operators.sampling import drawn_rows
from vistrata.session import stage

# Forest size, rows per tree and share of rows flagged.
TREES = 100
ROWS_PER_TREE = 256
CONTAMINATION = 0.05
EULER = 0.5772156649015329

NODE_SCHEMA = "tree int, node int, feature int, threshold double, path double"


@dataclass
class Forest:
    features: list[str]
    nodes: DataFrame
    rows_per_tree: int


@dataclass
class Detection:
    scored: DataFrame
    threshold: float
    features: list[str]

    @property
    def labelled(self) -> DataFrame:
        return self.scored.drop("anomaly_score")

    @property
    def anomalies(self) -> DataFrame:
        return anomaly_rows(self.scored).drop("anomaly_score")


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int, float, float]]:
    """(node, feature, threshold, path) rows; children of node i are 2i + 1 and 2i + 2, leaves have feature -1."""
    deepest = max(1, math.ceil(math.log2(max(len(x), 2))))
    rows, open_nodes = [], [(0, np.arange(len(x)), 0)]
    while open_nodes:
        node, members, depth = open_nodes.pop()
        part = x[members]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
        varying = np.flatnonzero(high > low)
        if depth == deepest or varying.size == 0:
            rows.append((node, -1, math.inf, depth + average_path(len(members))))
            continue
        feature = int(rng.choice(varying))
        threshold = float(rng.uniform(low[feature], high[feature]))
        threshold = min(threshold, float(np.nextafter(high[feature], low[feature])))
        left = part[:, feature] <= threshold
        rows.append((node, feature, threshold, 0.0))
        open_nodes += [(2 * node + 1, members[left], depth + 1), (2 * node + 2, members[~left], depth + 1)]
    return rows


def fit(df: DataFrame, features: list[str], trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE,
        seed: int = 0) -> Forest:
    """Grow the trees, each from `rows_per_tree` rows drawn without repetition out of all rows; trees may share rows."""
    def draw(n: int) -> list[tuple[int, int]]:
        return [(t, p) for t in range(trees)
                for p in random.Random(seed * 1_000_003 + t).sample(range(n), min(n, rows_per_tree))]

    sample, n = drawn_rows(df, features, draw, seed)
    if n == 0:
        raise ValueError("no rows to grow trees from")
    placed = stage(sample.withColumnRenamed("_group", "tree"), "forest")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values(["_hash", *features])
        x = ordered[features].to_numpy(dtype=float)
        out = pd.DataFrame(grow_tree(x, np.random.default_rng([seed, tree])),
                           columns=["node", "feature", "threshold", "path"])
        out.insert(0, "tree", tree)
        return out

    return Forest(features, placed.groupBy("tree").applyInPandas(grow, NODE_SCHEMA), min(n, rows_per_tree))


def _arrays(forest: Forest):
    """Node table as arrays of full trees; what lies below a leaf repeats the leaf's path."""
    nodes = forest.nodes.toPandas()
    trees = np.unique(nodes["tree"].to_numpy())
    depth = max(1, math.ceil(math.log2(max(forest.rows_per_tree, 2))))
    width = 2 ** (depth + 1) - 1
    feature = np.zeros((len(trees), width), dtype=np.int64)
    threshold = np.full((len(trees), width), np.inf)
    path = np.zeros((len(trees), width))
    leaf = np.zeros((len(trees), width), dtype=bool)
    at = (np.searchsorted(trees, nodes["tree"].to_numpy()), nodes["node"].to_numpy())
    is_leaf = nodes["feature"].to_numpy() < 0
    feature[at] = np.maximum(nodes["feature"].to_numpy(), 0)
    threshold[at] = nodes["threshold"].to_numpy()
    path[at] = nodes["path"].to_numpy()
    leaf[at] = is_leaf
    for i in range(2 ** depth - 1):
        for child in (2 * i + 1, 2 * i + 2):
            path[:, child] = np.where(leaf[:, i], path[:, i], path[:, child])
            leaf[:, child] |= leaf[:, i]
    return feature, threshold, path, depth


def score(df: DataFrame, forest: Forest, name: str = "anomaly_score") -> DataFrame:
    """Adds the score 2^(-mean path / expected path) of each row; near 1 means isolated early."""
    model = df.sparkSession.sparkContext.broadcast(_arrays(forest))
    expected = average_path(forest.rows_per_tree) or 1.0

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, threshold, path, depth = model.value
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
            total = np.zeros(len(x))
            for f, t, p in zip(feature, threshold, path):
                node = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (flat[first + f[node]] > t[node])
                total += p[node]
            yield pd.Series(np.exp2(-total / len(feature) / expected))

    # A small input in few partitions would leave cores idle; a large one has partitions enough.
    parallel = df.sparkSession.sparkContext.defaultParallelism
    spread = df.repartition(parallel) if df.rdd.getNumPartitions() < parallel else df
    return spread.withColumn(name, scores(*[col(c).cast("double") for c in forest.features]))


def detect(df: DataFrame, contamination: float = CONTAMINATION, seed: int = 0, trees: int = TREES,
           rows_per_tree: int = ROWS_PER_TREE) -> Detection:
    """Impute, grow, score and label: -1 above the (1 - contamination) score percentile, else 1.

    The scored frame is staged, since the threshold and every later stage read it.
    """
    filled, features = impute_for_model(df)
    if not features:
        raise ValueError("no varying numeric column to score")
    inputs = [f"{MODEL_PREFIX}{c}" for c in features]
    forest = fit(filled, inputs, trees, rows_per_tree, seed)
    scored = stage(score(filled, forest).drop(*inputs), "scored")
    threshold = percentile_dict(scored, ["anomaly_score"], [1.0 - contamination])["anomaly_score"][0]
    label = F.when(F.col("anomaly_score") > threshold, -1).otherwise(1)
    return Detection(scored.withColumn("anomaly", label), threshold, features)


def anomaly_rows(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("anomaly") == -1)


def anomaly_sample(detection: Detection, n: int = 10) -> DataFrame:
    """The n most isolated rows."""
    order = [F.desc("anomaly_score"), *[col(c) for c in detection.features]]
    return anomaly_rows(detection.scored).orderBy(*order).limit(n)


def anomaly_overview(anomalies: DataFrame, columns: int | None = None) -> DataFrame:
    """column, mean, min, max, std of the numeric columns of the flagged rows, 4 places; the first few on demand."""
    profile = numeric_profile(anomalies, numeric_columns(anomalies)[:columns])
    return profile.select(
        "position", "column", *[F.round(c, 4).alias(c) for c in ("mean", "min", "max")],
        F.when(F.col("count") > 1, F.round("std", 4)).alias("std"))


def anomaly_header(anomalies: DataFrame) -> DataFrame:
    """One row: how many rows are flagged, the columns, and the numeric ones."""
    words = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return anomalies.agg(F.count("*").alias("count")).select(
        "count", words(anomalies.columns).alias("columns"), words(numeric_columns(anomalies)).alias("numeric_columns"))
