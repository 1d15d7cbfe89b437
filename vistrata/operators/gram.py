"""Sums of products of all pairs of columns over their common rows, by matrix products of Arrow batches in one scan.

With X the values (missing ones as 0), M the mask of present ones and ' the transpose, a batch adds X'X, M'M, X'M and
(X*X)'M: products, counts, sums and squares of every pair over the rows that have both. A task keeps these four
matrices, 32 bytes a pair of columns, whatever the number of rows; they are added up over a tree of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vistrata.session import stage

# Cells of a batch that are multiplied together.
CELLS = 1 << 21
# Columns up to which all sums of a task are small; beyond, the tree's fan follows their size.
NARROW, FAN, FAN_BYTES = 64, 16, 64 << 20
PAIR = "i int, j int, n bigint, sx double, sy double, qx double, qy double, xy double"


def _products(x: np.ndarray) -> np.ndarray:
    """X'X, M'M, X'M and (X*X)'M of rows with NaN for missing values."""
    present = ~np.isnan(x)
    if present.all():
        ones = np.ones(x.shape[1])
        return np.stack((x.T @ x, np.outer(ones, ones) * len(x), np.outer(x.sum(0), ones), np.outer((x * x).sum(0), ones)))
    x, mask = np.where(present, x, 0.0), present.astype(float)
    return np.stack((x.T @ x, mask.T @ mask, x.T @ mask, (x * x).T @ mask))


def _packed(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
    total = None
    for batch in batches:
        for x in batch.column(0):
            part = np.frombuffer(x.as_buffer())
            total = part.copy() if total is None else total + part
    return total


def pair_sums(rows: DataFrame, change: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """i, j (i <= j), n, sx, sy, qx, qy, xy: for columns i and j of `rows` the number of rows that have both, their
    sums, sums of squares and sum of products. All columns are doubles; `change` may replace the values of a batch."""
    k = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        step = max(1, CELLS // k)
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float)
            for a in range(0, len(table), step):
                part = table[a:a + step]
                made = _products(part if change is None else change(part))
                total = made if total is None else total + made
        yield from _packed(total)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _add(batches)
        if total is None:
            total = np.zeros((4, k, k))
        products, counts, sums, squares = total.reshape(4, k, k)
        i, j = np.triu_indices(k)
        cells = [i.astype(np.int32), j.astype(np.int32), counts[i, j].astype(np.int64), sums[i, j], sums[j, i], squares[i, j], squares[j, i], products[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["i", "j", "n", "sx", "sy", "qx", "qy", "xy"])

    made = rows.mapInArrow(run, "sums binary")
    tree = lambda frame, parts: frame.repartition(parts).mapInArrow(lambda b: _packed(_add(b)), "sums binary")
    if k <= NARROW:
        made = tree(made, FAN)
    else:
        made = stage(made, "gram")
        fan = max(2, min(FAN, FAN_BYTES // (32 * k * k)))
        parts = made.count()
        while parts > fan:
            parts = -(-parts // fan)
            made = tree(made, parts)
    return made.repartition(1).mapInArrow(unpack, PAIR)
