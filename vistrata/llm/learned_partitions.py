"""Approximate nearest neighbours by learned partitions: largest inner product, exact scores on what is searched.

1. A bounded sample (SAMPLE rows by hash) is joined to its neighbours by inner product; the graph is cut into balanced
   parts by growing regions and moving nodes to the part of most neighbours while there is room.
2. A small classifier (softmax of linear scores) learns a row's part, and for queries the parts of their neighbours.
   To rows it shows the vector over the largest norm M with sqrt(1 - |x|^2 / M^2) as one more component, to queries the
   unit vector and 0, so that long vectors are found as well.
3. Every row goes to its most probable part. A part of more than SPLIT rows gets a graph, parts and a classifier of its own,
   fitted in a task to a bounded sample of its distinct vectors, and so on: a tree of routers, in a distributed table,
   whose leaves do not grow with the table. A part without enough distinct vectors to divide stays as it is.
4. Leaves are dealt to blocks of BLOCK rows, whatever their ids; a part that holds a third of all rows is many blocks. At
   each router a query goes to the most probable parts, until these sum up to the mass that brought held-out sample rows
   a recall of AIM (over all levels) among each other, rows the classifier has not seen, and at the root until they hold
   more than k rows. Queries that still find fewer than k candidates are sent to all parts.
5. A task holds one block at a time and streams the queries sent to it, 20 best per query and block go on.

Scores are sums of products in double precision in one order for every row, so equal vectors tie exactly.

Defined cases: vectors that are null, zero, hold a null or non-finite component, or are not of the commonest length
take no part, nor do rows without a vec_id; rows repeated with one vec_id are candidates each, and one query; fewer
candidates than k are all returned; further columns are ignored; an empty table gives an empty result. The number of
parts follows the rows, one for each PART_ROWS up to PARTS at each router.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistrata.llm.arrays import mix
from vistrata.session import stage

SAMPLE, PARTS, PART_ROWS, NEIGHBOURS = 8192, 32, 512, 10
# Recall wanted among held-out sample rows, their share, and the masses tried for it.
AIM, HELD_OUT = 0.96, 0.25
MASSES = [0.5, 0.7, 0.8, 0.9, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 1.0]
BLOCK = 8192
EPOCHS = 100
# Rows above which a part is divided, levels of routers, children a path has room for (a child of path p is p * WIDTH + its number).
SPLIT, DEPTH, WIDTH = 16_384, 10, 64
# Parts up to which their sizes are broadcast (16 bytes each); rows that meet a copy of their router in one task.
LOOKED_UP, SLICE = 1_000_000, 262_144


def usable(table: DataFrame) -> DataFrame:
    """vec_id, vector (double) of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & fine & F.exists("vector", lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").select("n").limit(1)
    return rows.join(F.broadcast(length), F.size("vector") == F.col("n")).drop("n")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten())
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row, itself excluded."""
    k = min(k, len(vectors) - 1)
    out = np.empty((len(vectors), k), np.int64)
    for a in range(0, len(vectors), 1024):
        scores = vectors[a:a + 1024] @ vectors.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        out[a:a + 1024] = np.argpartition(-scores, k - 1, 1)[:, :k] if k else out[a:a + 1024]
    return out


def balanced_parts(near: np.ndarray, parts: int, passes: int = 8) -> np.ndarray:
    """A part for each node: regions grown to equal size, then moves to the part of most neighbours within 10 % more."""
    n = len(near)
    links: list[list[int]] = [row.tolist() for row in near]
    for i, row in enumerate(near.tolist()):
        for j in row:
            links[j].append(i)
    size, most = -(-n // parts), int(1.1 * -(-n // parts)) + 1
    part, seed = np.full(n, -1), 0
    for p in range(parts):
        pull: dict[int, int] = {}
        queue: list[tuple[int, int]] = []
        for _ in range(size):
            node = -1
            while queue:
                weight, i = heapq.heappop(queue)
                if part[i] < 0 and pull[i] == -weight:
                    node = i
                    break
            if node < 0:
                while seed < n and part[seed] >= 0:
                    seed += 1
                if seed == n:
                    break
                node = seed
            part[node] = p
            for j in links[node]:
                if part[j] < 0:
                    pull[j] = pull.get(j, 0) + 1
                    heapq.heappush(queue, (-pull[j], j))
    held = np.bincount(part, minlength=parts)
    for _ in range(passes):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[links[i]], minlength=parts)
            to = int(np.argmax(np.where(held < most, votes, -1)))
            if votes[to] > votes[part[i]]:
                held[part[i]] -= 1
                held[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Probabilities of parts for rows and for queries."""

    def __init__(self, sample: np.ndarray, longest: float, parts: int, aim: float = AIM):
        self.longest, self.parts, self.aim = longest, max(1, min(parts, len(sample) // 8, WIDTH - 1)), aim
        # The sample comes in any order but that of its values.
        order = np.argsort(mix(sample.view(np.uint64)).sum(1, dtype=np.uint64), kind="stable")
        aside = sample[order[:int(HELD_OUT * len(sample))]] if self.parts > 1 else sample[:0]
        sample = sample[order[len(aside):]]
        near = neighbour_graph(sample, NEIGHBOURS)
        part = balanced_parts(near, self.parts) if near.size else np.zeros(len(sample), np.int64)
        own = np.eye(self.parts)[part]
        asked = own[near].mean(1) if near.size else own
        shown = np.concatenate((self.row(sample), self.query(sample)))
        wanted = np.concatenate((own, asked))
        self.weights = np.zeros((shown.shape[1], self.parts))
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for t in range(1, EPOCHS + 1):  # full-batch Adam
            slope = shown.T @ (self.chances(shown) - wanted) / len(shown)
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            self.weights -= 0.5 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.mass = self._needed(aside)

    @classmethod
    def known(cls, longest: float, parts: int, fitted: np.ndarray) -> Router:
        """A router from what `fitted` gave."""
        made = cls.__new__(cls)
        made.longest, made.parts, made.weights, made.mass = longest, parts, fitted[:-1].reshape(-1, parts), fitted[-1]
        return made

    def fitted(self) -> np.ndarray:
        return np.append(self.weights.ravel(), self.mass)

    def _needed(self, aside: np.ndarray) -> float:
        """The least mass at which rows outside the fit find `aim` of their neighbours among themselves."""
        if len(aside) <= NEIGHBOURS:
            return 1.0
        near = neighbour_graph(aside, NEIGHBOURS)
        part = self.chances(self.row(aside)).argmax(1)
        chances = self.chances(self.query(aside))
        # What is more probable than a neighbour's part is searched before it.
        own = np.take_along_axis(chances, part[near], 1)
        before = np.stack([(chances * (chances > own[:, j:j + 1])).sum(1) for j in range(own.shape[1])], 1)
        return next((m for m in MASSES if (before < m).mean() >= self.aim), 1.0)

    def row(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return np.column_stack((x, rest, np.ones(len(x))))

    def query(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
        return np.column_stack((x, np.zeros(len(x)), np.ones(len(x))))

    def chances(self, shown: np.ndarray) -> np.ndarray:
        scores = shown @ self.weights
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)


def learn(rows: DataFrame, parts: int = PARTS, sample: int = SAMPLE) -> Router | None:
    """A router fitted to at most `sample` rows; None for an empty table."""
    squares = rows.select(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("n"))
    scale, n = squares.agg(F.max("n"), F.count("*")).first()
    if scale is None:
        return None
    # The hash bound lets about twice the sample through, so that tasks send few rows to the driver.
    mark = F.xxhash64("vec_id")
    some = rows if n <= 2 * sample else rows.where(mark < int(-(2.0**63) + 2 * sample / n * 2.0**64))
    some = some.orderBy(mark, "vec_id").limit(sample).toArrow()
    parts = min(parts, -(-n // PART_ROWS))
    levels, left = 1, n / parts
    while left > SPLIT and levels < DEPTH:
        levels, left = levels + 1, left / PARTS
    return Router(np.unique(_matrix(some.column("vector")), axis=0), float(np.sqrt(scale)), parts, AIM ** (1 / levels))


def index(rows: DataFrame, router: Router) -> DataFrame:
    """vec_id, spread (a number of its own), vector and part, from 1 on, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.chances(router.row(_matrix(batch.column(2)))).argmax(1) + 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["vec_id", "spread", "vector", "part"])

    return rows.select("vec_id", F.monotonically_increasing_id().alias("spread"), "vector").mapInArrow(
        run, "vec_id bigint, spread bigint, vector array<double>, part bigint")


def routes(queries: DataFrame, router: Router, held: np.ndarray, k: int, everywhere: bool) -> DataFrame:
    """query_id, vector and part, for each part of the root a query is sent to; `held` has the rows of each part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, at = _asked(router, _matrix(batch.column(1)), everywhere, held, k)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(at + 1)],
                                                 names=["query_id", "vector", "part"])

    return queries.mapInArrow(run, "query_id bigint, vector array<double>, part bigint")


def _asked(router: Router, vectors: np.ndarray, everywhere: bool, held: np.ndarray | None = None, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and part of each part that a query is sent to."""
    chances = router.chances(router.query(vectors))
    order = np.argsort(-chances, 1)
    sorted_chances = np.take_along_axis(chances, order, 1)
    wanted = (np.cumsum(sorted_chances, 1) - sorted_chances < router.mass) | everywhere
    if held is not None:
        wanted |= np.cumsum(held[order], 1) - held[order] <= k
    row, at = np.nonzero(wanted)
    return row, order[row, at]


def _beside(rows: DataFrame, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the figures of their part, a staged table: broadcast up to LOOKED_UP parts, shuffled beyond."""
    return rows.join(F.broadcast(sizes) if sizes.count() <= LOOKED_UP else sizes, "part", how)


def split(placed: DataFrame, level: int, longest: float, aim: float, sample: int = SAMPLE) -> DataFrame:
    """part, parts, fitted: a router for each part of a level that holds more than SPLIT rows and can be divided."""
    counted = placed.where(F.col("part") >= WIDTH ** (level - 1)).groupBy("part").agg(F.count("*").alias("rows"))
    sizes = stage(counted.where(F.col("rows") > SPLIT), "sizes")
    # About twice the sample of a part's distinct vectors at most, which meet in one task.
    low = F.xxhash64("vector") / 2.0**64 + 0.5 < 2.0 * sample / F.col("rows")
    some = _beside(placed.where(F.col("part") >= WIDTH ** (level - 1)), sizes).where(low).select("part", "rows", "vector").distinct()
    most, part_rows = PARTS, PART_ROWS

    def fit(table: pa.Table) -> pa.Table:
        vectors = np.unique(_matrix(table.column("vector")), axis=0)
        first = np.argsort(mix(vectors.view(np.uint64)).sum(1, dtype=np.uint64), kind="stable")[:sample]
        parts = min(most, -(-table.column("rows")[0].as_py() // part_rows))
        router = Router(vectors[np.sort(first)], longest, parts, aim)
        made = [(table.column("part")[0].as_py(), router.parts, router.fitted().tolist())] if router.parts > 1 else []
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made) if made else ([], [], []), (pa.int64(), pa.int64(), pa.list_(pa.float64())))],
                        names=["part", "parts", "fitted"])

    return some.groupBy("part").applyInArrow(fit, "part bigint, parts bigint, fitted array<double>")


def descend(rows: DataFrame, routers: DataFrame, longest: float, ask: bool, everywhere: bool = False) -> DataFrame:
    """The staged rows, those in a part with a router in its parts: the most probable one, or those that a query asks."""
    payload = [c for c in rows.columns if c not in ("part", "vector")]
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    sizes = stage(sizes.join(routers.select("part"), "part"), "sizes")
    known = _beside(rows, sizes, "left")
    moving = known.where("slices IS NOT NULL").select(
        "part", F.pmod(F.xxhash64(*payload, "vector"), F.col("slices")).alias("slice"), F.lit(1).alias("role"), *payload, "vector")
    guides = routers.join(sizes, "part").select(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"),
        *[F.col("parts").alias(c) for c in payload], F.col("fitted").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = None
        for batch in batches:
            part, number, role = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (number[1:] != number[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(part)]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                vectors = _matrix(piece.column(3 + len(payload)))
                if role[a] == 0:
                    router = Router.known(longest, piece.column(3)[0].as_py(), vectors[0])
                    continue
                row, child = _asked(router, vectors, everywhere) if ask else (
                    np.arange(len(vectors)), router.chances(router.row(vectors)).argmax(1))
                columns = [c.take(pa.array(row)) for c in piece.columns[3:]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(part[a] * WIDTH + child + 1)], names=[*payload, "vector", "part"])

    schema = ", ".join(f"{c} bigint" for c in payload) + ", vector array<double>, part bigint"
    moved = (guides.union(moving).repartition("part", "slice").sortWithinPartitions("part", "slice", "role").mapInArrow(run, schema))
    return known.where("slices IS NULL").select(*payload, "vector", "part").unionByName(moved)


@dataclass
class Index:
    """A tree of routers over placed rows."""
    router: Router
    placed: DataFrame
    held: np.ndarray
    sizes: DataFrame
    levels: list[DataFrame] = field(default_factory=list)

    def sent(self, asked: DataFrame, k: int, everywhere: bool = False) -> DataFrame:
        """query_id, vector and part, for each leaf a query is sent to."""
        out = routes(asked, self.router, self.held, k, everywhere)
        for routers in self.levels:
            out = descend(stage(out, "sent"), routers, self.router.longest, True, everywhere)
        return out


def build(rows: DataFrame, router: Router) -> Index:
    """Place every row by a tree below the given router."""
    def counted(placed: DataFrame) -> DataFrame:
        return stage(placed.groupBy("part").agg(F.count("*").alias("rows")), "sizes")

    placed = stage(index(rows, router), "index")
    sizes = counted(placed)
    held = np.zeros(router.parts, np.int64)
    for r in sizes.collect():  # a row per part of the root
        held[r.part - 1] = r.rows
    made = Index(router, placed, held, sizes)
    largest = held.max(initial=0)
    while largest > SPLIT and len(made.levels) < DEPTH - 1:
        level = len(made.levels) + 1
        routers = stage(split(made.placed, level, router.longest, router.aim), "routers")
        if routers.isEmpty():
            break
        made.levels.append(routers)
        made.placed = stage(descend(made.placed, routers, router.longest, False), "index")
        made.sizes = counted(made.placed)
        largest = made.sizes.where(F.col("part") >= WIDTH**level).agg(F.max("rows")).first()[0] or 0
    return made


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order."""
    return (rows * query).sum(1)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each query (vec_id, vector)."""
    rows = stage(rows, "vectors")
    router = router or learn(rows)
    if router is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    made = build(rows, router)
    asked = stage(queries.select(F.col("vec_id").alias("query_id"), "vector").dropDuplicates(), "queries")
    found = stage(_search(made, made.sent(asked, k), k), "found")
    if router.parts > 1:
        # Every query's results, and every repeated query's, have to number k.
        enough = found.groupBy("query_id", "mark").count().groupBy("query_id").agg(F.min("count").alias("least")).where(F.col("least") >= k)
        lacking = stage(asked.join(enough, "query_id", "left_anti"), "lacking")
        if not lacking.isEmpty():
            again = _search(made, made.sent(lacking, k, True), k)
            found = found.join(lacking.select("query_id").distinct(), "query_id", "left_anti").select(*found.columns).unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def _search(made: Index, sent: DataFrame, k: int) -> DataFrame:
    """query_id, mark (of the query's vector), rank, vec_id, score: the k best in the leaves that queries are sent to."""
    blocks = F.ceil(F.col("rows") / BLOCK)
    sent = _beside(sent, made.sizes).select(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"), F.lit(1).alias("role"), "query_id", "vector")
    held = _beside(made.placed, made.sizes).select(
        "part", F.pmod(F.xxhash64("spread"), blocks).alias("block"), F.lit(0).alias("role"), "vec_id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []
        for batch in batches:
            part, block, role, name = (np.asarray(batch.column(i)) for i in range(4))
            made = _matrix(batch.column(4))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (role[1:] != role[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(part)]):
                if a == b:
                    continue
                if (part[a], block[a]) != key:
                    key, ids, vectors = (part[a], block[a]), [], []
                if role[a] == 0:
                    ids.append(name[a:b].copy())
                    vectors.append(made[a:b].copy())
                elif ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    for c in range(a, b, 256):
                        asked = made[c:min(c + 256, b)]
                        rough = asked @ vectors[0].T
                        # The query's own row is no candidate; rough scores near the k-th are scored again exactly.
                        rough[name[c:c + len(asked), None] == ids[0]] = -np.inf
                        for q, score, own in zip(asked, rough, name[c:c + len(asked)]):
                            low = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
                            slack = 1e-9 * (1 + np.abs(score[np.isfinite(score)]).max(initial=0))
                            at = np.flatnonzero((score >= low - slack) & np.isfinite(score))
                            exact = products(vectors[0][at], q)
                            best = np.lexsort((ids[0][at], -exact))[:k]
                            out.append((np.full(len(best), own), ids[0][at[best]], exact[best], np.full(len(best), mix(q.view(np.uint64)).sum().view(np.int64))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "vec_id", "score", "mark"])

    meet = (held.union(sent).repartition("part", "block").sortWithinPartitions("part", "block", "role")
            .mapInArrow(run, "query_id bigint, vec_id bigint, score double, mark bigint"))
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return (meet.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "mark", "rank", "vec_id", "score"))


def self_search(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Neighbours of each row whose vec_id is divisible by `every`, among all other rows."""
    rows = usable(table)
    return nearest(rows, rows.where(F.col("vec_id") % every == 0), k)
