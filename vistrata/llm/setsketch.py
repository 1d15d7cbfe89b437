"""Near-duplicates by SetSketch: register banding, joint likelihood estimate, exact check, connected components.

A text's set of word shingles is summed up by M registers. Register i holds floor(1 - log_B(min h_i)), cut to 16 bits,
where h_i are exponential variates of rate RATE, one per shingle; two sketches merge by the larger registers. Texts
whose registers agree in a whole band are candidates; the likelihood of the register order (greater, less, equal) at
the known set sizes estimates their similarity, and pairs near the limit or above are checked on the full sets.

Classes first: texts with one and the same set share a class, found by a 128-bit sum over the set, so copies cost one
row each. Within a band's bucket each class meets the bucket's smallest class only, so a bucket of n classes gives
n - 1 pairs. Then, for buckets that still hold several components, the classes outside the bucket's leading component
meet all others of the bucket in memory-bounded blocks, where pairs with enough equal registers are checked on the full
sets; a block sends on one link for each two components that it joins, so never more links than classes. Every pair
that shares a band is thus either checked, ruled out by its registers, or joined already. At similarity 0.8 a pair
shares no band with probability (1 - 0.8^4)^24 = 3e-6.

Defined cases: a null or wordless text has an empty set, links with nothing and is kept; fewer words than the shingle
length make one shingle of the whole sequence; rows repeated with one doc_id get one row each; a null doc_id is never
the smallest unless a whole component has none, and such rows are kept; further columns are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistrata.llm.arrays import Block, blocks, flat, grams, mix
from vistrata.llm.components import components
from vistrata.session import stage

M, ROWS = 96, 4
BANDS = M // ROWS
B, RATE, LAST = 1.001, 20.0, 65535
# Estimates below the limit by more than this (five standard errors of the estimate at 0.8) are not checked.
MARGIN = 0.2
# Classes, and shingles of theirs, of one side of a meeting in one task.
MEET, SHINGLES = 2000, 1_000_000
# Texts checked against one centre in one task.
CHECKED = 1000

SEEDS = mix(np.arange(1, 2 * M + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)).astype(np.uint32).reshape(2, M)
SEEDS[1] |= np.uint32(1)


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes ordered by row and value, and their rows."""
    starts, ends, rows = block.words()
    words = block.hashes(starts, ends)
    values, at = grams(words, rows, size)
    where = rows[at]
    few = np.bincount(rows, minlength=block.rows)[rows] < size if len(rows) else np.zeros(0, bool)
    for n in range(1, size):
        short, begin = grams(words[few], rows[few], n)
        own = rows[few][begin]
        whole = np.bincount(rows[few], minlength=block.rows)[own] == n
        values, where = np.concatenate((values, short[whole])), np.concatenate((where, own[whole]))
    order = np.argsort(values)
    order = order[np.argsort(where[order].astype(np.uint16), kind="stable")]
    values, where = values[order], where[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (where[1:] != where[:-1])
    return values[new], where[new]


def registers(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Registers of each run of shingle hashes that begins at the given places."""
    half = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    low = np.empty((len(begins), M), np.uint32)
    for i in range(M):
        x = (half ^ SEEDS[0, i]) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= SEEDS[1, i]
        x ^= x >> np.uint32(16)
        low[:, i] = np.minimum.reduceat(x, begins)
    least = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(B)), 0, LAST).astype(np.uint16)


def set_keys(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set, as 16 bytes."""
    with np.errstate(over="ignore"):
        one = np.add.reduceat(mix(values), begins)
        two = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), begins)
    return mix(np.column_stack((one, two)))


def sketch(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, t (text hash), n_shingles, set_key (16 bytes, null for an empty set), vid (its first half) and sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets):
                values, where = shingle_sets(Block(data, offsets, a, b, lower=True), size)
                count = np.bincount(where, minlength=b - a)
                full = count > 0
                keys, made = np.zeros((b - a, 2), np.uint64), np.zeros((b - a, M), np.uint16)
                if len(values):
                    begins = (np.cumsum(count) - count)[full]
                    keys[full], made[full] = set_keys(values, begins), registers(values, begins)
                none = pa.array(~full)
                fixed = lambda x, n: pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), b - a, [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())  # noqa: B023, E731
                hide = lambda x: pc.if_else(none, pa.nulls(b - a, x.type), x)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(count.astype(np.int64)), hide(fixed(keys, 16)),
                     hide(pa.array(keys[:, 0].view(np.int64))), hide(fixed(made, 2 * M))],
                    names=["doc_id", "t", "n_shingles", "set_key", "vid", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    t = F.coalesce(F.xxhash64("text"), F.lit(0).cast("bigint")).alias("t")
    return docs.select("doc_id", "text", t).mapInArrow(
        run, f"doc_id {kind}, t bigint, n_shingles bigint, set_key binary, vid bigint, sketch binary")


def likely(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of register rows, given both set sizes."""
    greater, less = (one > two).sum(1), (one < two).sum(1)
    equal = one.shape[1] - greater - less
    u = n_one / (n_one + n_two)
    v = 1 - u
    step = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def value(j):
        p, q = step(u - v * j), step(v - u * j)
        logs = [np.log(np.maximum(x, 1e-300)) for x in (p, q, 1 - p - q)]
        return sum(np.where(k > 0, k * x, 0.0) for k, x in zip((greater, less, equal), logs))

    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(25):  # the likelihood has one peak
        third = (high - low) / 3
        left = value(low + third) < value(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _registers_of(column: pa.Array) -> np.ndarray:
    data, _ = flat(column)
    return data.view(np.uint16).reshape(-1, M) if data.flags.aligned else np.frombuffer(data.tobytes(), np.uint16).reshape(-1, M)


def estimated(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """The pairs a, b whose estimate reaches the floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_one, n_two = (np.asarray(batch.column(i)).astype(float) for i in (2, 3))
                found = likely(_registers_of(batch.column(4)), _registers_of(batch.column(5)), n_one, n_two)
                yield batch.select([0, 1]).filter(pa.array(found >= floor))

    end = lambda c: classes.select(F.col("vid").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    return (pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
            .mapInArrow(run, "a bigint, b bigint"))


def _texts(vids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """vid and text of the given classes, by the doc_id and text hash of their first row."""
    reps = vids.join(classes.select("vid", F.col("rep.doc_id").alias("rep"), F.col("rep.t").alias("rep_t")), "vid")
    rows = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0).cast("bigint")).alias("t"))
    return rows.join(reps, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("t") == F.col("rep_t"))).select("vid", "text")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs a, b whose full sets reach the limit. Each centre's text meets runs of CHECKED other texts."""
    sized = pairs.join(pairs.groupBy("a").count(), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / CHECKED)).alias("salt"))
    sized = stage(sized, "pairs")
    ends = sized.select(F.col("a").alias("vid")).union(sized.select("b")).distinct()
    texts = stage(_texts(ends, classes, docs), "texts")
    centres = sized.select("a", "salt").distinct().join(texts, F.col("a") == F.col("vid"))
    others = sized.join(texts, F.col("b") == F.col("vid"))
    rows = (centres.select("a", "salt", F.lit(0).alias("role"), "vid", "text")
            .union(others.select("a", "salt", F.lit(1), "vid", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            data, offsets = flat(batch.column(3))
            a, role, vid = (np.asarray(batch.column(i)) for i in range(3))
            hits = []
            for start, end in blocks(offsets):
                values, where = shingle_sets(Block(data, offsets, start, end, lower=True), size)
                cuts = np.searchsorted(where, np.arange(end - start + 1))
                for i in range(start, end):
                    got = values[cuts[i - start]:cuts[i - start + 1]]
                    if role[i] == 0:
                        centre, own = a[i], got
                    elif a[i] == centre:
                        common = len(np.intersect1d(own, got, assume_unique=True))
                        if 100 * common >= percent * (len(own) + len(got) - common):
                            hits.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[hits]), pa.array(vid[hits])], names=["a", "b"])

    return (rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").select("a", "role", "vid", "text")
            .mapInArrow(run, "a bigint, b bigint"))


def _shared(classes: DataFrame) -> DataFrame:
    """bucket, vid for the buckets that at least two classes share."""
    key = lambda i: F.xxhash64(F.lit(i), F.substring("sketch", 1 + 2 * ROWS * i, 2 * ROWS))
    banded = classes.select("vid", F.explode(F.array(*(key(i) for i in range(BANDS)))).alias("bucket"))
    heads = (banded.groupBy("bucket").agg(F.min("vid").alias("head"), F.max("vid").alias("tail"))
             .where("head <> tail").select("bucket", "head"))
    return banded.join(heads, "bucket")


def _sets(vids: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """vid, shingles (the full set as 64-bit hashes in order) of the given classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets):
                values, where = shingle_sets(Block(data, offsets, a, b, lower=True), size)
                cuts = np.searchsorted(where, np.arange(b - a + 1))
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(8 * cuts.astype(np.int64)), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), made.cast(pa.binary())], names=["vid", "shingles"])

    return _texts(vids, classes, docs).mapInArrow(run, "vid bigint, shingles binary").groupBy("vid").agg(F.min("shingles").alias("shingles"))


class _Meeting:
    """One task's union of components: the waiting classes, and what links it found."""

    def __init__(self, floor: float, percent: int):
        self.floor, self.percent = floor, percent
        self.rest: list[tuple] = []
        self.parent: dict[int, int] = {}

    def root(self, label: int) -> int:
        while self.parent.get(label, label) != label:
            label = self.parent[label]
        return label

    def links(self, vid: np.ndarray, label: np.ndarray, made: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links of the waiting classes with a part of the others: one for each two components that meet."""
        out = []
        roots = np.array([self.root(x) for x in label.tolist()])
        for own_vid, own_label, own_made, own_set in self.rest:
            mine = self.root(own_label)
            # A pair at the limit agrees in nearly that share of its registers.
            near = np.flatnonzero(roots != mine)
            near = near[(made[near] == own_made).sum(1) >= self.floor * M]
            if not len(near):
                continue
            size = np.array([len(sets[i]) for i in near])
            every = np.concatenate([sets[i] for i in near])
            at = np.minimum(np.searchsorted(own_set, every), len(own_set) - 1)
            common = np.add.reduceat((own_set[at] == every).astype(np.int64), np.cumsum(size) - size)
            for i in near[100 * common >= self.percent * (len(own_set) + size - common)]:
                one, two = self.root(own_label), self.root(int(label[i]))
                if one != two:
                    self.parent[two] = one
                    out.append((own_vid, int(vid[i])))
                    roots[roots == two] = one
        return out


def _across(shared: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links a, b between components that share a bucket still, enough to join them."""
    floor = percent / 100 - MARGIN
    placed = (shared.join(labels.withColumnRenamed("id", "vid"), "vid", "left")
              .select("bucket", "head", "vid", F.coalesce("label", "vid").alias("label")))
    # The head has met every other class of its bucket already.
    placed = placed.where("vid <> head").drop("head")
    mixed = (placed.groupBy("bucket").agg(F.min("label").alias("lead"), F.max("label").alias("top"))
             .where("lead <> top").select("bucket", "lead"))
    rows = stage(placed.join(mixed, "bucket").join(classes.select("vid", "n_shingles"), "vid")
                 .withColumn("is_lead", F.col("label") == F.col("lead")).drop("lead"), "mixed")
    weight = F.col("n_shingles") / SHINGLES + F.lit(1 / MEET)
    sizes = rows.groupBy("bucket").agg(F.ceil(F.sum(F.when(~F.col("is_lead"), weight))).alias("rest_blocks"), F.ceil(F.sum(weight)).alias("all_blocks"))
    rows = rows.join(sizes, "bucket").withColumn("h", F.xxhash64("vid"))
    upto = lambda c: F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)
    names = ["bucket", "x", "y", "role", "vid", "label"]
    every = rows.withColumn("x", F.pmod("h", "all_blocks")).withColumn("y", F.explode(upto("rest_blocks"))).withColumn("role", F.lit(1))
    rest = (rows.where("not is_lead").withColumn("y", F.pmod("h", "rest_blocks")).withColumn("x", F.explode(upto("all_blocks")))
            .withColumn("role", F.lit(0)))
    sets = stage(_sets(rows.select("vid").distinct(), classes, docs, size), "sets")
    meet = (every.select(*names).union(rest.select(*names)).join(classes.select("vid", "sketch"), "vid").join(sets, "vid")
            .repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "role")
            .select(*names, "sketch", "shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, meeting = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(i)) for i in range(6)]
            made = _registers_of(batch.column(6))
            data, offsets = flat(batch.column(7))
            values = np.frombuffer(data.tobytes(), np.uint64)
            sets = np.split(values, offsets[1:-1] // 8)
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            pairs = []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                now = tuple(int(c[a]) for c in cols[:3])
                if now != key:
                    key, meeting = now, _Meeting(floor, percent)
                if cols[3][a] == 0:
                    meeting.rest += [(int(cols[4][i]), int(cols[5][i]), made[i].copy(), sets[i].copy()) for i in range(a, b)]
                elif meeting.rest:
                    pairs += meeting.links(cols[4][a:b], cols[5][a:b], made[a:b], sets[a:b])
            one, two = np.array(pairs, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["a", "b"])

    return meet.mapInArrow(run, "a bigint, b bigint").distinct()


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and a class for each set: set_key, vid, rep (doc_id and t of its first row), n_shingles, sketch.

    vid is half of the set's key. Where two sets share it, all but the first get another one.
    """
    classes = stage(rows.where("vid is not null").groupBy("set_key").agg(
        F.min("vid").alias("vid"), F.min(F.struct("doc_id", "t")).alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch")), "classes")
    shared = classes.groupBy("vid").agg(F.count("*").alias("n"), F.min("set_key").alias("first")).where("n > 1").select("vid", "first")
    moved = stage(classes.select("vid", "set_key").join(shared, "vid").where("set_key <> first")
                  .select("set_key", F.xxhash64("set_key", F.lit("again")).alias("moved")), "moved")
    if moved.isEmpty():
        return rows, classes
    renamed = lambda df, name: stage(df.join(moved, "set_key", "left").withColumn("vid", F.coalesce("moved", "vid")).select(*df.columns), name)
    return renamed(rows, "sketches"), renamed(classes, "classes")


def _placed(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Staged rows (doc_id, t, n_shingles, vid) and the label of each class (vid, label)."""
    floor = percent / 100 - MARGIN
    rows, classes = _classes(stage(sketch(docs, size), "sketches"))
    shared = stage(_shared(classes), "buckets")
    pairs = shared.where("head <> vid").select(F.col("head").alias("a"), F.col("vid").alias("b")).distinct()
    links = stage(confirmed(estimated(pairs, classes, floor), classes, docs, size, percent), "confirmed")
    labels = components(links)
    more = stage(_across(shared, classes, labels, docs, size, percent), "across")
    if not more.isEmpty():
        labels = components(links.union(more))
    every = classes.select("vid").join(labels.withColumnRenamed("id", "vid"), "vid", "left")
    return rows.drop("sketch", "set_key"), every.select("vid", F.coalesce("label", "vid").alias("label"))


def grouped(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    rows, labels = _placed(docs, size, percent)
    full = rows.where("vid is not null")
    lowest = full.groupBy("vid").agg(F.min("doc_id").alias("low")).join(labels, "vid")
    ids = lowest.groupBy("label").agg(F.min("low").alias("component_id"))
    known = full.join(lowest.join(ids, "label").select("vid", "component_id"), "vid")
    empty = rows.where("vid is null").withColumn("component_id", F.col("doc_id"))
    return known.unionByName(empty).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of the smallest doc_id, and all rows with empty sets; columns as they are."""
    rows, labels = _placed(docs, size, percent)
    first = F.min(F.struct("doc_id", "t")).alias("first")
    heads = (rows.where("vid is not null").groupBy("vid").agg(first).join(labels, "vid").groupBy("label")
             .agg(F.min("first").alias("first")).select("first.*"))
    empty = rows.where("vid is null").select("doc_id", "t").distinct()
    keep = heads.union(empty).select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t"))
    mark = F.coalesce(F.xxhash64("text"), F.lit(0).cast("bigint"))
    same = lambda other: docs["doc_id"].eqNullSafe(other["__doc"]) & (mark == other["__t"])
    kept = docs.join(keep, same(keep), "left_semi")
    # Rows repeated with one doc_id and text are rare and cost a pass of their own only where there are any.
    twice = (rows.where("vid is not null").groupBy("doc_id", "t").count().where("count > 1")
             .select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t")))
    twice = stage(twice, "repeated")
    if twice.isEmpty():
        return kept
    order = Window.partitionBy("doc_id", mark).orderBy(F.to_json(F.struct(*docs.columns)))
    one = kept.join(twice, same(twice), "left_semi").withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")
    return kept.join(twice, same(twice), "left_anti").unionByName(one)
