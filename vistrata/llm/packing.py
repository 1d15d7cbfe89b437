"""Best-fit packing of token sequences by hierarchical residual packing.

Texts become pieces of at most `room` tokens; full pieces are sequences of their own. The others go to groups of
about GROUP pieces by hash. Each group packs its items best fit, longest first, sends on its nearly full bins and
keeps the underfull ones, which are the items of the next, smaller set of groups. The last round is a single group of
at most GROUP items. Where a round brings hardly fewer bins, nearly all of them are longer than half the room and
cannot meet; the GROUP shortest of all groups then make the last round, and the others are sent on as they are. A
group's rows are thus bounded at any size of the input, and every piece is placed exactly once.

Defined cases: a null or empty text is one piece holding the end id only; repeated rows and null doc_ids are packed
row by row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.llm.arrays import flat
from vistrata.llm.codec import byte_bpe
from vistrata.session import stage

ROOM = 2048
GROUP = 100_000
# Bins with at most this share of room left are sent on.
NEARLY = 0.01


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids themselves on demand) of every text."""
    last = np.array([end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(tokenizer)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b, places, first, *_ in codec.blocks(data, offsets):
                made = codec.ids_of(places).astype("<u4")
                cuts = np.concatenate(([0], np.cumsum(codec.length[places])))[first]
                rows, starts, lengths, sums, lists, numbers = [], [], [], [], [], []
                for i in range(b - a):
                    own = np.concatenate((made[cuts[i]:cuts[i + 1]], last))
                    at = len(own) % room or room
                    for k, begin in enumerate(range(0, len(own), room) if at == room else [0, *range(at, len(own), room)]):
                        part = own[begin:(at if k == 0 else begin + room)]
                        rows.append(a + i)
                        numbers.append(k)
                        starts.append(begin)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
                        if ids:
                            lists.append(part)
                out = {"doc_id": batch.column(0).take(pa.array(rows)), "piece": pa.array(numbers, pa.int32()),
                       "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()),
                       "ids_crc32": pa.array(sums, pa.int64())}
                if ids:
                    out["ids"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>" if ids else ""
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{more}")


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the length of each bin; items in the given order, each into the fullest bin
    that has room. Bins of one free size share a list; a bit per size finds the least that fits."""
    free: list[list[int]] = [[] for _ in range(room + 1)]
    sizes, used = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = sizes >> n
        if fits:
            size = n + (fits & -fits).bit_length() - 1
            b = free[size].pop()
            if not free[size]:
                sizes ^= 1 << size
        else:
            b, size = len(used), room
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left = size - n
        if left:
            free[left].append(b)
            sizes |= 1 << left
    return bins, offsets, np.array(used, np.int64)


PLACED = ["bin", "offset"]


def _round(items: DataFrame, groups: int, room: int, number: int, final: bool) -> DataFrame:
    """Items packed within groups; `open` marks the members of bins that go on."""
    limit = room - int(NEARLY * room)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", open boolean"
    names = items.columns

    def pack(table: pa.Table) -> pa.Table:
        col = lambda c: np.asarray(table.column(c))
        size = col("offset") + col("length")
        _, at = np.unique(col("bin"), return_inverse=True)
        whole = np.zeros(at.max() + 1, np.int64)
        np.maximum.at(whole, at, size)
        order = np.argsort(-whole, kind="stable")
        bins, offsets, used = best_fit(whole[order], room)
        place, shift = np.empty_like(bins), np.empty_like(offsets)
        place[order], shift[order] = bins, offsets
        group = int(table.column("g")[0].as_py())
        key = (np.int64(number) << np.int64(57)) + (np.int64(group) << np.int64(24))
        out = {c: table.column(c) for c in names}
        out["bin"] = pa.array(key + place[at])
        out["offset"] = pa.array(col("offset") + shift[at])
        out["open"] = pa.array((used[place[at]] < limit) & (not final))
        return pa.table(out)

    grouped = items.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups)))
    return grouped.groupBy("g").applyInArrow(pack, schema)


def pack(items: DataFrame, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """The items with sequence_id and offset. `items` has a length of at most room and any further columns."""
    keys = [c for c in items.columns]
    full = items.where(F.col("length") == room)
    rest = stage(items.where(F.col("length") < room).withColumn("offset", F.lit(0).cast("bigint"))
                 .withColumn("bin", F.monotonically_increasing_id()), "items")
    bins = rest.count()
    number, done = 1, []
    while bins:
        groups = -(-bins // group)
        final = groups == 1
        made = stage(_round(rest, groups, room, number, final), "bins")
        done.append(made.where("not open").drop("open"))
        rest = made.where("open").drop("open")
        left = rest.select("bin").distinct().count()
        if final or not left:
            break
        number += 1
        if left > 0.99 * bins:
            # Groups hold at most one bin below half each, so the others are too long to meet: the shortest of all
            # groups, as many as a task takes, have a last round together.
            shortest = rest.groupBy("bin").agg(F.max(F.col("offset") + F.col("length")).alias("size")).orderBy("size", "bin").limit(group)
            shortest = stage(shortest.select("bin"), "shortest")
            done.append(rest.join(shortest, "bin", "left_anti").select(*rest.columns))
            done.append(stage(_round(rest.join(shortest, "bin", "left_semi").select(*rest.columns), 1, room, number, True), "bins").drop("open"))
            break
        bins = left
    out = full.withColumn("offset", F.lit(0).cast("bigint")).withColumn("bin", -1 - F.monotonically_increasing_id())
    for part in done:
        out = out.unionByName(part)
    return out.select(*keys, F.col("bin").alias("sequence_id"), "offset")


def packed(docs: DataFrame, tokenizer: str, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """Pieces of all texts with their places."""
    return pack(stage(pieces(docs, tokenizer, room), "pieces"), room, group)
