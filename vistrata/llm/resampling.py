"""Importance resampling towards a target distribution, with weights by bit-sliced aggregation.

Features are runs of one and two words, hashed by CRC-32 into BUCKETS buckets. Counts per bucket over both tables give
every bucket an integer gain, the scaled logarithm of how much more frequent it is in the target. A text's weight is
the floored mean gain of its features.

1. Counts: each task adds up its buckets in one vector of fixed size; Spark adds the vectors, and the driver reads
   BUCKETS sums of each table.
2. Gains become planes of one bit a bucket: a plane per binary digit, for positive and for negative gains.
3. A block of texts becomes planes too: plane p has the bits of the buckets whose count has binary digit p. The bits
   that a count plane and a gain plane share, counted and times 2 ** (p + q), add up to the exact sum of gains.
4. Scores (weight and seeded Gumbel noise) are ranked by range partition and offsets; no task sorts the whole table.

The checksum of two words follows from theirs, since CRC-32 is linear: no pair of words is ever built as text.

Defined cases: a null or empty text has no features and weight 0; a null doc_id is hashed as an empty one and precedes
others on ties; rows with one doc_id are rows of their own, ties among them in any order; an empty target leaves gains
by the source's counts alone; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.llm.arrays import Block, blocks, flat
from vistrata.operators.ranks import range_staged, with_running_total
from vistrata.session import stage

BUCKETS, SCALE = 10_000, 1000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
# Texts that are counted together; their counts are a table of TOGETHER x BUCKETS.
TOGETHER = 64
# Bytes up to which checksums are made for all words at once.
SHORT = 64
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_table() -> np.ndarray:
    """CRC-32 of each byte, from its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


TABLE = _byte_table()


def _shift_table() -> np.ndarray:
    """What n bytes that follow make of each byte of a checksum, n up to SHORT."""
    now = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    out = [now]
    for _ in range(SHORT):
        now = (now >> np.uint32(8)) ^ TABLE[now & np.uint32(255)]
        out.append(now)
    return np.stack(out)


SHIFT = _shift_table()


def shifted(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums as they enter those of texts n bytes longer."""
    part = lambda k: SHIFT[n, k, (sums >> np.uint32(8 * k)) & np.uint32(255)]
    return part(0) ^ part(1) ^ part(2) ^ part(3)


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, sizes and rows of all words of a block."""
    word = WORD[block.data]
    first, last = block.edges(block.offsets[:-1])[:-1], block.edges(block.offsets[1:])[1:]
    starts = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | first)) if len(word) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (~np.concatenate((word[1:], [False])) | last)) + 1 if len(word) else starts
    return starts, ends - starts, block.row_of(starts)


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges."""
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[order], sizes[order]
    out = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(min(SHORT, int(size[0]) if len(size) else 0)):
        m = int(np.searchsorted(-size, -j, "left"))
        now = out[:m]
        out[:m] = (now >> np.uint32(8)) ^ TABLE[(now ^ data[begin[:m] + j]) & np.uint32(255)]
    out = ~out
    for i in range(int(np.searchsorted(-size, -SHORT, "left"))):
        out[i] = zlib.crc32(data[begin[i]:begin[i] + size[i]])
    back = np.empty_like(out)
    back[order] = out
    return back


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and rows of all features of a block, and its number of words by row."""
    starts, sizes, rows = words(block)
    own = checksums(block.data, starts, sizes)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    left, right, size = own[pair], own[pair + 1], sizes[pair + 1]
    short = size < SHORT
    space = np.full(int(short.sum()), zlib.crc32(b" "), np.uint32)
    both = np.empty(len(pair), np.uint32)
    both[short] = shifted(left[short], size[short] + 1) ^ shifted(space, size[short]) ^ right[short]
    for i in np.flatnonzero(~short).tolist():
        begin = starts[pair[i] + 1]
        both[i] = zlib.crc32(block.data[begin:begin + size[i]], zlib.crc32(b" ", int(left[i])))
    buckets = np.concatenate((own, both)) % np.uint32(BUCKETS)
    return buckets.astype(np.int64), np.concatenate((rows, rows[pair])), np.bincount(rows, minlength=block.rows)


def counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in blocks(offsets):
                total += np.bincount(features(Block(data, offsets, a, b, lower=True))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "c"])

    out = np.zeros(BUCKETS, np.int64)
    sums = texts.select("text").mapInArrow(run, "bucket int, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")).toPandas()
    out[sums["bucket"].to_numpy(int)] = sums["c"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Integer gain of each bucket."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def planes(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(flags, axis=-1)
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view(np.uint64)


def digits(values: np.ndarray) -> int:
    return int(values.max(initial=0)).bit_length()


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) of each binary digit of the positive and of the negative gains."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        out += [(sign << q, planes((size >> q & 1).astype(bool))) for q in range(digits(size))]
    return out


def sums_of_gains(table: np.ndarray, sliced: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of gains of each row of a table of bucket counts."""
    out = np.zeros(len(table), np.int64)
    for p in range(digits(table)):
        own = planes((table >> p & 1).astype(bool))
        for power, plane in sliced:
            out += (power << p) * np.bitwise_count(own & plane).sum(-1, dtype=np.int64)
    return out


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = gain_planes(gain)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets, rows=TOGETHER):
                bucket, row, n_words = features(Block(data, offsets, a, b, lower=True))
                table = np.bincount(row * BUCKETS + bucket, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
                n = table.sum(1)
                weight = np.where(n > 0, sums_of_gains(table, sliced) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_words), pa.array(n), pa.array(weight)],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """`weights` with score: the weight and Gumbel noise that follows from seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weights.withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`rows` with rank, 1 for the highest score, of the share drawn from those of enough words; null for the others."""
    fits = F.col("n_words") >= least_words
    able = rows.where(fits).withColumn("_down", -F.col("score"))
    share = percent * able.count() // 100
    order = ["_down", "doc_id"]
    placed = with_running_total(range_staged(able, order, "scores", spread_ties=True), [*order, "_tie"], F.lit(1), "_before")
    rank = F.when(F.col("_before") < share, F.col("_before") + 1).cast("bigint").alias("rank")
    return placed.select(*rows.columns, rank).unionByName(rows.where(~fits).withColumn("rank", F.lit(None).cast("bigint")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every text."""
    gain = gains(counts(docs), counts(target))
    return drawn(stage(scored(weighted(docs, gain), seed), "weights"), percent)
