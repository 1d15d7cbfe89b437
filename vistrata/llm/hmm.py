"""Hidden Markov language model over a corpus: counts, Baum-Welch, exact sequence likelihoods.

Tokens are lower-cased words and one end per text. A token's probability in a state is its class's probability there
times the token's share of the class: the OWN most frequent tokens are classes of their own, the others share BUCKETS
classes by hash, within which shares follow the corpus counts. So the states' tables have a fixed size at any size of
the vocabulary, while every count comes from all training texts.

1. Counts of all training tokens, summed per task, then by Spark. The vocabulary stays a distributed table; only its
   most frequent entries (at most LOOKED_UP, 2 MB) and sums by bucket reach the driver.
2. One pass turns texts into class sequences (two bytes a token) and leaves the rarer tokens as hashes for a join.
3. Baum-Welch: each task runs scaled forward-backward over whole texts and sums expected counts. Texts are taken in
   windows of WINDOW tokens: forward values are carried over each cut, kept at the cuts only, and met there by the
   backward values, so the counts are those of the uncut text in bounded memory. The sums are added up over a tree of
   tasks, and the driver reads at most FAN of them, each of a fixed size.
4. Scaled forward recursion over whole sequences gives their exact likelihood; the shares of rare tokens and the base
   score come from a join of the vocabulary with the distinct rare tokens of each text.

Defined cases: a null or empty text is the end alone; a null doc_id is not held out; rows repeated with one doc_id are
scored (and counted) row by row; without training rows every count is 0, which makes every base score 0; the end has
its own class and count, 0 included; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.llm.arrays import Block, blocks, flat, mix
from vistrata.session import stage

STATES, ITERATIONS = 8, 5
OWN, BUCKETS, LOOKED_UP = 4096, 1024, 1 << 17
WINDOW, TOGETHER = 256, 1024
# Distinct tokens a counting task keeps before it sends its counts on.
KEPT = 1 << 20
FAN = 16
END = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])


def _word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = block.words()
    return block.hashes(starts, ends).view(np.int64), rows


def split(docs: DataFrame) -> DataFrame:
    """doc_id, text and held_out (crc32 of the doc_id as text leaves 1 modulo 5)."""
    return docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"))


def vocabulary(training: DataFrame) -> DataFrame:
    """h, c: how often each token occurs in the training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(h, c):
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])

        kept, counts, texts = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            data, offsets = flat(batch.column(0))
            for a, b in blocks(offsets):
                own, times = np.unique(_word_hashes(Block(data, offsets, a, b, lower=True))[0], return_counts=True)
                both = np.concatenate((kept, own))
                order = np.argsort(both, kind="stable")
                both, summed = both[order], np.concatenate((counts, times))[order]
                new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, int)
                kept, counts = both[new], np.add.reduceat(summed, new) if len(new) else counts
                if len(kept) > KEPT:
                    yield give(kept, counts)
                    kept, counts = kept[:0], counts[:0]
        if texts:
            yield give(np.append(kept, END), np.append(counts, texts))

    return training.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


class Tables:
    """What every task needs: looked-up tokens with counts and classes, and the buckets' totals."""

    def __init__(self, vocab: DataFrame):
        n, v = vocab.agg(F.sum("c"), F.count("*")).first()
        self.n, self.v = int(n or 0), int(v)
        # Counts by size class show from which class on tokens fit the table; no task sends a list of its own.
        size = F.floor(F.log2("c") * 32)
        sizes = sorted(vocab.groupBy(size.alias("size")).count().collect(), reverse=True)
        fits = np.cumsum([r["count"] for r in sizes]) <= LOOKED_UP
        least = min((r["size"] for r, f in zip(sizes, fits) if f), default=1 << 20)
        top = vocab.where(size >= least).toPandas().sort_values(["c", "h"], ascending=[False, True])
        h, c = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
        if END not in h:
            ends = vocab.where(F.col("h") == END).agg(F.sum("c")).first()[0]
            h, c = np.append(h, END), np.append(c, int(ends or 0))
        rank = np.arange(len(h))
        bucket = OWN + (h % BUCKETS)
        kind = np.where(rank < OWN, rank, bucket)
        kind[h == END] = OWN + BUCKETS
        order = np.argsort(h)
        self.h, self.c, self.kind = h[order], c[order], kind[order].astype(np.uint16)
        sums = (vocab.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
                .toPandas().set_index("b").reindex(range(BUCKETS)).fillna(0))
        own = self.kind < OWN
        own |= self.h == END
        less = lambda w: np.bincount(self.h[own] % BUCKETS, weights=w, minlength=BUCKETS)
        tokens = sums["c"].to_numpy(float) - less(self.c[own])
        types = sums["v"].to_numpy(float) - less(self.c[own] > 0)
        self.norm = np.log10(tokens + 0.5 * (types + 1))
        self.frequency = np.zeros(OWN + BUCKETS + 1)
        self.frequency[self.kind[own]] = self.c[own]
        self.frequency[OWN:OWN + BUCKETS] = tokens


def encode(texts: DataFrame, tables: Tables) -> DataFrame:
    """One row per text: classes in order (two bytes each), sums over looked-up tokens, and the other tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log10(tables.c + 0.5)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets):
                h, rows = _word_hashes(Block(data, offsets, a, b, lower=True))
                n = b - a
                h = np.insert(h, ends := np.searchsorted(rows, np.arange(n), "right"), END)
                rows = np.insert(rows, ends, np.arange(n))
                at = np.minimum(np.searchsorted(tables.h, h), max(len(tables.h) - 1, 0))
                known = tables.h[at] == h if len(tables.h) else np.zeros(len(h), bool)
                kind = (OWN + h % BUCKETS).astype(np.uint16)
                kind[h == END] = OWN + BUCKETS
                kind[known] = tables.kind[at[known]]
                shared = (kind >= OWN) & (kind < OWN + BUCKETS)
                log = np.zeros(len(h))
                log[known] = logs[at[known]]
                sums = lambda w, where: np.bincount(rows[where], weights=w[where], minlength=n).astype(float)  # noqa: B023, E731
                norm = np.zeros(len(h))
                norm[shared] = tables.norm[kind[shared] - OWN]
                rare = np.flatnonzero(~known & (h != END))
                order = rare[np.lexsort((h[rare], rows[rare]))]
                new = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])))) if len(order) else order
                times = np.diff(np.append(new, len(order)))
                cuts = np.searchsorted(rows[order[new]], np.arange(n + 1)).astype(np.int32)
                size = np.bincount(rows, minlength=n)
                byte_cuts = (2 * np.concatenate(([0], np.cumsum(size)))).astype(np.int32)
                classes = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(byte_cuts), pa.py_buffer(kind)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(size),
                     pa.array(np.bincount(rows[known], weights=tables.c[at[known]] > 0, minlength=n).astype(np.int64)), pa.array(sums(log, known)),
                     pa.array(sums(log, known & shared) - sums(norm, shared)), classes,
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[order[new]])),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32)))],
                    names=["doc_id", "held_out", "n_tokens", "n_met", "log_met", "log_shares", "classes", "rare", "times"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "held_out").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_met bigint, log_met double, log_shares double, "
             "classes binary, rare array<bigint>, times array<int>")


class Model:
    """Start, transition and emission probabilities; emission has a row per class."""

    def __init__(self, frequency: np.ndarray):
        k, c = STATES, len(frequency)
        noise = mix(np.arange(k * c, dtype=np.uint64) + np.uint64(77)).reshape(c, k) / 2.0**64
        self.prior = (frequency + 0.1) / (frequency + 0.1).sum()
        self.start = np.full(k, 1 / k)
        self.move = np.full((k, k), 0.2 / max(1, k - 1))
        np.fill_diagonal(self.move, 0.8)
        self.emit = self.prior[:, None] * (0.5 + noise)
        self.emit /= self.emit.sum(0)

    def update(self, counts: np.ndarray) -> None:
        """Maximisation from expected counts: start, transitions, emissions in one flat vector."""
        k, c = STATES, len(self.prior)
        start, move, emit = counts[:k] + 1, counts[k:k + k * k].reshape(k, k) + 1, counts[k + k * k:].reshape(c, k)
        self.start, self.move = start / start.sum(), move / move.sum(1, keepdims=True)
        # Classes a state never met keep a small share of their corpus frequency there.
        emit = emit + 0.01 * emit.sum(0) * self.prior[:, None] + self.prior[:, None]
        self.emit = emit / emit.sum(0)

    def _forward(self, windows: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """Forward values at the end of full windows that follow on `before` (None: at the beginning)."""
        alpha = before
        for x in windows.T:
            now = (self.start if alpha is None else alpha @ self.move) * self.emit[x]
            alpha = now / now.sum(1, keepdims=True)
        return alpha

    def expected(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Expected counts over class windows that are texts of their own."""
        return self.smoothed(windows, sizes)[0]

    def smoothed(self, windows: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None,
                 after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts over class windows (padded to one width) by scaled forward-backward, and the backward values
        for what precedes them. `before` holds the forward values the windows follow on, None where texts begin;
        `after` the backward values at their ends."""
        n, width = windows.shape
        k, c = self.emit.shape[1], self.emit.shape[0]
        order = np.argsort(-sizes, kind="stable")
        windows, sizes = windows[order], sizes[order]
        earlier = None if before is None else before[order]
        live = np.searchsorted(-sizes, -np.arange(width), "left")  # windows longer than t
        alpha, scale = np.zeros((width, n, k)), np.ones((width, n))
        for t in range(width):
            m = live[t]
            past = alpha[t - 1, :m] if t else earlier
            now = (self.start if past is None else past @ self.move) * self.emit[windows[:m, t]]
            scale[t, :m] = now.sum(1)
            alpha[t, :m] = now / scale[t, :m, None]
        move = np.zeros((k, k))
        beta = np.ones((n, k)) if after is None else after[order]
        for t in range(width - 1, -1, -1):  # alpha becomes the posterior on the way back
            m = live[t]
            ahead = self.emit[windows[:m, t]] * beta[:m] / scale[t, :m, None]
            past = alpha[t - 1, :m] if t else earlier
            if past is not None:
                move += past.T @ ahead
            alpha[t, :m] *= beta[:m]
            beta[:m] = ahead @ self.move.T
        flags = np.arange(width)[:, None] < sizes[None, :]
        post, seen = alpha[flags], windows.T[flags]
        emit = np.stack([np.bincount(seen, weights=post[:, s], minlength=c) for s in range(k)], 1)
        begun = alpha[0].sum(0) if earlier is None else np.zeros(k)
        back = np.empty_like(beta)
        back[order] = beta
        return np.concatenate((begun, (move * self.move).ravel(), emit.ravel())), back

    def whole(self, data: np.ndarray, cuts: np.ndarray, window: int = 0) -> np.ndarray:
        """Expected counts over whole class sequences, window by window."""
        window = window or WINDOW
        total = np.zeros(self.emit.shape[1] * (1 + self.emit.shape[1] + self.emit.shape[0]))
        sizes = np.diff(cuts)
        sequences = np.flatnonzero(sizes > 0)
        sequences = sequences[np.argsort(-sizes[sequences], kind="stable")]
        for i in range(0, len(sequences), TOGETHER):
            part = sequences[i:i + TOGETHER]
            begin, size = cuts[part], sizes[part]
            depth = -(-int(size[0]) // window)

            def cut(j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
                long = np.minimum(size[:m] - j * window, window)  # noqa: B023
                at = begin[:m, None] + j * window + np.arange(long.max())  # noqa: B023
                return data[np.minimum(at, len(data) - 1)], long

            # How many of the sequences, longest first, reach window j.
            reach = [int(np.searchsorted(-size, -j * window, "left")) for j in range(depth + 1)]
            before: list[np.ndarray | None] = [None]
            for j in range(depth - 1):
                m = reach[j + 1]
                before.append(self._forward(cut(j, m)[0], None if before[j] is None else before[j][:m]))
            after = np.ones((len(part), self.emit.shape[1]))
            for j in range(depth - 1, -1, -1):
                m = reach[j]
                made, after[:m] = self.smoothed(*cut(j, m), before[j], after[:m])
                total += made
        return total

    def log10(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each class sequence, by the scaled forward recursion."""
        sizes = np.diff(cuts)
        order = np.argsort(-sizes, kind="stable")
        begins, long = cuts[:-1][order], sizes[order]
        out, alpha = np.zeros(len(sizes)), None
        for t in range(long[0] if len(long) else 0):
            m = int(np.searchsorted(-long, -t, "left"))
            now = (self.start if t == 0 else alpha[:m] @ self.move) * self.emit[data[begins[:m] + t]]
            total = now.sum(1)
            out[:m] += np.log10(total)
            alpha = now / total[:, None]
        back = np.empty_like(out)
        back[order] = out
        return back


def _classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(column)
    return np.frombuffer(data.tobytes(), np.uint16), offsets // 2


def _step(encoded: DataFrame, model: Model) -> np.ndarray:
    """Expected counts over all training sequences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            made = model.whole(*_classes(batch.column(0)))
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x.as_py()) for batch in batches for x in batch.column(0)), np.zeros(1))
        if len(total) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    training = encoded.where("not held_out").select("classes")
    sums = training.mapInArrow(run, "counts binary")
    parts = training.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(add, "counts binary")
    return sum((np.frombuffer(r.counts) for r in sums.toLocalIterator()), np.zeros(1))


def train(encoded: DataFrame, tables: Tables, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over all training sequences."""
    model = Model(tables.frequency)
    for _ in range(iterations):
        counts = _step(encoded, model)
        if len(counts) == 1:
            break
        model.update(counts)
    return model


def score(encoded: DataFrame, vocab: DataFrame, tables: Tables, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.log10(*_classes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made)], names=[*batch.schema.names[1:], "forward"])

    names = ["row", "doc_id", "held_out", "n_tokens", "n_met", "log_met", "log_shares"]
    kinds = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in names)
    whole = encoded.select("classes", *names).mapInArrow(run, f"{kinds}, forward double")
    rare = (encoded.select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "h")
            .join(vocab, "h", "left")
            .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_rare"),
                                F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("n_rare")))
    both = whole.join(rare, "row", "left").withColumn("log_rare", F.coalesce("log_rare", F.lit(0.0)))
    floor = float(np.log10(tables.n + 0.5 * (tables.v + 1)))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_met") + F.coalesce("n_rare", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(tables.n).cast("bigint").alias("train_tokens"),
        (F.col("log_met") + F.col("log_rare") - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("forward") + F.col("log_shares") + F.col("log_rare")).alias("score"))


def scored(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Train on the texts that are not held out and score all."""
    texts = split(docs)
    vocab = stage(vocabulary(texts.where("not held_out")), "vocabulary")
    tables = Tables(vocab)
    encoded = stage(encode(texts, tables).withColumn("row", F.monotonically_increasing_id()), "classes")
    return score(encoded, vocab, tables, train(encoded, tables, iterations))
