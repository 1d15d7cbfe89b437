"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads runs: words (bytes between blanks) with a letter, cut into pieces of at most RUN bytes. Each
direction is a gated recurrent layer whose input weights are a row per byte; both states give every byte of a run a
distribution over the languages. A text's probabilities are the geometric mean of those of all its bytes, made to add
up to one. Every run starts afresh, so equal runs have equal results: a worker keeps the sums of at most KEPT runs it
has met, ordered by hash, and computes only new ones; texts of any length are read whole, block by block.

Training: at most ROWS distinct rows of each language, chosen by hash among those that are not held out, give PICKED
words each, spread over the whole text. Languages are the LANGUAGES most frequent ones among rows not held out (their
number is bounded, their rows are counted exactly). Backpropagation through time with Adam, on the driver, over
that bounded sample. lang, source and doc_id are no inputs of a prediction.

Defined cases: a null text or one without a letter (Unicode category L) is `und` with score 0; so is every text if no
row may be learnt from; a null doc_id is not held out; equal probabilities go to the language that comes first; rows
repeated with one doc_id are judged row by row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.llm.arrays import Block, blocks, flat

HIDDEN, RUN = 24, 24
ROWS, PICKED, LANGUAGES = 500, 40, 200
# Passes over the sample, or as many as make STEPS steps.
EPOCHS, STEPS, BATCH, RATE = 4, 400, 256, 0.01
# Runs computed together, and runs whose results a worker keeps.
TOGETHER, KEPT = 1024, 1 << 19
# Binary digits of the hash that picks the sample.
DIGITS = 40
UNKNOWN = "und"
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Layer:
    """One direction: gates (update, reset, candidate) side by side in `byte` (256 rows) and `state` (HIDDEN rows)."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.byte = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.state = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each step (step 0: zeros) of rows of bytes; the first live[t] rows have a byte t."""
        k = self.state.shape[0]
        out, saved = np.zeros((len(live) + 1, len(x), k), self.state.dtype), []
        for t, m in enumerate(live):
            h, given = out[t, :m], self.byte[x[:m, t]]
            past = h @ self.state
            gates = sigmoid(given[:, :2 * k] + past[:, :2 * k])
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(given[:, 2 * k:] + r * past[:, 2 * k:])
            out[t + 1, :m] = new + z * (h - new)
            if keep:
                saved.append((z, r, new, past[:, 2 * k:]))
        return out, saved

    def backward(self, x: np.ndarray, live: np.ndarray, states: np.ndarray, saved: list, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of byte and state, from those of the states after each step."""
        k = self.state.shape[0]
        state, carried = np.zeros_like(self.state), np.zeros_like(states[0])
        steps, symbols = [], []
        for t in range(len(live) - 1, -1, -1):
            m = live[t]
            z, r, new, past = saved[t]
            h, grad = states[t, :m], carried[:m] + wanted[t, :m]
            candidate = grad * (1 - z) * (1 - new * new)
            update = grad * (h - new) * z * (1 - z)
            reset = candidate * past * r * (1 - r)
            inner = np.concatenate((update, reset, candidate * r), 1)
            state += h.T @ inner
            carried[:m] = grad * z + inner @ self.state.T
            steps.append(np.concatenate((update, reset, candidate), 1))
            symbols.append(x[:m, t])
        steps, symbols = np.concatenate(steps), np.concatenate(symbols)
        order = np.argsort(symbols, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], symbols[order][1:] != symbols[order][:-1])))
        byte = np.zeros_like(self.byte)
        byte[symbols[order][first]] = np.add.reduceat(steps[order], first, axis=0)
        return byte, state


class Network:
    """Both directions and the output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.languages, self.layers = languages, [Layer(rng, hidden), Layer(rng, hidden)]
        self.out = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [w for layer in self.layers for w in (layer.byte, layer.state)] + [self.out, self.bias]

    def run(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keep: bool = False) -> tuple:
        """Log probabilities of all bytes of runs that stand longest first, row by row, and what training needs."""
        width = int(sizes[0])
        steps = np.arange(width)
        live = np.searchsorted(-sizes, -steps, "left")
        inside = steps[None, :] < sizes[:, None]
        back = np.where(inside, sizes[:, None] - 1 - steps, 0)
        texts = [data[starts[:, None] + np.where(inside, steps, 0)], data[starts[:, None] + back]]
        made = [layer.forward(x, live, keep) for layer, x in zip(self.layers, texts)]
        rows, at = np.nonzero(inside)
        both = np.concatenate((made[0][0][at + 1, rows], made[1][0][back[rows, at] + 1, rows]), 1)
        logits = both @ self.out + self.bias
        logits -= logits.max(1, keepdims=True)
        logs = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return logs, rows, at, back, live, texts, made, both

    def gradients(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of all bytes against their run's label, and its gradients by backpropagation through time."""
        logs, rows, at, back, live, texts, made, both = self.run(data, starts, sizes, keep=True)
        label = labels[rows]
        loss = -float(logs[np.arange(len(rows)), label].mean())
        wrong = np.exp(logs)
        wrong[np.arange(len(rows)), label] -= 1
        wrong /= len(rows)
        inner = wrong @ self.out.T
        k, out = self.layers[0].state.shape[0], []
        for layer, x, (states, saved), place, part in zip(self.layers, texts, made, (at, back[rows, at]), (inner[:, :k], inner[:, k:])):
            wanted = np.zeros_like(states[1:])
            wanted[place, rows] = part
            out += layer.backward(x, live, states, saved, wanted)
        return loss, [*out, both.T @ wrong, wrong.sum(0)]

    def totals(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sum over a run's bytes of the log probabilities of each language, for all given runs."""
        out = np.zeros((len(starts), len(self.languages)), np.float32)
        order = np.argsort(-sizes, kind="stable")
        for i in range(0, len(order), TOGETHER):
            part = order[i:i + TOGETHER]
            logs, rows, *_ = self.run(data, starts[part], sizes[part])
            first = np.concatenate(([0], np.cumsum(sizes[part])[:-1]))
            out[part] = np.add.reduceat(logs, first, axis=0)
        return out


def fit(words: list[bytes], labels: np.ndarray, languages: list[str], epochs: int = EPOCHS) -> Network:
    """A network trained on labelled words."""
    network, rng = Network(languages), np.random.default_rng(29)
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    weights = network.weights()
    means, squares, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    total = max(1, epochs * -(-len(words) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(words))
        # Batches of like length, in any order.
        groups = [g[np.argsort(-sizes[g], kind="stable")] for g in np.array_split(order, -(-len(order) // (BATCH * 32)))]
        batches = [g[i:i + BATCH] for g in groups for i in range(0, len(g), BATCH)]
        for b in rng.permutation(len(batches)):
            part = batches[b]
            _, made = network.gradients(data, starts[part], sizes[part], labels[part])
            step += 1
            rate = RATE * (1 - (step - 1) / total) + 1e-4
            for w, g, m, s in zip(weights, made, means, squares):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return network


def runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, sizes and rows of all runs of a block."""
    starts, ends, rows = block.words()
    letters = np.concatenate(([0], np.cumsum(LETTER[block.data])))
    real = letters[ends] > letters[starts]
    starts, ends, rows = starts[real], ends[real], rows[real]
    pieces = -(-(ends - starts) // RUN)
    which = np.repeat(np.arange(len(starts)), pieces)
    begin = starts[which] + RUN * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return begin, np.minimum(begin + RUN, ends[which]) - begin, rows[which]


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row holds a letter."""
    plain = np.concatenate(([0], np.cumsum(LETTER[data] & (data < 0x80))))
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])).tolist():
        out[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode())
    return out


def split(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and held_out (crc32 of the doc_id as text leaves 1 modulo 3)."""
    return docs.select("doc_id", "lang", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"))


def train(docs: DataFrame, rows: int = ROWS) -> Network | None:
    """A network that has learnt from the rows that are not held out; None if there are none."""
    able = split(docs).where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    able = able.withColumn("place", F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(1 << DIGITS)))
    below = [F.count_if(F.col("place") < 1 << k).alias(f"below{k}") for k in range(DIGITS + 1)]
    langs = able.groupBy("lang").agg(*below).orderBy(F.desc(f"below{DIGITS}"), "lang").limit(LANGUAGES).collect()
    if not langs:
        return None
    # The least power of two that holds enough rows of a language; repeated rows are one.
    limits = [(r["lang"], 1 << next(k for k in range(DIGITS + 1) if r[f"below{k}"] >= rows or k == DIGITS)) for r in langs]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, below bigint")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(PICKED - 1)), lambda i: F.substring(
        F.get("words", F.floor((i + 0.5) * F.size("words") / PICKED).cast("int")), 1, RUN))
    sample = (able.join(F.broadcast(limits), "lang").where(F.col("place") < F.col("below")).withColumn("words", words)
              .select("lang", "place", spread.alias("words")).distinct())
    taken = sample.orderBy("place", "lang", "words").limit(4 * rows * len(langs)).collect()
    languages = sorted((r["lang"] for r in langs), key=str.encode)
    number, seen = {x: i for i, x in enumerate(languages)}, dict.fromkeys(languages, 0)
    made, labels = [], []
    for r in taken:
        seen[r["lang"]] += 1
        if seen[r["lang"]] <= rows:
            own = [w.encode()[:RUN] for w in r["words"] if w]
            made += own
            labels += [number[r["lang"]]] * len(own)
    # Few rows give many passes, so that a small table is learnt as well.
    return fit(made, np.array(labels), languages, max(EPOCHS, STEPS * BATCH // max(1, len(made))))


def predicted(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(network.languages) if network else 0
        met, known = np.zeros(0, np.uint64), np.zeros((0, n), np.float32)
        names = np.array([*(network.languages if network else []), UNKNOWN], object)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets):
                best, score = np.full(b - a, n), np.zeros(b - a)
                if n:
                    block = Block(data, offsets, a, b)
                    starts, sizes, rows = runs(block)
                    hashes, first, which = np.unique(block.hashes(starts, starts + sizes), return_index=True, return_inverse=True)
                    at = np.searchsorted(met, hashes)
                    new = np.ones(len(hashes), bool) if not len(met) else met[np.minimum(at, len(met) - 1)] != hashes
                    if len(met) + new.sum() > KEPT:
                        met, known, new = met[:0], known[:0], np.ones(len(hashes), bool)
                        at = np.zeros(len(hashes), np.int64)
                    made = network.totals(block.data, starts[first[new]], sizes[first[new]])
                    met, known = np.insert(met, at[new], hashes[new]), np.insert(known, at[new], made, axis=0)
                    each = known[np.searchsorted(met, hashes)][which]
                    length = np.maximum(np.bincount(rows, weights=sizes, minlength=b - a), 1)
                    mean = np.stack([np.bincount(rows, weights=each[:, k], minlength=b - a) for k in range(n)], 1) / length[:, None]
                    odds = np.exp(mean - mean.max(1, keepdims=True))
                    real = lettered(block.data, block.offsets)
                    best = np.where(real, odds.argmax(1), n)
                    score = np.where(real, 1 / odds.sum(1), 0.0)
                    if len(met) > KEPT:
                        met, known = met[:0], known[:0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                                                  pa.array(names[best], pa.string()), pa.array(score)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return split(docs).select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Train on the rows that are not held out and judge all."""
    return predicted(docs, train(docs, rows))
