"""Token counts under edits: a segment tree of pre-token runs per document, re-encoding only what an edit touches.

A text is cut into pre-token chunks where no token can cross (`codec.before_white`); LEAF chunks make a leaf. A tree is
two arrays of the same shape, characters and tokens, in heap order: node i sums nodes 2i and 2i + 1, the root at 1
(place 0 is unused), leaves in the last 2^d places, empty ones after the text's end. A tree is a column of its document, kept
between runs.

An edit replaces `length` characters from `start` by `insert`. The tree is descended to the leaves of both ends; their
text with the edit, and a neighbouring leaf where the edit touched the white space or the visible character at a cut,
is encoded again; its count goes to the first of these leaves, the others become empty, and the sums above are
updated. Edits apply in order, each to the result of the one before. Leaves that outgrew OUTGROWN chunks' worth of
characters are cut anew when the edits are done.

Defined cases: a null or empty text is an empty tree of one leaf; null edits are none; an edit beyond the end acts at
the end, negative starts and lengths count as 0, a null insert as empty; rows are independent, so repeated rows and
null doc_ids need no care; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrata.llm.arrays import flat
from vistrata.llm.codec import Codec, byte_bpe

LEAF = 16
OUTGROWN = 8 * LEAF * 6
EDITS = "array<struct<start:int,length:int,insert:string>>"
WHITE = "\t\n\v\f\r "


def heap(leaves: np.ndarray) -> np.ndarray:
    """Sums over leaves in heap order."""
    width = 1 << max(0, int(len(leaves) - 1).bit_length())
    out = np.zeros(2 * width, np.int64)
    out[width:width + len(leaves)] = leaves
    while width > 1:
        half = width >> 1
        out[half:width] = out[width:2 * width].reshape(-1, 2).sum(1)
        width = half
    return out


def grow(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text, chars and tokens: every text with its tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(tokenizer)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b, places, first, starts, ends, block in codec.blocks(data, offsets):
                row = np.repeat(np.arange(b - a), np.diff(first))
                rank = np.arange(len(row)) - first[row]
                begins = np.flatnonzero(rank % LEAF == 0)
                lead = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
                chars = lead[ends] - lead[starts]
                sums = [np.add.reduceat(x, begins) if len(begins) else x for x in (chars, codec.length[places])]
                cuts = np.searchsorted(row[begins], np.arange(b - a + 1))
                trees = [[heap(s[i:j] if j > i else s[:0].astype(np.int64)) for i, j in zip(cuts[:-1], cuts[1:])] for s in sums]
                made = []
                for side in trees:
                    bounds = np.concatenate(([0], np.cumsum([len(t) for t in side]))).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(side).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns] + made,
                                                 names=[*batch.schema.names, "chars", "tokens"])

    some = docs.select("doc_id", "text", *(["edits"] if "edits" in docs.columns else []))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema)
    return some.mapInArrow(run, f"{fields}, chars array<int>, tokens array<int>")


class Tree:
    """One document's tree with the text of its leaves."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, codec: Codec):
        self.chars, self.tokens, self.codec = chars.astype(np.int64), tokens.astype(np.int64), codec
        self.width = len(chars) // 2
        cuts = np.cumsum(self.chars[self.width:]).tolist()
        self.leaves = [text[i:j] for i, j in zip([0, *cuts], cuts)]
        self.encoded = 0

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character position, and the position inside it; the end is in the last full leaf."""
        node, at = 1, min(at, int(self.chars[1]))
        while node < self.width:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= int(self.chars[node])
                node += 1
        return node - self.width, at

    def count(self, text: str) -> int:
        self.encoded += len(text)
        return int(self.codec.encode([text.encode()])[1][0]) if text else 0

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        for sums, value in ((self.chars, len(text)), (self.tokens, tokens)):
            node = leaf + self.width
            change = value - sums[node]
            while node:
                sums[node] += change
                node >>= 1

    def neighbour(self, leaf: int, step: int) -> int:
        """The nearest leaf with text on one side; -1 where there is none."""
        leaf += step
        while 0 <= leaf < self.width and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.width else -1

    def edit(self, start: int, length: int, insert: str) -> None:
        first, at = self.find(start)
        last, end = self.find(start + length)
        # Whole leaves between the two ends are dropped without reading them.
        region = self.leaves[first][:at] + insert + self.leaves[last][end:]
        while True:  # a cut needs a visible ASCII character before it, or a letter, and white space after it
            left = self.neighbour(first, -1)
            if left >= 0 and region and not self.cut(self.leaves[left], region):
                first, region = left, self.leaves[left] + region
                continue
            right = self.neighbour(last, 1)
            before = region or (self.leaves[left] if left >= 0 else "")
            if right >= 0 and before and not self.cut(before, self.leaves[right]):
                last, region = right, region + self.leaves[right]
                continue
            break
        self.put(first, region, self.count(region))
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self.put(leaf, "", 0)

    @staticmethod
    def cut(before: str, after: str) -> bool:
        return after[0] in WHITE and not before[-1].isspace() and before[-1] > " " and before[-1] != "\x7f"

    def renewed(self) -> tuple[np.ndarray, np.ndarray]:
        """The arrays, with outgrown leaves cut anew and empty ones left out."""
        if max(map(len, self.leaves)) <= OUTGROWN:
            return self.chars, self.tokens
        chars, tokens = [], []
        for leaf, text in enumerate(self.leaves):
            if len(text) <= OUTGROWN:
                if text:
                    chars.append(len(text))
                    tokens.append(int(self.tokens[self.width + leaf]))
                continue
            data, offsets = flat(pa.array([text], pa.large_string()))
            for _, _, places, _, starts, ends, block in self.codec.blocks(data, offsets):
                begins = np.arange(0, len(starts), LEAF)
                lead = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
                chars += np.add.reduceat(lead[ends] - lead[starts], begins).tolist()
                tokens += np.add.reduceat(self.codec.length[places], begins).tolist()
        return heap(np.array(chars, np.int64)), heap(np.array(tokens, np.int64))


def revise(trees: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text, chars, tokens after `edits`, with n_tokens_before, n_tokens, n_edits and n_encoded (characters
    read again)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(tokenizer)
        for batch in batches:
            texts, edits = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a in range(0, len(texts), 500):
                rows = range(a, min(a + 500, len(texts)))
                out = []
                for i in rows:
                    tree = Tree(texts[i] or "", batch.column(3)[i].values.to_numpy(), batch.column(4)[i].values.to_numpy(), codec)
                    before = int(tree.tokens[1])
                    own = [e for e in edits[i] or [] if e is not None]
                    for e in own:
                        tree.edit(max(0, e["start"] or 0), max(0, e["length"] or 0), e["insert"] or "")
                    chars, tokens = tree.renewed()
                    out.append(("".join(tree.leaves), chars, tokens, before, int(tree.tokens[1]), len(own), tree.encoded))
                text, chars, tokens, *counts = zip(*out)
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(rows)), pa.array(text, pa.string()), pa.array(chars, ints), pa.array(tokens, ints),
                     *(pa.array(c, pa.int64()) for c in counts)],
                    names=["doc_id", "text", "chars", "tokens", "n_tokens_before", "n_tokens", "n_edits", "n_encoded"])

    kind = trees.schema["doc_id"].dataType.simpleString()
    return trees.select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits"), "chars", "tokens").mapInArrow(
        run, f"doc_id {kind}, text string, chars array<int>, tokens array<int>, n_tokens_before bigint, n_tokens bigint, "
             "n_edits bigint, n_encoded bigint")


def house_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text and the revision of each document: its source put before the text, up to 40 characters cut out of
    the middle, its language put after the end."""
    size = F.length("text")
    edit = lambda start, length, insert: F.struct(
        start.cast("int").alias("start"), F.lit(length).alias("length"), insert.cast("string").alias("insert"))
    head = F.concat(F.lit("source: "), F.coalesce("source", F.lit("")), F.lit("\n"))
    edits = F.array(edit(F.lit(0), 0, head), edit(F.length(head) + F.floor(size / 2), 40, F.lit("")),
                    edit(F.length(head) + size, 0, F.concat(F.lit("\n"), F.coalesce("lang", F.lit("")))))
    return docs.select("doc_id", "text", F.when(F.col("text").isNotNull(), edits).alias("edits"))
