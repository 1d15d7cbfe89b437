"""Token ids of whole texts by way of their distinct chunks.

A text is cut where no token can cross: before white space that follows a visible character (byte-level vocabularies),
or before a space that follows another character and around line breaks (piece vocabularies). The ids of a text are
then the ids of its chunks in order. Chunks repeat far more often than texts do, so each worker keeps a bounded table
of the chunks it has met, found by hash, and only new chunks reach the tokenizer. A block of more distinct chunks
than that (one very long text) has a table of its own, which is dropped after the block.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from vistrata.llm.arrays import SEPARATOR, Block, blocks

# Chunks and ids a worker keeps before it starts its table anew.
KEPT_CHUNKS, KEPT_IDS = 1 << 20, 1 << 23
# Chunks of a larger block that are encoded together.
SLICE = 1 << 18


def white_end(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte is white space beyond ASCII."""
    get = lambda back: data[np.maximum(at - back, 0)]
    c, p, q = data[at], get(1), get(2)
    two = (p == 0xC2) & ((c == 0x85) | (c == 0xA0))
    wide = (q == 0xE2) & (p == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    rest = (q == 0xE1) & (p == 0x9A) & (c == 0x80) | (q == 0xE2) & (p == 0x81) & (c == 0x9F) | (q == 0xE3) & (p == 0x80) & (c == 0x80)
    return two | wide | rest


def before_white(data: np.ndarray) -> np.ndarray:
    """Cuts for pre-tokens that hold white space at their start or alone: byte positions, the first never included."""
    last = data[:-1]
    at = np.flatnonzero(SEPARATOR[data[1:]] & (last > 0x20) & (last != 0x7F))
    far = at[data[at] >= 0x80]
    if len(far):
        at = np.setdiff1d(at, far[white_end(data, far)], assume_unique=True)
    return at + 1


def around_space(data: np.ndarray) -> np.ndarray:
    """Cuts for pieces that hold spaces at their start only and never a line break."""
    last, now = data[:-1], data[1:]
    return np.flatnonzero((now == 0x20) & (last != 0x20) | (now == 0x0A) | (last == 0x0A)) + 1


class Rows:
    """An array that grows at its end; room doubles, so that adding costs no copy of what is there."""

    def __init__(self, kind, width: tuple = ()):
        self.n, self.room = 0, np.zeros((1024, *width), kind)

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            room = np.zeros((max(n, 2 * len(self.room)), *self.room.shape[1:]), self.room.dtype)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:n] = values
        self.n = n

    @property
    def data(self) -> np.ndarray:
        return self.room[:self.n]


class Codec:
    """A table of chunks, by hash: their ids, and what `extra` makes of each (one object, or a row of several).

    `encode(chunks)` returns flat ids and the number of ids of each chunk. Chunks are found by open addressing: a slot
    per hash, the next one if that is taken.
    """

    def __init__(self, cuts: Callable, encode: Callable, extra: Callable | None = None):
        self.cuts, self.encode, self.extra = cuts, encode, extra
        self.clear()

    def clear(self) -> None:
        self._hashes, self._begin, self._length, self._ids = Rows(np.uint64), Rows(np.int64), Rows(np.int64), Rows(np.int32)
        self._things = None
        self.slots, self.shift = np.full(1 << 12, -1, np.int32), np.uint64(64 - 12)

    hashes = property(lambda self: self._hashes.data)
    begin = property(lambda self: self._begin.data)
    length = property(lambda self: self._length.data)
    ids = property(lambda self: self._ids.data)
    things = property(lambda self: self._things.data)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes in the table; -1 for unmet ones."""
        out, pending = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        at, keys, mask = (hashes >> self.shift).astype(np.int64), self.hashes, len(self.slots) - 1
        while len(pending):
            place = self.slots[at]
            taken = place >= 0
            pending, at, place = pending[taken], at[taken], place[taken]
            same = keys[place] == hashes[pending]
            out[pending[same]] = place[same]
            pending, at = pending[~same], (at[~same] + 1) & mask
        return out

    def _put(self, places: np.ndarray) -> None:
        at, mask = (self.hashes[places] >> self.shift).astype(np.int64), len(self.slots) - 1
        while len(places):
            free = self.slots[at] < 0
            self.slots[at[free]] = places[free]
            lost = self.slots[at] != places
            places, at = places[lost], (at[lost] + 1) & mask

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        ids, length = self.encode(chunks)
        first = self._hashes.n
        self._begin.add(self._ids.n + np.cumsum(length) - length)
        self._length.add(length)
        self._ids.add(ids)
        self._hashes.add(hashes)
        if self.extra:
            given = self.extra(ids, length, chunks)
            if isinstance(given, list):
                made = np.empty(len(given), object)
                made[:] = given
            else:
                made = given
            self._things = Rows(object, made.shape[1:]) if self._things is None else self._things
            self._things.add(made)
        if 2 * self._hashes.n > len(self.slots):
            bits = (2 * self._hashes.n).bit_length() + 1
            self.slots, self.shift, first = np.full(1 << bits, -1, np.int32), np.uint64(64 - bits), 0
        self._put(np.arange(first, self._hashes.n))

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """For each block of rows: start, end, table places of all chunks, first chunk of each row (and the end),
        byte starts and ends of the chunks within the block, and the block."""
        for a, b in blocks(offsets):
            block = Block(data, offsets, a, b)
            at_cut = block.edges(block.offsets[:-1])[:-1]
            if len(at_cut):
                at_cut[self.cuts(block.data)] = True
            starts = np.flatnonzero(at_cut)
            ends = np.append(starts[1:], len(block.data)) if len(starts) else starts
            hashes = block.hashes(starts, ends)
            places = self._find(hashes)
            unmet = np.flatnonzero(places < 0)
            at = unmet[np.unique(hashes[unmet], return_index=True)[1]]
            if len(at) and (len(self.hashes) + len(at) > KEPT_CHUNKS or len(self.ids) > KEPT_IDS):
                self.clear()
                unmet = np.arange(len(hashes))
                at = np.unique(hashes, return_index=True)[1]
            at = np.sort(at)
            raw = block.data.tobytes() if len(at) else b""
            for part in (at[i:i + SLICE] for i in range(0, len(at), SLICE)):
                self._learn(hashes[part], [raw[i:j] for i, j in zip(starts[part].tolist(), ends[part].tolist())])
            if len(at):
                places[unmet] = self._find(hashes[unmet])
            yield a, b, places, np.searchsorted(starts, block.offsets), starts, ends, block
            if len(self.hashes) > KEPT_CHUNKS:
                self.clear()

    def ids_of(self, places: np.ndarray) -> np.ndarray:
        """Ids of chunks in order."""
        length = self.length[places]
        total = int(length.sum())
        return self.ids[np.repeat(self.begin[places] - np.cumsum(length) + length, length) + np.arange(total)]


_CODECS: dict = {}


def kept(kind: str, path: str, make: Callable) -> Codec:
    """The worker's codec for a vocabulary file; it lives as long as the worker."""
    if (kind, path) not in _CODECS:
        _CODECS[kind, path] = make(path)
    return _CODECS[kind, path]


def byte_bpe(path: str) -> Codec:
    """Codec of a byte-level vocabulary in the tokenizers library's format."""
    return kept("byte_bpe", path, _byte_bpe)


def _byte_bpe(path: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # A token's text has one character per byte.
    size = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        size[i] = len(token)
    plain = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with white space are joined: the seams are cuts, so the ids are the same."""
        width = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends, raw = np.cumsum(width), np.frombuffer(b"".join(chunks), np.uint8)
        last = raw[ends - 1]
        spaced = SEPARATOR[raw[ends - width]] & (width > 1) & ~SEPARATOR[last] & (last < 0x80)
        own, runs = np.flatnonzero(~spaced), np.flatnonzero(spaced)
        alone = plain([chunks[i].decode() for i in own])
        length = np.zeros(len(chunks), np.int64)
        length[own] = [len(x) for x in alone]
        made = [np.fromiter(chain.from_iterable(alone), np.int32, int(length[own].sum()))]
        for a in range(0, len(runs), 4096):
            part = runs[a:a + 4096]
            ids = np.array(plain([b"".join([chunks[i] for i in part]).decode()])[0], np.int32)
            cuts = np.searchsorted(np.cumsum(size[ids]), np.cumsum(width[part]), "left") + 1
            length[part] = np.diff(cuts, prepend=0)
            made.append(ids)
        # The ids stand by kind of chunk; put them in the order of the chunks.
        order, begin = np.concatenate((own, runs)), np.cumsum(length) - length
        n = length[order]
        out = np.zeros(int(n.sum()), np.int32)
        out[np.repeat(begin[order] - np.cumsum(n) + n, n) + np.arange(len(out))] = np.concatenate(made)
        return out, length

    return Codec(before_white, encode)


def empty_batch(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
