"""Encoding and decoding with merge-type piece vocabularies by a score-ordered agenda of adjacent symbol pairs.

A chunk starts as its characters. The agenda holds every adjacent pair whose concatenation is a piece; the best score
goes first, the leftmost of equals. All chunks that are new to a worker take their steps together in numpy; chunks of
more than LONG symbols run a heap of their own. Characters outside the vocabulary become byte pieces. In each Arrow
batch the new chunks are also encoded and decoded by the sentencepiece library; where a result differs, the library's
stands and the row's n_differing counts it.

Pieces hold their space mark at the start only and never a line break, so texts are cut into chunks there (checked
when a vocabulary is read) and the ids of a text are those of its chunks.

Defined cases: a null or empty text holds the end id only and decodes to an empty text; the space mark itself in a
text counts as a space, as in the library; rows are independent, so repeated rows and null doc_ids need no care;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vistrata.llm.arrays import flat
from vistrata.llm.codec import Codec, around_space, kept

MARK = "▁"
LONG = 48
# Chunks that the library encodes and decodes in one call.
RUN = 2048
# Kinds of pieces in the vocabulary file.
PLAIN, BYTE = 1, 6
NONE = np.int64(1) << np.int64(62)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = model.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or spec.normalizer_spec.name != "identity":
            raise ValueError("only merge-type vocabularies with byte pieces and no normalisation are supported")
        plain = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == PLAIN}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError("pieces must hold their space mark at the start only")
        self.end = self.library.eos_id()
        self.size = len(spec.pieces)
        # Characters that only occur inside pieces take ids beyond the vocabulary.
        letters = sorted({c for p in plain for c in p} - set(plain))
        self.id_of = plain | {c: self.size + i for i, c in enumerate(letters)}
        self.other = self.size + len(letters)
        self.character = np.full(0x110000, -1, np.int32)
        for c, i in self.id_of.items():
            if len(c) == 1:
                self.character[ord(c)] = i
        self.byte = np.zeros(256, np.int32)
        self.text = np.zeros(self.size, object)
        self.text[:] = b""
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte[value], self.text[i] = i, bytes([value])
            elif p.type == PLAIN:
                self.text[i] = p.piece.replace(MARK, " ").encode()
        self.width = np.array([len(t) for t in self.text.tolist()], np.int64)
        rank = {s: r for r, s in enumerate(sorted({spec.pieces[i].score for i in plain.values()}, reverse=True))}
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                if p[:k] in self.id_of and p[k:] in self.id_of:
                    pairs[self.id_of[p[:k]] << 21 | self.id_of[p[k:]]] = (rank[spec.pieces[i].score], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.pairs = pairs

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair is no piece) and merged id of adjacent symbols."""
        key = (left.astype(np.int64) << np.int64(21)) | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def agenda(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no chunk has a pair left: one step per chunk and turn. Owners are ascending. A step changes the
        pairs on both sides of the new symbol only."""
        done_symbols, done_owner, done_place = [], [], []
        place = np.arange(len(symbols))
        rank, merged = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int32)
        changed = np.arange(len(symbols) - 1)
        while len(symbols):
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed], merged[changed] = self.look_up(symbols[changed], symbols[changed + 1])
            begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            order = np.where(rank < NONE, (rank << np.int64(32)) + np.arange(len(symbols)), NONE)
            best = np.minimum.reduceat(order, begins)
            found = best < NONE
            if not found.all():
                active = np.repeat(found, np.diff(np.append(begins, len(symbols))))
                done_symbols.append(symbols[~active])
                done_owner.append(owner[~active])
                done_place.append(place[~active])
            else:
                active = np.ones(len(symbols), bool)
            at = best[found] & np.int64(0xFFFFFFFF)
            symbols[at] = merged[at]
            active[at + 1] = False
            after = np.cumsum(active)[at] - 1
            symbols, owner, place, rank, merged = symbols[active], owner[active], place[active], rank[active], merged[active]
            # The new symbol has no pair until it is looked up with its neighbours.
            rank[after] = NONE
            changed = np.concatenate((after[after > 0] - 1, after[after + 1 < len(symbols)]))
        symbols, owner, place = (np.concatenate(x) for x in (done_symbols, done_owner, done_place))
        order = np.argsort(place)
        return symbols[order], owner[order]

    def heap(self, symbols: list[int]) -> list[int]:
        """The same agenda for one long chunk, as a heap over a linked list."""
        after, before = [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
        agenda = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
                hit = self.pairs.get(symbols[i] << 21 | symbols[j])
                if hit:
                    heapq.heappush(agenda, (hit[0], i, j, symbols[i], symbols[j], hit[1]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, left, right, merged = heapq.heappop(agenda)
            if symbols[i] != left or symbols[j] != right or after[i] != j:
                continue
            symbols[i], symbols[j] = merged, -2
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = after[i]
        return out

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks by the agenda; no start or end ids, no space added."""
        raw = b"".join(chunks)
        points = np.frombuffer(raw.decode().replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        # A character's first byte is any but 10xxxxxx.
        heads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        sizes = np.diff(heads[np.cumsum([0, *map(len, chunks)])])
        owner = np.repeat(np.arange(len(chunks)), sizes)
        symbols = self.character[points]
        # Unknown characters never merge; keep their code points below -2.
        symbols = np.where(symbols < 0, -3 - points, symbols).astype(np.int64)
        short = sizes[owner] <= LONG
        made, whose = self.agenda(symbols[short].copy(), owner[short]) if short.any() else (symbols[:0], owner[:0])
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            begins = np.cumsum(sizes) - sizes
            parts = [np.array(self.heap(symbols[begins[i]:begins[i] + sizes[i]].tolist()), np.int64) for i in long]
            made = np.concatenate((made, *parts))
            whose = np.concatenate((whose, np.repeat(long, [len(p) for p in parts])))
            order = np.argsort(whose, kind="stable")
            made, whose = made[order], whose[order]
        odd = np.flatnonzero((made < 0) | (made >= self.size))
        if len(odd):
            letter = {i: c for c, i in self.id_of.items() if i >= self.size}
            raw = [(chr(-3 - x) if x < 0 else letter[x]).encode() for x in made[odd].tolist()]
            width = np.ones(len(made), np.int64)
            width[odd] = [len(r) for r in raw]
            spread, whose = np.repeat(made, width), np.repeat(whose, width)
            where = np.cumsum(width) - width
            spread[np.repeat(where[odd], width[odd]) + np.concatenate([np.arange(len(r)) for r in raw])] = \
                self.byte[np.frombuffer(b"".join(raw), np.uint8)]
            made = spread
        return made.astype(np.int32), np.bincount(whose, minlength=len(chunks))

    def checked(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The agenda's ids, held against the library's: RUN chunks at once, a line break before each. Where a run
        differs, its chunks are encoded one by one."""
        ids, length = self.encode(chunks)
        self.differing = np.zeros(len(chunks), bool)
        cuts, fixed = np.concatenate(([0], np.cumsum(length))), {}
        for a in range(0, len(chunks), RUN):
            b = min(a + RUN, len(chunks))
            theirs = self.library.encode((b"\n" + b"\n".join(chunks[a:b])).decode(), num_threads=1)
            own = np.insert(ids[cuts[a]:cuts[b]], cuts[a:b] - cuts[a], self.byte[10])
            # The library puts a space before each text.
            if len(theirs) != len(own) + 1 or not np.array_equal(np.array(theirs[1:], np.int32), own):
                for i in range(a, b):
                    alone = self.library.encode("\n" + chunks[i].decode(), num_threads=1)[2:]
                    if alone != ids[cuts[i]:cuts[i + 1]].tolist():
                        self.differing[i], fixed[i] = True, alone
        if fixed:
            lists = [np.array(fixed[i], np.int32) if i in fixed else ids[cuts[i]:cuts[i + 1]] for i in range(len(chunks))]
            return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
        return ids, length

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, the leading space kept."""
        return b"".join(self.text[ids])

    def extra(self, ids: np.ndarray, length: np.ndarray, chunks: list[bytes]) -> np.ndarray:
        """Of each chunk: its ids as text, its decoded bytes, whether the library differed. RUN chunks are decoded at
        once and held against the library as a whole; where they differ, one by one."""
        out = np.empty((len(chunks), 3), object)
        cuts = np.concatenate(([0], np.cumsum(length)))
        places = np.concatenate(([0], np.cumsum(self.width[ids])))[cuts].tolist()
        raw = self.decode(ids)
        digits, each = list(map(str, ids.tolist())), cuts.tolist()
        out[:, 0] = [" ".join(digits[a:b]) for a, b in zip(each, each[1:])]
        out[:, 1] = [raw[a:b] for a, b in zip(places, places[1:])]
        out[:, 2] = self.differing.tolist()
        # The library's decoder drops one leading space, unless something precedes it.
        theirs = lambda part: self.library.decode([int(self.byte[10]), *part.tolist()])[1:].encode()
        for a in range(0, len(chunks), RUN):
            b = min(a + RUN, len(chunks))
            if theirs(ids[each[a]:each[b]]) != raw[places[a]:places[b]]:
                for i in range(a, b):
                    other = theirs(ids[each[i]:each[i + 1]])
                    if other != out[i, 1]:
                        out[i, 1], out[i, 2] = other, True
        return out


def codec(path: str) -> Codec:
    def make(p: str) -> Codec:
        vocabulary = Vocabulary(p)
        out = Codec(around_space, vocabulary.checked, vocabulary.extra)
        out.vocabulary = vocabulary
        return out

    return kept("agenda", path, make)


def spaced(text: pa.Array) -> pa.Array:
    """Texts as the agenda takes them: a space before each non-empty one, marks as spaces."""
    text = pc.fill_null(text, "")
    text = pc.replace_substring(text, MARK, " ")
    return pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", text.type), text, pa.scalar("", text.type)))


def encoded(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_differing (chunks the library encodes or decodes otherwise)
    of every text, end id included; with `ids` also the ids and the decoded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        end = own.vocabulary.end
        last = str(end)
        for batch in batches:
            data, offsets = flat(spaced(batch.column(1)))
            for a, b, places, first, *_ in own.blocks(data, offsets):
                things = own.things[places] if len(places) else np.zeros((0, 3), object)
                words, raw = things[:, 0].tolist(), things[:, 1].tolist()
                differs = np.concatenate(([0], np.cumsum(things[:, 2].astype(bool))))
                counts = np.concatenate(([0], np.cumsum(own.length[places])))
                made = {"doc_id": batch.column(0).slice(a, b - a), "n_tokens": pa.array(np.diff(counts[first]) + 1)}
                hashes, decoded, whole = [], [], []
                for i in range(b - a):
                    part = slice(first[i], first[i + 1])
                    line = " ".join([*words[part], last])
                    text = b"".join(raw[part])[1:]
                    hashes.append(hashlib.sha256(line.encode()).hexdigest())
                    decoded.append(hashlib.sha256(text).hexdigest())
                    if ids:
                        whole.append((np.append(own.ids_of(places[part]), end), text.decode()))
                made |= {"ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()),
                         "n_differing": pa.array(np.diff(differs[first]))}
                if ids:
                    made |= {"ids": pa.array([w[0] for w in whole], pa.list_(pa.int32())),
                             "decoded": pa.array([w[1] for w in whole], pa.string())}
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if ids else ""
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_differing bigint{more}")
