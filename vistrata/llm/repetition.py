"""Quality rules by repetition coverage: characters inside duplicated n-grams and duplicated lines.

Each Arrow batch is cut into blocks of rows; within a block, the hashes of all n-grams of one length are sorted once
for all rows. No row leaves its task and nothing is shuffled.

Defined cases: a null text counts as empty; an empty text has zeros everywhere and fails the base rules; repeated
rows and null doc_ids are judged row by row; further columns are ignored (`measure`) or passed on (`keep`), whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vistrata.llm.arrays import SEPARATOR, Block, blocks, covered, flat, grams, later, repeated, with_row

# Largest share (percent) of word characters inside n-grams that occurred earlier in the text, by n.
GRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
# Largest share (percent) of word characters inside lines that repeat an earlier line.
LINE_LIMIT = 20
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
# Largest number of symbols per hundred words.
SYMBOL_LIMIT = 50

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
           *(f"dup_gram_chars_{n}" for n in GRAM_LIMITS)]
SCHEMA = ", ".join(f"{c} bigint" for c in COLUMNS) + ", base_failed boolean, kept boolean"


def _block(block: Block) -> dict[str, np.ndarray]:
    starts, ends, rows = block.words()
    n, total = block.rows, len(starts)
    lead = np.concatenate(([0], np.cumsum(((block.data & 0xC0) != 0x80) & ~SEPARATOR[block.data], dtype=np.int64)))
    chars = lead[ends] - lead[starts]
    sums = lambda values, where: np.bincount(where, weights=values, minlength=n).astype(np.int64)
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": sums(chars, rows),
           "n_symbols": block.per_row(SYMBOL[block.data])}

    lines, stops, where = block.lines()
    first = np.searchsorted(starts, lines)
    spoken = np.searchsorted(starts, stops) > first
    lines, stops, where = lines[spoken], stops[spoken], where[spoken]
    keys = with_row(block.hashes(lines, stops), where)
    again = later(keys, np.ones(len(keys), bool))
    out["n_dup_lines"] = np.bincount(where[again], minlength=n)
    out["dup_line_chars"] = sums((lead[stops] - lead[lines])[again], where[again])

    hashes = block.hashes(starts, ends)
    for size in GRAM_LIMITS:
        values, at = grams(hashes, rows, size)
        values = with_row(values, rows[at])
        twice = repeated(values)
        again = covered(later(values, twice), at, size, total)
        out[f"dup_gram_chars_{size}"] = sums(chars[again], rows[again])
        if size == 8:
            both = covered(twice, at, size, total)
            out["n_repeat_words"] = np.bincount(rows[both], minlength=n)
    return out


def measures(text: pa.Array) -> dict[str, np.ndarray]:
    """All measures and the two verdicts of each text of a batch."""
    data, offsets = flat(text)
    parts = [_block(Block(data, offsets, a, b)) for a, b in blocks(offsets)]
    out = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COLUMNS}
    failed = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    kept = ~failed & (100 * out["dup_line_chars"] <= LINE_LIMIT * out["word_chars"])
    kept &= 100 * out["n_symbols"] <= SYMBOL_LIMIT * out["n_words"]
    for size, limit in GRAM_LIMITS.items():
        kept &= 100 * out[f"dup_gram_chars_{size}"] <= limit * out["word_chars"]
    return out | {"base_failed": failed, "kept": kept}


def measure(docs: DataFrame) -> DataFrame:
    """doc_id with every measure, base_failed and kept; one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = measures(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in made.values())],
                                             names=["doc_id", *made])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def keep(docs: DataFrame) -> DataFrame:
    """The rows whose text passes, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measures(batch.column(at))["kept"]))

    return docs.mapInArrow(run, docs.schema)
