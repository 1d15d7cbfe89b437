"""The chunk table on blocks of more distinct chunks than it keeps."""

import numpy as np
import pyarrow as pa

from vistrata.llm import codec
from vistrata.llm.arrays import flat


def test_block_beyond_the_table(monkeypatch):
    monkeypatch.setattr(codec, "KEPT_CHUNKS", 100)
    monkeypatch.setattr(codec, "SLICE", 64, raising=False)
    # The ids of a chunk are its bytes.
    encode = lambda chunks: (np.frombuffer(b"".join(chunks), np.uint8).astype(np.int32), np.array([len(c) for c in chunks]))
    own = codec.Codec(codec.before_white, encode, lambda ids, length, chunks: chunks)
    texts = ["few words", " ".join(f"w{i}" for i in range(1000)), "few words again", "", " ".join(f"x{i % 90}" for i in range(500))]
    for _ in range(2):
        for text in texts:
            data, offsets = flat(pa.array([text], pa.large_string()))
            made = [(bytes(own.ids_of(p).astype(np.uint8)).decode(), b"".join(own.things[p]).decode()) for _, _, p, *_ in own.blocks(data, offsets)]
            assert "".join(x for x, _ in made) == "".join(x for _, x in made) == text
            assert len(own.hashes) <= 100
