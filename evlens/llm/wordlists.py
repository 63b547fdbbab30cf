"""Words of whole Arrow text columns, without a Python string per word."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Every byte of every text replaced by ``table``; null reads as empty.

    ``table`` must leave bytes from 0x80 on alone, so that the result is UTF-8 again.
    """
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    if data is None or not len(texts) or offsets[-1] == offsets[0]:
        return texts
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    new = np.frombuffer(table, np.uint8)[raw]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(new)])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All maximal pieces without spaces, one text after another, and how many each text has."""
    pieces = pc.split_pattern(texts, " ")
    flat = pieces.flatten()
    offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(real), np.diff(upto[offsets])
