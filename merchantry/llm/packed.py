"""Token streams of chunks and the answers that come back to them.

An operator that needs something for every distinct word (its ids, its count)
reads the documents twice.  The first pass cuts them into chunks and asks for
each chunk's distinct words once: rows (word, chunk key, number).  Answers
return to the chunk by its key, where the second pass has the chunk's words in
order as numbers.  So what moves grows with the distinct words of chunks, not
with the words.  A key is the hash of the chunk's word list; should the two
passes ever cut differently, an answer is missing and the job fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from merchantry.llm.common import Chunk


def key_of(chunk: Chunk) -> int:
    h = xxhash.xxh64()
    for word in chunk.words:
        h.update(word)
        h.update(b"\n")
    return int(np.uint64(h.intdigest()).view(np.int64))


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes in four planes: small numbers leave the high planes empty."""
    return np.ascontiguousarray(np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(numbers: np.ndarray) -> bytes:
    """The planes of the numbers, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(planes(numbers))


def unpack(blob: bytes) -> np.ndarray:
    return from_planes(zstandard.ZstdDecompressor().decompress(blob))


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One Arrow batch per row; for rows of megabytes."""
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
