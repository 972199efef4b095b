"""Arrow strings without Python objects: slices of batches, words' numbers in shared dictionaries, packed numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CODEC = pa.Codec("zstd", compression_level=1)


def packed(numbers: np.ndarray) -> bytes:
    """How many, then their bytes of one rank together, compressed: what is stored is about as long as the text compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(4, "little") + _CODEC.compress(planes, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(_CODEC.decompress(data[4:], 4 * n, asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def offsets_of(strings: pa.Array) -> np.ndarray:
    """Where large strings begin in their data, and the end of the last."""
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]


def strings_of(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), data)


def unified(parts: list[pa.DictionaryArray]) -> tuple[list[np.ndarray], pa.Array]:
    """The parts' numbers in a dictionary that they share, in which new strings come after those before, and that dictionary."""
    whole = pa.chunked_array(parts, pa.dictionary(pa.int32(), pa.large_string())).unify_dictionaries()
    own = [c.indices.to_numpy().view(np.uint32) for c in whole.chunks]
    return own, whole.chunk(0).dictionary if whole.num_chunks else pa.array([], pa.large_string())


def slices(batches: Iterator[pa.RecordBatch], most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `most` bytes of a column."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() if len(part) else []
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
