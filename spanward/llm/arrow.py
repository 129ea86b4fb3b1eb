"""Texts of an Arrow batch as one byte array, and hashes of its parts.

Tasks work on slices of a batch, so memory stays bounded whatever a partition holds; one text is never cut.
Hashes have 64 bits: equal bytes give equal hashes, and different ones agree with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
RELEASE_EVERY = 16
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random 64-bit number for every byte.
BYTE_VALUE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_VALUE = BYTE_VALUE[_LOWER]
_powers: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1 at least, modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(20, int(n).bit_length())
        row = np.full(size, base, U)
        row[0] = 1
        _powers[base] = np.multiply.accumulate(row)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins (one more entry at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: Spark reuses Python workers, and each would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def row_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut at rows so that each holds about ``limit`` bytes of text, or one row."""
    given = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            if given % RELEASE_EVERY == 0:  # from the first one on: a task begins with what the last one left
                release()
            given += 1
            yield batch.slice(at, end - at)
            at = end


class Prefix:
    """Hashes of any substrings of ``data`` in constant time each."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUE):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values[data] * _table(_BASE, n + 1)[:n], out=self.sums[1:])
        self.back = _table(_INVERSE, n + 1)

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Not spread; equal for equal substrings."""
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]

    def of_length(self, n: int) -> np.ndarray:
        """Of the substring of ``n`` bytes at every place where one fits."""
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.back[:m]) if m > 0 else np.zeros(0, U)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) ^ (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes with ``inside[byte]`` that cross no text; first word of each text."""
    member = inside[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    start, end = member.copy(), member.copy()
    if len(data):
        start[1:] &= ~member[:-1] | fresh[1:-1]
        end[:-1] &= ~member[1:] | fresh[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """``values[bounds[i]:bounds[i + 1]]`` as one binary value each."""
    values = np.ascontiguousarray(values)
    places = np.asarray(bounds, np.int64) * values.dtype.itemsize
    base, last = int(places[0]), int(places[-1])
    body = pa.py_buffer(values.view(np.uint8)[base:last]) if len(values) else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places - base), body]).cast(pa.binary())


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The substrings as Arrow texts, copied next to each other."""
    lengths = ends - starts
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=places[1:])
    depth = np.zeros(len(data) + 1, np.int8)
    depth[starts] += 1
    depth[ends] -= 1
    body = data[np.cumsum(depth[:-1], dtype=np.int8).astype(bool)]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(body))])


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_key, text) as (doc_key, body), compressed: what joins of texts shuffle."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in row_slices(batches, "text"):
        bodies = [pack(t.encode() if t else b"") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["doc_key", "body"])


def unpacked(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(body)
