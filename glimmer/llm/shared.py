"""What several operators of this subpackage share: checkpoints, and words as numpy arrays.

Words are the maximal runs of bytes other than space and the five controls 0x09-0x0D. Everything
works on UTF-8 bytes in Arrow buffers, so no Python string is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators.graph import settled, shared_folder  # noqa: F401  for the modules of this subpackage

#: Regular expression (Java) for the white space that ends a word.
SPACE = "[\\x20\\x09-\\x0D]+"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def n_pieces(df: DataFrame, column: str, piece_bytes: int) -> int:
    """How many pieces of about piece_bytes the column's UTF-8 bytes make; at least one."""
    total = df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(1, -(-int(total) // piece_bytes))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z turned into a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (and their total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = np.ones(len(data) + 1, bool)
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=solid[:-1])
    solid[-1] = False
    first = solid[:-1].copy()
    first[1:] &= ~solid[:-2]
    last = solid[:-1] & ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte at each of a word's first 64 places.
_PLACES = 64
_BYTE_VALUES = mixed(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a random value for every (place, byte), mixed.

    Works through blocks of about a million bytes, so that memory doesn't follow a text's length.
    """
    sizes = ends - starts
    total = np.cumsum(sizes)
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + block, "right")))
        size = sizes[a:b]
        before = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(before, size)
        byte = data[place + np.repeat(starts[a:b], size)].astype(np.int64)
        if size.max(initial=0) <= _PLACES:
            value = _BYTE_VALUES[(place << 8) | byte]
        else:
            value = mixed((((place.astype(np.uint64)) << np.uint64(8)) + byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        out[a:b] = np.add.reduceat(value, before)
        a = b
    return mixed(out + sizes.astype(np.uint64))


def windows_within(before: np.ndarray, size: int) -> np.ndarray:
    """Places (word numbers) at which a window of that many words starts and stays in its text."""
    counts = np.maximum(np.diff(before) - size + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.int64)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return inner + np.repeat(before[:-1], counts)


def window_hashes(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of size hashes, in order; len(hashes) - size + 1 of them."""
    n = max(0, len(hashes) - size + 1)
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed * 1000003)) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * factors[k]
    return mixed(out)


def window_hashes_at(hashes: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """What window_hashes gives at these places only."""
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed * 1000003)) | np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out += hashes[at + k] * factors[k]
    return mixed(out)


def texts(pieces: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string column out of UTF-8 bytes and each text's number of bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    column = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pieces))])
    return column.cast(pa.string())


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given words, a space after each, as bytes, with their new starts and ends."""
    sizes = ends - starts + 1
    last = np.cumsum(sizes)
    first = last - sizes
    place = np.arange(last[-1] if len(last) else 0) + np.repeat(starts - first, sizes)
    out = data[np.minimum(place, max(0, len(data) - 1))] if len(place) else np.zeros(0, np.uint8)
    out[last - 1] = 32
    return out, first, last - 1


def portions(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 1 << 22):
    """The batch in slices of whole rows with about limit bytes of text each (one row may have more)."""
    sizes = np.diff(utf8(batch.column(column))[1])
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield batch.slice(a, b - a)
        a = b


def packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers as their differences, byte plane after byte plane (zeros compress well)."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """64-bit integers, byte plane after byte plane."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()
