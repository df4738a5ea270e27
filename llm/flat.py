"""Flat numpy views of Arrow text batches.

Everything that tokenises or hashes whole documents works on one contiguous
UTF-8 buffer with row offsets instead of one Python object per word, so the
cost is a few vector passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once, for each of which a worker holds some hundred bytes. A longer single document is a block of its own.
BLOCK_BYTES = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as one plain (non-dictionary, 32-bit offset) array."""
    values = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type):
        values = values.cast(pa.string() if pa.types.is_large_string(values.type) else pa.binary())
    return values


def blocks(values: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets); a null row has no bytes."""
    n = len(values)
    if n == 0:
        return
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) else b"")
    _, offset_buffer, data = values.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, _BASE if kind == "up" else _INV, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over random byte values, finalised."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(data)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_VALUES[data] * _power("up", n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", n + 1)[starts])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and after the last) of runs free of space and U+0009..000D."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    keep = inside[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each row and after the last) of the word shingles of each row.

    Words are lower-cased in A-Z. A row with fewer words than ``width`` gives
    its whole sequence as one shingle, and none if it has no word.
    """
    data = lower_ascii(data)
    starts, ends, first = words(data, offsets)
    h = span_hashes(data, starts, ends)
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(bounds[-1], np.uint64)
    position = np.arange(bounds[-1]) - np.repeat(bounds[:-1], made) + np.repeat(first[:-1], made)
    length = np.repeat(np.minimum(counts, width), made)
    folded = length.astype(np.uint64)
    for k in range(width):
        more = length > k
        if more.all():
            folded = mix(folded ^ (h[position + k] + np.uint64(k)))
        else:
            folded[more] = mix(folded[more] ^ (h[position[more] + k] + np.uint64(k)))
    out[:] = folded
    return out, bounds


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first run of each row and after the last) of the longest stretches of a row whose bytes are ``inside``."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    keep = inside[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)
