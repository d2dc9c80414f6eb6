"""Texts of an Arrow batch as flat numpy arrays: bytes, words, hashes.

All helpers take whole texts. A null text counts as empty. Words are ``[^\\x20\\x09-\\x0D]+``, on bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer text makes a batch of its own.
BATCH_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text since memory was given back.
_since = 0
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece stay under ``limit`` bytes, or are one row.

    Memory that was freed goes back to the system after every ``BATCH_BYTES`` of text: workers are used again, and else keep the most they ever held.
    """
    global _since
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            _since += int(offsets[last] - offsets[first])
            if _since >= BATCH_BYTES:
                _since = 0
                give_back()
            first = last


def give_back() -> None:
    """Hand freed memory to the system: Arrow's, and that between blocks still in use (where the C library can)."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(judge: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of groups, after each of which memory is given back."""

    def run(rows: pa.Table) -> pa.Table:
        out = judge(rows)
        give_back()
        return out

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(1 << n.bit_length(), BATCH_BYTES // 4)
        for slot, base in ((0, int(_BASE)), (1, pow(int(_BASE), -1, 1 << 64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[slot] = np.cumprod(step)
    return _powers[0], _powers[1]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash modulo 2**64; ``span_hashes`` cuts any span out of it."""
    power, _ = _powers_to(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span, equal for equal contents wherever they stand."""
    _, inverse = _powers_to(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _BASE)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (one entry more than rows)."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def tight(values: np.ndarray) -> bytes:
    """Bytes of an array, compressed, after their length."""
    body = values.tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def untight(cell: pa.Buffer, dtype) -> np.ndarray:
    size = int.from_bytes(cell[:8], "little")
    return np.frombuffer(pa.decompress(cell[8:], decompressed_size=size, codec="zstd"), dtype=dtype)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``start, start+1, …`` of every start, ``count`` values each."""
    total = int(counts.sum())
    skip = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + skip
