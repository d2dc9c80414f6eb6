"""Removal of byte strings that a smaller document holds, by a distributed suffix array.

Suffixes start at the anchors of ``anchors`` (each string of the given length has one), are dealt by range of their leading bytes
with sampled splitters, and sorted in their bucket by multikey quicksort. Neighbours' common prefixes say where strings that start at an
anchor agree; strings that start before it also compare what stands to its left. Buckets split between different leading bytes, so
that no group of agreeing suffixes lies across a border.

Cases: null and empty texts have nothing to remove; strings never cross documents and repeats within a document stay; rows of one
id are one document to each other; a null id counts as the largest; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from odflow.llm import anchors, text

LENGTH = 50
ANCHOR = 20
#: Ranges below this many suffixes are sorted by columns.
SMALL = 512


def multikey_order(columns: np.ndarray) -> np.ndarray:
    """Order of rows by columns, by three-way partition on one column at a time."""
    order = np.arange(columns.shape[0])
    work = [(0, len(order), 0)]
    depth = columns.shape[1]
    while work:
        low, high, column = work.pop()
        while column < depth and high - low > 1:
            part = order[low:high]
            values = columns[part, column]
            if len(part) <= SMALL:
                order[low:high] = part[np.lexsort(tuple(columns[part, c] for c in range(depth - 1, column - 1, -1)))]
                break
            pivot = np.partition(values[:: max(1, len(values) // 64)], min(32, len(values[:: max(1, len(values) // 64)]) // 2))
            pivot = pivot[len(pivot) // 2]
            less, same = np.flatnonzero(values < pivot), np.flatnonzero(values == pivot)
            more = np.flatnonzero(values > pivot)
            order[low:high] = part[np.concatenate((less, same, more))]
            work.append((low, low + len(less), column))
            work.append((high - len(more), high, column))
            low, high, column = low + len(less), high - len(more), column + 1
    return order


def _columns(body: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Up to ``width`` bytes from ``start`` in steps of ``step``, zero beyond ``size``, as big-endian words."""
    room = -(-width // 8) * 8
    out = np.zeros((len(start), room), dtype=np.uint8)
    for k in range(width):
        some = np.flatnonzero(size > k)
        out[some, k] = body[start[some] + step * k]
    return out


def judge(kind: anchors.Kind, held: anchors.Contexts) -> np.ndarray:
    """For each record, which strings around its anchor a smaller document holds."""
    right = _columns(held.body, held.start + held.left, held.size - held.left, kind.window, 1)
    left = _columns(held.body, held.start + held.left - 1, held.left, kind.reach - 1, -1)
    keys = np.concatenate((right.view(">u8"), left.view(">u8")), axis=1).astype(np.uint64)
    keys = np.concatenate((keys, (held.size << 16 | held.left).astype(np.uint64)[:, None]), axis=1)
    order = multikey_order(keys)
    differs = np.concatenate(([True], (keys[order[1:]] != keys[order[:-1]]).any(axis=1)))
    kind_of = np.empty(len(order), dtype=np.int64)
    kind_of[order] = np.cumsum(differs) - 1
    pick = order[differs]
    n = len(pick)
    record = kind_of[held.context]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, record, held.doc_id)

    # Bytes that a kind's suffix shares with the one before it.
    right, left_len, right_len = right[pick], held.left[pick], (held.size - held.left)[pick]
    apart = right[1:] != right[:-1]
    shared = np.concatenate(([0], np.where(apart.any(axis=1), apart.argmax(axis=1), kind.window)))
    smallest = np.full((n, kind.reach), np.iinfo(np.int64).max)
    before = np.zeros(n, dtype=np.uint64)
    left = left[pick]
    for a in range(kind.reach):
        if a:
            before = text.mix64(before + left[:, a - 1].astype(np.uint64) + np.uint64(1))
        run = np.cumsum(shared < kind.window - a)
        here = np.flatnonzero((left_len >= a) & (right_len >= kind.window - a))
        if not len(here):
            continue
        code = text.mix64(before[here] * np.uint64(0x9E3779B97F4A7C15) + text.mix64(run[here].astype(np.uint64)))
        by = np.argsort(code, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], code[by][1:] != code[by][:-1])))
        best = np.minimum.reduceat(least[here][by], begin)
        smallest[here[by], a] = np.repeat(best, np.diff(np.concatenate((begin, [len(by)]))))
    mask = np.zeros(len(held.context), dtype=np.uint32)
    for a in range(kind.reach):
        mask |= (smallest[record, a] < held.doc_id).astype(np.uint32) << np.uint32(a)
    return mask


def _cut(data, offsets, starts, ends, first, gone) -> dict:
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(offsets) - 1
    fresh = gone & ~(np.concatenate(([False], gone[:-1])) & (np.concatenate(([-1], row[:-1])) == row))
    left = np.bincount(row[~gone], minlength=n)
    upto = np.concatenate(([0], np.cumsum(left))).astype(np.int32)
    return {
        "n_bytes": pa.array(np.diff(offsets), pa.int64()),
        "n_removed": pa.array(np.bincount(row[gone], minlength=n), pa.int64()),
        "n_spans": pa.array(np.bincount(row[fresh], minlength=n), pa.int64()),
        "kept": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(data[~gone].tobytes())]),
    }


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: documents without the bytes that lie in a string of a smaller document."""
    if not length - 31 <= anchor <= length or anchor < 8:
        raise ValueError("an anchor has at least 8 bytes, and at most 31 less than the string's length are left out of it")
    kind = anchors.Kind(False, length, anchor, 1)
    return anchors.remove_repeats(docs, kind, judge, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
