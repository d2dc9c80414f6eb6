"""Removal of word sequences that a smaller document holds, by suffix automata.

Reference shards are the surroundings of anchors that occur in two documents (see ``anchors``), dealt by range and grouped by anchor. In
each group an automaton of the surroundings seen so far, in order of document, is streamed with the next ones for matching statistics; where
the matched length reaches the threshold, that window occurs in a smaller document. Surroundings that are equal as a whole need no automaton.
A group above ``SHARD_WORDS`` words is cut into shards: each shard's automaton is built once, streamed with all later surroundings and
dropped, so that a task holds one bounded automaton.

The shards go to the documents' matching parts by shuffle, not to all tasks by broadcast: all documents are reference to each
other, so a broadcast would grow with the data.

Cases: as in ``suffix``, for words; a text without words keeps the empty string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from odflow.llm import anchors, text

WORDS = 13
ANCHOR = 5
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """A copy of ``target`` for the shorter contexts that end in ``at`` and ``word``."""
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, sequence: list[int]) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for word in sequence:
            target = moves[last].get(word)
            if target is not None:
                last = target if length[target] == length[last] + 1 else self._split(last, word, target)
                continue
            new = self._state(length[last] + 1, {}, 0)
            at = last
            while at != -1 and word not in moves[at]:
                moves[at][word] = new
                at = link[at]
            if at != -1:
                target = moves[at][word]
                link[new] = target if length[target] == length[at] + 1 else self._split(at, word, target)
            last = new

    def matched(self, sequence: list[int]) -> list[int]:
        """Length of the longest known substring that ends at each word."""
        moves, link, length = self.next, self.link, self.length
        at, size, out = 0, 0, []
        for word in sequence:
            while at and word not in moves[at]:
                at = link[at]
                size = length[at]
            target = moves[at].get(word)
            if target is not None:
                at, size = target, size + 1
            out.append(size)
        return out


def judge(kind: anchors.Kind, held: anchors.Contexts) -> np.ndarray:
    """For each record, which windows around its anchor a smaller document holds."""
    n = len(held.size)
    prefix = text.prefix_hashes(held.body)
    end = held.start + held.size
    whole = text.span_hashes(prefix, held.start, end) + held.left.astype(np.uint64)
    at = held.start + held.left
    group = text.span_hashes(prefix, at, at + kind.anchor)
    _, pick, kind_of = np.unique(whole, return_index=True, return_inverse=True)
    record = kind_of[held.context]
    least = np.full(len(pick), np.iinfo(np.int64).max)
    np.minimum.at(least, record, held.doc_id)

    # Windows of a kind that occur in another kind whose smallest document is smaller.
    found = np.zeros(len(pick), dtype=np.uint32)
    order = np.lexsort((least, group[pick]))
    keys = group[pick][order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if n else np.zeros(0, dtype=np.int64)
    for low, high in zip(begin, np.concatenate((begin[1:], [len(order)])), strict=True):
        if high - low > 1:
            _stream(kind, held, pick, order[low:high], least, found)
    low_a, high_a = kind.window - (held.size - held.left)[pick], held.left[pick]
    full = ((np.uint64(1) << (high_a + 1).astype(np.uint64)) - (np.uint64(1) << low_a.astype(np.uint64))).astype(np.uint32)
    return np.where(least[record] < held.doc_id, full[record], found[record]).astype(np.uint32)


def _stream(kind: anchors.Kind, held: anchors.Contexts, pick: np.ndarray, members: np.ndarray, least: np.ndarray, found: np.ndarray) -> None:
    sequences = [held.body[held.start[pick[m]] : held.start[pick[m]] + held.size[pick[m]]].tolist() for m in members]
    owner, lefts = least[members].tolist(), held.left[pick[members]].tolist()
    first = 0
    while first < len(members):
        automaton, words, shard_end = SuffixAutomaton(), 0, None
        waiting: list[list[int]] = []
        for i in range(first, len(members)):
            # Kinds of one smallest document are no reference to each other.
            if i > first and owner[i] != owner[i - 1] and shard_end is None:
                for sequence in waiting:
                    automaton.add(sequence)
                    words += len(sequence)
                waiting = []
                if words > SHARD_WORDS:
                    shard_end = i
            if i > first:
                bits = 0
                for j, size in enumerate(automaton.matched(sequences[i])):
                    if size >= kind.window:
                        bits |= 1 << (lefts[i] - (j - kind.window + 1))
                found[members[i]] |= np.uint32(bits)
            if shard_end is None:
                waiting.append(sequences[i])
        first = len(members) if shard_end is None else shard_end


def _cut(data, offsets, starts, ends, first, gone) -> dict:
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    kept = np.flatnonzero(~gone)
    # Each kept word with the byte after it, which becomes a space; a row's last space is cut.
    size = ends[kept] - starts[kept]
    body = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    body[text.ranges(begin, size)] = data[text.ranges(starts[kept], size)]
    per_row = np.bincount(row[kept], weights=size + 1, minlength=n).astype(np.int64)
    stop = np.cumsum(per_row)
    some = np.flatnonzero(per_row)
    body = np.delete(body, stop[some] - 1)
    upto = np.concatenate(([0], np.cumsum(per_row - (per_row > 0)))).astype(np.int32)
    return {
        "n_words": pa.array(np.diff(first), pa.int64()),
        "n_removed": pa.array(np.bincount(row[gone], minlength=n), pa.int64()),
        "kept": pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(body.tobytes())]),
    }


def remove_repeated_passages(docs: DataFrame, words: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: documents without the words that lie in a sequence of a smaller document."""
    if not 1 <= anchor <= words <= anchor + 31:
        raise ValueError("an anchor is at least one word, and at most 31 words shorter than the sequence")
    kind = anchors.Kind(True, words, anchor, 6)
    return anchors.remove_repeats(docs, kind, judge, _cut, "doc_id long, n_words long, n_removed long, kept string")
