"""Byte-level BPE by merge replay over the distinct words of a batch.

A batch's texts are cut by the splitting pattern; its distinct new words lie in one flat array of token ids, linked to
their neighbours. An inverted index from merge rank (of a token pair) to word positions is worked off in rank order: each
merge is applied at all its positions at once, and only pairs with the touched neighbours are looked up again. Tasks need
no shuffle; the vocabulary (its file's size, fixed) is broadcast.

Cases: null and empty texts have no tokens; any text decodes to its UTF-8 bytes; repeated rows are encoded alike; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm import text

#: Distinct words that a worker remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 200_000
_NONE = np.int64(1 << 40)
_SHIFT = np.int64(17)
_loaded: dict[int, Vocabulary] = {}


class Vocabulary:
    """Ranks of byte strings, and the pairs that merge into each."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        if max(self.ranks.values()) >= 1 << 17:
            raise ValueError("ranks of 2**17 and above are not supported")
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 17 | right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.body = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], _NONE)

    def encode_words(self, found: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (not empty). A word that is itself in the vocabulary is one token."""
        out: list = [None] * len(found)
        rest = []
        for i, word in enumerate(found):
            rank = self.ranks.get(word)
            if rank is None:
                rest.append(i)
            else:
                out[i] = np.array([rank], dtype=np.int32)
        if rest:
            size = np.array([len(found[i]) for i in rest], dtype=np.int64)
            ids, counts, odd = self._replay(np.frombuffer(b"".join(found[i] for i in rest), dtype=np.uint8), size)
            for i, part in zip(rest, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[i] = part
            for k in odd:
                out[rest[k]] = self._one_by_one(found[rest[k]])
        return out

    def _one_by_one(self, word: bytes) -> np.ndarray:
        """The lowest pair first, the leftmost of equals, one merge at a time."""
        ids = self.single[np.frombuffer(word, dtype=np.uint8)]
        while len(ids) > 1:
            ranks = self.rank_of(ids[:-1], ids[1:])
            at = int(np.argmin(ranks))
            if ranks[at] == _NONE:
                break
            ids = np.concatenate((ids[:at], [ranks[at]], ids[at + 2 :]))
        return ids.astype(np.int32)

    def _replay(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, their counts, and the words whose merges at one rank would have to alternate with lower ones."""
        n = len(data)
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(size)), size)
        token = np.concatenate((self.single[data], [-1]))
        following = np.arange(1, n + 2)
        previous = np.arange(-1, n)
        following[ends - 1] = n
        previous[ends - size] = n
        following[n], previous = n, np.concatenate((previous, [n]))[: n + 1]
        rank = np.concatenate((self.rank_of(token[:n], token[following[:n]]), [_NONE]))
        alive = np.ones(n + 1, dtype=bool)
        odd: set[int] = set()
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = rank[places]
            some = ranks < _NONE
            places, ranks = places[some], ranks[some]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begin = 0
            for end in [*cuts.tolist(), len(places)]:
                r = int(ranks[begin])
                if r in index:
                    index[r].append(places[begin:end])
                else:
                    index[r] = [places[begin:end]]
                    heapq.heappush(heap, r)
                begin = end

        enter(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            left = held[0] if len(held) == 1 else np.concatenate(held)
            left = left[alive[left] & (rank[left] == r)]
            if not len(left):
                continue
            if len(held) > 1:
                left = np.unique(left)
            if len(left) > 1:
                # Overlapping pairs (of one token with itself): every second one, from the left.
                chained = np.concatenate(([False], following[left[:-1]] == left[1:]))
                if chained.any():
                    at = np.arange(len(left))
                    begun = np.maximum.accumulate(np.where(chained, 0, at))
                    left = left[(at - begun) % 2 == 0]
            right = following[left]
            after = following[right]
            token[left] = r
            alive[right] = False
            rank[right] = _NONE
            following[left] = after
            previous[after] = left
            previous[n] = n
            touched = np.concatenate((left, previous[left]))
            touched = touched[touched < n]
            if len(left) > 1:
                touched = np.unique(touched)
            new = self.rank_of(token[touched], token[following[touched]])
            rank[touched] = new
            lower = touched[new < r]
            if len(lower):
                words_here, times = np.unique(word[left], return_counts=True)
                odd.update(set(words_here[times > 1].tolist()) & set(word[lower].tolist()))
            enter(touched)
        kept = np.flatnonzero(alive[:n])
        return token[kept].astype(np.int32), np.bincount(word[kept], minlength=len(size)), np.array(sorted(odd), dtype=np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        return self.body[text.ranges(self.start[ids], self.length[ids])]


def load(file: bytes) -> Vocabulary:
    key = hash(file)
    if key not in _loaded:
        _loaded[key] = Vocabulary(file)
    return _loaded[key]


class Encoder:
    """Texts to ids, remembering words between batches."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.count = np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if len(self.place) > REMEMBERED_WORDS:
            self._forget()
        cut = [self.find(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.place))
        if new:
            coded = self.vocabulary.encode_words([w.encode() for w in new])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.ids = np.concatenate((self.ids, *coded))
            self.count = np.concatenate((self.count, np.array([len(c) for c in coded], dtype=np.int64)))
        start = np.cumsum(self.count) - self.count
        look, pieces = self.place.__getitem__, np.array([len(c) for c in cut], dtype=np.int64)
        at = np.fromiter((look(w) for c in cut for w in c), dtype=np.int64, count=int(pieces.sum()))
        ids = self.ids[text.ranges(start[at], self.count[at])]
        upto = np.concatenate(([0], np.cumsum(self.count[at])))
        last = np.cumsum(pieces)
        return ids, upto[last] - upto[last - pieces]


def encode(docs: DataFrame, file: bytes, pattern: str, decoded: bool = False, keep_text: bool = False) -> DataFrame:
    """``doc_id, ids array<int>``; with ``decoded`` also ``decoded binary``, the bytes that the ids stand for; ``text`` if kept."""
    shared = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(load(shared.value), pattern)
        for batch in text.slices(batches, "text"):
            ids, counts = coder.encode(batch.column("text").to_pylist())
            offsets = np.concatenate(([0], np.cumsum(counts)))
            columns = {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))}
            if decoded:
                body = coder.vocabulary.decode(ids)
                upto = np.concatenate(([0], np.cumsum(coder.vocabulary.length[ids])))[offsets]
                columns["decoded"] = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
            if keep_text:
                columns["text"] = batch.column("text")
            yield pa.RecordBatch.from_pydict(columns)
        del coder
        text.give_back()

    shape = "doc_id long, ids array<int>" + ", decoded binary" * decoded + ", text string" * keep_text
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)
