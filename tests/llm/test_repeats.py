"""Removal of repeated strings and word sequences against plain dictionaries."""

from __future__ import annotations

import re

import numpy as np
import pytest

from odflow.llm import anchors, automaton, suffix
from tests.llm.conftest import copied_texts


def plain(items, window):
    """Per document (in order of id): which items lie in a window that a smaller document holds."""
    seen, out = {}, []
    for doc_id, sequence in items:
        gone = np.zeros(len(sequence), dtype=bool)
        own = set()
        for i in range(len(sequence) - window + 1):
            key = tuple(sequence[i : i + window])
            if seen.get(key, doc_id) < doc_id:
                gone[i : i + window] = True
            own.add(key)
        for key in own:
            seen.setdefault(key, doc_id)
        out.append((doc_id, sequence, gone))
    return out


def spans(gone):
    return int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0


@pytest.mark.parametrize("seed", [1, 2])
def test_strings(docs_of, seed):
    texts = [*copied_texts(seed), "a" * 300, "a" * 120, "xy" * 100, "x" * 49, "x" * 50, "x" * 50, "long " * 30_000]
    got = {r.doc_id: r for r in suffix.remove_repeated_strings(docs_of(texts)).collect()}
    assert len(got) == len(texts)
    for doc_id, body, gone in plain([(i, (t or "").encode()) for i, t in enumerate(texts)], 50):
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        row = got[doc_id]
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == (len(body), int(gone.sum()), spans(gone), kept), doc_id


@pytest.mark.parametrize("seed", [3, 4])
def test_word_sequences(docs_of, seed):
    texts = [*copied_texts(seed), "w " * 100, "w " * 40, " ".join("abcdefghijklm"), "  ".join("abcdefghijklm"), "long " * 30_000]
    got = {r.doc_id: r for r in automaton.remove_repeated_passages(docs_of(texts)).collect()}
    assert len(got) == len(texts)
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)]
    for doc_id, words, gone in plain(split, 13):
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        row = got[doc_id]
        assert (row.n_words, row.n_removed, row.kept) == (len(words), int(gone.sum()), kept), doc_id


def test_equal_and_null_ids(docs_of):
    text = " ".join(f"w{i}" for i in range(20))
    frame = docs_of([text, text, text + " more", text], ids=[5, 5, 5, None])
    got = automaton.remove_repeated_passages(frame).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 0), (False, 0), (True, 20)]


def test_empty_table(docs_of):
    assert suffix.remove_repeated_strings(docs_of([])).collect() == []
    assert automaton.remove_repeated_passages(docs_of([None])).first().kept == ""


def test_small_shards_find_the_same(docs_of, monkeypatch):
    kind = anchors.Kind(True, 13, 5, 6)
    draw = np.random.default_rng(0)
    body, start, size, left = [], [], [], []
    base = draw.integers(1, 9, 21)
    for _ in range(30):
        row = base.copy()
        row[draw.integers(0, 21, 2)] = draw.integers(10, 90, 2)
        row[8:13] = base[8:13]
        start.append(len(body))
        body += row.tolist()
        size.append(21)
        left.append(8)
    held = anchors.Contexts(np.array(body, dtype=np.uint64), np.array(start), np.array(size), np.array(left), np.arange(30), np.arange(30) // 2)
    whole = automaton.judge(kind, held)
    monkeypatch.setattr(automaton, "SHARD_WORDS", 30)
    assert (automaton.judge(kind, held) == whole).all()
    assert whole.any()


def test_multikey_order_sorts():
    rows = np.random.default_rng(1).integers(0, 4, (5000, 6)).astype(np.uint64)
    got = rows[suffix.multikey_order(rows)]
    assert (got == rows[np.lexsort(tuple(rows[:, c] for c in range(5, -1, -1)))]).all()


def test_automaton_matches_longest_substrings():
    draw = np.random.default_rng(2)
    known = [draw.integers(0, 3, 12).tolist() for _ in range(5)]
    built = automaton.SuffixAutomaton()
    for k in known:
        built.add(k)
    asked = draw.integers(0, 3, 40).tolist()
    inside = lambda s: any(s == k[i : i + len(s)] for k in known for i in range(len(k)))
    best = [max(n for n in range(i + 2) if n == 0 or inside(asked[i + 1 - n : i + 1])) for i in range(40)]
    assert built.matched(asked) == best
