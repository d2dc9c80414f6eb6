from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflow.llm import chat, mixing, topk
from odflow.llm.queries import TRICKY


def best_products(rows, k):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in whole:
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_top_k_is_exact(spark, monkeypatch, unit):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    draw = np.random.default_rng(7)
    v = draw.normal(size=(300, 8))
    v[50:90] = v[:40] + draw.normal(size=(40, 8)) * 0.05
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if not unit:
        v *= draw.lognormal(0, 1.5, (300, 1))
    v[100:110] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(300, None), (305, [None] * 8), (310, [float("nan")] * 8), (315, [math.inf] * 8), (320, [0.0] * 8), (325, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, x, 1.0, 2) for i, x in rows], "vec_id long, embedding array<double>, norm double, part int")
    got = topk.top_k(frame, F.col("vec_id") % 5 == 0, 5).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == best_products(rows, 5)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 5 == 0, 5).collect() == []


def test_pruned_search_keeps_ties():
    ids, rows = np.arange(6), np.array([[4, 0], [4, 0], [3, 1], [0, 4], [4, 0], [1, 1]])
    found = sorted(topk._search(np.array([9]), np.array([[2, 0]]), np.array([8.0]), ids, rows, 4.0, 2))
    assert found == [(9, 0, 8), (9, 1, 8)]


def test_shares_stop_at_three_rounds():
    got = mixing.shares([10, 1000, 10], [1, 2, 3])
    assert got[2] == 30 and got[0] == 30 and sum(got) == pytest.approx(1020)
    assert mixing.shares([0, 0], [1, 2]) == [0.0, 0.0]
    assert mixing.shares([], []) == []
    assert mixing.shares([600], [1]) == [600.0]


def test_permutation_is_one():
    for n in (1, 2, 7, 64, 1000):
        places = np.arange(n)
        got = mixing.permuted(places, np.full(n, n), np.full(n, 5, dtype=np.uint64))
        assert sorted(got.tolist()) == places.tolist()


def test_mix_meets_targets(docs_of):
    texts, sources = [], []
    for i in range(120):
        texts.append(" ".join(f"w{j}" for j in range(1 + i * 7 % 300)))
        sources.append("hot" if i % 3 else [None, "a", "b", "Z"][i % 4])
    texts += [None, "", texts[0], texts[0]]
    sources += ["a", "b", sources[0], sources[0]]
    ids = [*range(120), 120, 121, 0, 0]
    frame = docs_of(texts, ids=ids, sources=sources)
    documents, pieces = mixing.mix(frame, block_words=16)
    rows = mixing.taken(documents, pieces).collect()
    assert len(rows) == len(texts)
    assert sorted((r.doc_id, r["size"]) for r in rows) == sorted((i, len((t or "").split())) for i, t in zip(ids, texts, strict=True))
    assert all(r.taken <= 3 * r["size"] for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= max(48, 0.05 * target), (size, target, sum(taken))
    again = mixing.taken(*mixing.mix(frame.repartition(5), block_words=16)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_documents_hold_the_taken_words(docs_of):
    texts = [" ".join(f"d{i}w{j}" for j in range(10 + 30 * (i % 5))) for i in range(40)]
    frame = docs_of(texts, sources=["ab"[i % 2] for i in range(40)])
    out = mixing.mixed_documents(frame, block_words=8)
    assert out.columns == frame.columns
    rows = out.collect()
    counted: dict = {}
    for r in rows:
        assert set(r.text.split()) <= set(texts[r.doc_id].split()) and r.n_chars == len(r.text) and r.mark == "m"
        counted[r.doc_id] = counted.get(r.doc_id, 0) + len(r.text.split())
    taken = {r.doc_id: r.taken for r in mixing.taken(*mixing.mix(frame, block_words=8)).collect() if r.taken}
    assert counted == taken


def test_mix_of_nothing(docs_of):
    assert mixing.taken(*mixing.mix(docs_of([]))).collect() == []
    assert [r.taken for r in mixing.taken(*mixing.mix(docs_of([None, " "]))).collect()] == [0, 0]


TURNS = [
    (1, 0, "system", "be\nkind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes ### \\### </turn>\n"), (1, 3, "assistant", None), (1, 4, "user", "bye"),
    (2, 0, "user", "alone"), (3, None, None, None), (3, 0, "assis\ntant\\n", "x"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"),
    (None, 0, "assistant", "\\s\\h\\t\\\\"), (4, 0, "assistant", "éß" * 50_000), (-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY),
]


def test_chat_reads_back(spark):
    frame = spark.createDataFrame([(*t, 1, "x") for t in TURNS], "conv_id long, turn long, role string, text string, example int, before string")
    examples = chat.chat_examples(frame)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, x) for *_, r, x in own]
        assert [x for x in back[conv].replies if x] == [x for *_, r, x in own if r == "assistant" and x]
    rows = examples.where("conv_id = 1").orderBy("example").collect()
    assert [r.example for r in rows] == [3, 4, 5]
    assert rows[1].formatted.startswith(rows[0].formatted) and rows[2].loss_length == 0
    shown = rows[0].formatted[rows[0].loss_start : rows[0].loss_start + rows[0].loss_length]
    assert shown == "yes \\h \\s\\h \\t\n"
    assert chat.chat_examples(frame.limit(0)).collect() == []


def test_chat_is_native(spark):
    plan = chat.read_back(chat.chat_examples(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
