"""Spelling variants against plain counting and a comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from odflow.llm import queries, spelling


def edit_one(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    k = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def plain(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [x for x in n if edit_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def texts(seed: int, n: int) -> list[str | None]:
    draw = random.Random(seed)
    base = ["".join(draw.choice("abé") for _ in range(draw.randint(7, 11))) for _ in range(12)]
    out: list[str | None] = [None, "", "short words", "ÀÉÎÕÜßÿ×÷ " * 3, "x" * 5000, "X" * 5000, "x" * 4999, "aaaaaaaa aaaaaaa aaaaaaaaa " * 40]
    out += ["kkkkkkkk " * 250, "kkkkkkkm " * 22, "kkkkkkmm " * 2] * 2
    for _ in range(n):
        words = []
        for _ in range(draw.randint(1, 40)):
            w = draw.choice(base)
            for _ in range(draw.choice((0, 0, 0, 1, 1, 2))):
                k = draw.randrange(len(w))
                w = draw.choice((w[:k] + w[k + 1 :], w[:k] + draw.choice("abé") + w[k:], w[:k] + draw.choice("ABÉ") + w[k + 1 :]))
            words.append(w)
        out.append(draw.choice((" ", "-", "1")).join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(docs_of, seed):
    rows = [*enumerate(texts(seed, 120))]
    rows += [(3, rows[20][1]), (None, rows[21][1]), (None, rows[21][1])]
    want = plain(rows)
    assert any(form and root != form for _, form, root, *_ in want)
    frame = docs_of([t for _, t in rows], ids=[i for i, _ in rows])
    assert found(spelling.variants(frame)) == want


@pytest.mark.parametrize("most_shared", [0, 1, 3, 10**6])
def test_keys_are_opened_without_losing_or_repeating_a_pair(spark, most_shared):
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(1, 9))) for _ in range(300)} | {"é" * k for k in range(1, 40)})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [tuple(sorted((r.word, r.other))) for r in spelling.near_pairs(frame, most_shared).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a < b and edit_one(a, b) and len(a + b) > 2}


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(19)] + [("v", "w3")], "word string, form string")
    assert {r.root for r in spelling.roots(links).collect()} == {"w19"}
    assert spelling.roots(links.limit(0)).count() == 0


def test_no_documents(docs_of):
    assert spelling.variants(docs_of([])).count() == 0
    assert spelling.variants(docs_of([None, "short"])).count() == 0


def test_query(spark, tmp_path, docs_of):
    rows = [*enumerate(texts(7, 60))]
    docs_of([t for _, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(queries.op11_spelling(spark, str(tmp_path))) == plain(rows)
