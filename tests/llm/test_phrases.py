"""Collocations against plain counting, by looked-up and by shuffled groups, and against the SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from odflow.llm import phrases, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, best=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        held = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3, 4):
                held.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, held in f.items():
        candidates = {p: a for p, a in held.items() if len(p) > 1 and a >= 30}
        dropped = set()
        for long, a in candidates.items():
            for size in range(2, len(long)):
                for i in range(len(long) - size + 1):
                    if 100 * a >= 80 * held[long[i : i + size]]:
                        dropped.add(long[i : i + size])
        rated = []
        for p, a in candidates.items():
            score, _, left, right = min((2_000_000 * a // (held[p[:k]] + held[p[k:]]), k, held[p[:k]], held[p[k:]]) for k in range(1, len(p)))
            if p not in dropped:
                rated.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rated)[:best], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def found(frame):
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect()}


def texts(seed: int, n: int):
    draw = random.Random(seed)
    common = [" ".join(draw.choice("Éabcd") * draw.randint(1, 2) for _ in range(draw.randint(2, 6))) for _ in range(9)]
    rows = [(None, "A a a a a " * 40), ("und", "a A\ta  a"), ("fr", None), ("fr", ""), ("xx", ".,;\n"), ("en", "solo " * 29), ("en", "x\x0bx\x0cx\x85x " * 9000)]
    for _ in range(n):
        parts = [draw.choice(common) if draw.random() < 0.7 else draw.choice("abcdÉ") for _ in range(draw.randint(1, 12))]
        rows.append((draw.choice(("en", "en", "fr", None)), draw.choice((" ", "  ", ", ", "\n", "\t")).join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "most_shipped"), [(1, 10**6), (1, 0), (2, 12)])
def test_collocations(docs_of, seed, most_shipped):
    rows = texts(seed, 300)
    rows += rows[20:40]
    frame = docs_of([t for _, t in rows], langs=[x for x, _ in rows]).repartition(5)
    want = plain(rows)
    assert {len(p.split(" ")) for _, _, p, *_ in want} >= {2, 4}
    assert found(phrases.collocations(frame, most_shipped=most_shipped)) == want


def test_best_of_each_language(docs_of):
    rows = texts(3, 200)
    assert found(phrases.collocations(docs_of([t for _, t in rows], langs=[x for x, _ in rows]), best=2)) == plain(rows, 2)


def test_products_beyond_64_bits(spark):
    level = spark.createDataFrame([(9 * 10**18, [9 * 10**18, 9 * 10**18], [9 * 10**18, 9 * 10**18])], "n long, heads array<long>, tails array<long>")
    assert level.select(phrases._cut(2).alias("c")).first().c.score == 1_000_000


@pytest.mark.parametrize("bodies", [[], [None], ["", " . "], ["a b"]])
def test_nothing_frequent(docs_of, bodies):
    assert phrases.collocations(docs_of(bodies)).count() == 0


def test_query_and_sql(spark, docs_of, tmp_path):
    rows = texts(4, 250)
    docs_of([t for _, t in rows], langs=[x for x, _ in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(rows)
    assert found(queries.op13_phrases(spark, str(tmp_path))) == want
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert set(duckdb.sql("SELECT lang, rank, phrase, a, l, r, n, score FROM (" + queries.SQL["op13_phrases"] + ")").fetchall()) == want
