"""The quality classifier against a plain version of its n-grams, updates and scores."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from odflow.llm import quality, queries, text

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x20\x09-\x0d]+")


def code(token: bytes) -> int:
    data = np.frombuffer(token, dtype=np.uint8)
    return int(text.span_hashes(text.prefix_hashes(data), np.array([0]), np.array([len(data)]))[0])


def plain_grams(body: str | None) -> Counter:
    tokens = TOKEN.findall((body or "").encode())
    codes = [code(t) for t in tokens]
    out = Counter(c % quality.BUCKETS for c in codes)
    for a, b in zip(codes, codes[1:], strict=False):
        out[int(text.mix64(np.array([a], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b))[0]) % quality.BUCKETS] += 1
    for gap in (1, 2):
        out[gap] += sum(x == y and not re.match(rb"[^A-Za-z\x80-\xff]", x) for x, y in zip(tokens, tokens[gap:], strict=False))
    return +out


def vector(body):
    held = plain_grams(body)
    size = max(1, sum(held.values()))
    return {**{k: float(np.float32(n / math.sqrt(size))) for k, n in held.items()}, quality.BUCKETS: 1.0}


def plain_fit(rows):
    """Updates over rows of text and label, one by one."""
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for body, label in rows:
        x = vector(body)
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
            n[i] += g * g
    return {i: weight(i) for i in z}


BODIES = [None, "", " \t", "a a a a", "Ab,ab 12 12 12", "é é ß", "###***", "one two\nthree|four", "x" * 70_000, "long " * 20_000]


def test_grams():
    place, row = quality.grams(pa.array(BODIES, pa.string()))
    for k, body in enumerate(BODIES):
        assert Counter(place[row == k].tolist()) == plain_grams(body), body
    assert len(quality.grams(pa.array([], pa.string()))[0]) == 0


def made(seed: int, n: int):
    """Texts and labels: junk holds signs or repeats."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 6))) for _ in range(60)]
    out = []
    for _ in range(n):
        body, good = [draw.choice(words) for _ in range(draw.randint(5, 40))], draw.random() < 0.7
        out.append((" ".join(body) if good else draw.choice((" | ".join(body), " ".join([body[0]] * 20), " ".join(w + "$$$" for w in body))), int(good)))
    return out


def test_updates_and_scores(spark, docs_of):
    rows = made(1, 60)
    docs = docs_of([t for t, _ in rows])
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(rows)], "doc_id long, quality int")
    order = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(text) AS turn").orderBy("turn").collect()]
    want = plain_fit([rows[i] for i in order])
    got = quality.learn(docs, labels, shards=1, rounds=1)
    assert set(np.flatnonzero(got)) == {i for i, w in want.items() if w}
    assert max(abs(got[i] - w) for i, w in want.items()) < 1e-6
    found = {r.doc_id: r for r in quality.scored(docs_of(BODIES), got).collect()}
    assert len(found) == len(BODIES) and found[0].size == 1 and found[0].mark == "m"
    for i, body in enumerate(BODIES):
        dot = sum(got[k] * v for k, v in vector(body).items())
        assert math.isclose(found[i].score, 1 / (1 + math.exp(-dot)), rel_tol=1e-5, abs_tol=1e-12), body


def test_labels_of_an_id_are_averaged_and_repeated_ids_learn_once(spark, docs_of):
    docs = docs_of(["b a", "b a", "c", None], ids=[1, 1, 2, None])
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (2, None), (None, 1), (9, 1)], "doc_id long, quality int")
    once = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert np.array_equal(quality.learn(docs, labels), quality.learn(docs_of(["b a", "c"], ids=[1, 2]), once))


def test_nothing_to_learn_or_score(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    weights = quality.learn(docs_of(["a"]), labels)
    assert not weights.any()
    assert [r.score for r in quality.scored(docs_of(["a", None]), weights).collect()] == [0.5, 0.5]
    assert quality.scored(docs_of([]), weights).count() == 0


@pytest.fixture
def folder(spark, docs_of, tmp_path):
    rows = made(3, 400)
    docs_of([t for t, _ in rows] + ["", None], ids=[*range(401), None]).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, q, 0, "t", 0.1) for i, (_, q) in enumerate(rows) if i % 7], "doc_id long, quality int, toxic int, text string, score double")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_query_on_held_out_documents(spark, folder):
    path, rows = folder
    found = queries.op12_quality(spark, path).collect()
    assert len(found) == 402
    right = []
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id < 400:
            right.append(r.predicted == rows[r.doc_id][1])
    assert len(right) > 50 and sum(right) / len(right) > 0.95
    again = {(r.doc_id, r.score) for r in queries.op12_quality(spark, path).repartition(3).collect()}
    assert again == {(r.doc_id, r.score) for r in found}


def test_held_out_labels_are_not_read(spark, folder, tmp_path):
    path, _ = folder
    flipped = f"{tmp_path}/flipped"
    labels = spark.read.parquet(f"{path}/labels.parquet").selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) AS quality")
    labels.write.parquet(f"{flipped}/labels.parquet")
    spark.read.parquet(f"{path}/documents.parquet").selectExpr("doc_id", "text", "'x' AS lang", "doc_id % 3 AS source").write.parquet(f"{flipped}/documents.parquet")
    assert {(r.doc_id, r.score) for r in queries.op12_quality(spark, path).collect()} == {(r.doc_id, r.score) for r in queries.op12_quality(spark, flipped).collect()}
