"""Jaccard components and the pipeline against plain versions."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from odflow.llm import jaccard, text
from odflow.session import write_table
from tests.llm.conftest import copied_texts


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(items):
    """Smallest id reachable by links, for each item."""
    sets = [shingles(t) for _, t in items]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(items):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(items)]


def near_copies(seed: int, n: int = 120):
    """Chains of near copies, so that links reach beyond single pairs, and a common line in a third of all texts."""
    draw = np.random.default_rng(seed)
    word = lambda: f"w{draw.integers(0, 4000)}"
    line = " ".join(word() for _ in range(12))
    out = []
    for _ in range(n // 6):
        base = [word() for _ in range(draw.integers(20, 120))]
        for _ in range(5):
            base = list(base)
            for _ in range(draw.integers(0, 3)):
                base[draw.integers(0, len(base))] = word()
            out.append(" ".join(base) + (f"\n{line}" if draw.random() < 0.4 else ""))
        out.append(line + " " + " ".join(word() for _ in range(30)))
    return out


@pytest.mark.parametrize("frequent", [32, 2])
def test_components(docs_of, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "PART_ROWS", 3)
    texts = [*copied_texts(11), *near_copies(1), None, "", "one two", "One  two", "a b c d e", "A b c d e f"]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs_of(texts)).collect())
    assert got == sorted(plain_components(list(enumerate(texts))))


def family(seed, n=90, length=100):
    """Near copies of one base, most at 0.6 to 0.8 of it, and small clusters of texts that link with each other but not with the base."""
    draw = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(length)]
    texts = [" ".join(base)]
    for k in range(n):
        words = list(base)
        for at in draw.choice(length, draw.integers(2, 6), replace=False):
            words[at] = f"e{seed}_{k}_{at}"
        texts.append(" ".join(words))
        if k % 9 == 0:
            words[int(draw.integers(0, length))] = f"f{k}"
            texts.append(" ".join(words))
    return texts


def test_family_below_the_threshold(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_ROWS", 16)
    texts = [*family(5), *family(6)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs_of(texts)).collect())
    assert got == sorted(plain_components(list(enumerate(texts))))
    assert len({c for _, _, c in got}) > 20


@pytest.mark.parametrize("loose", [None, 50])
def test_part_gives_a_spanning_forest(loose):
    """Members of two families ask their own part: as many links as ties them together, or all that are alike."""
    texts = [" ".join(f"{side}{i}" for i in range(60)) + f" {side}end{k}" for side in "ab" for k in range(12)]
    members = [(1, 0, 0, k, t) for k, t in enumerate(texts)]
    queries = [(1, 0, 1, k, t) for k, t in enumerate(texts)] + [(1, 0, 1, 99, texts[0])]
    names = ["grp", "part", "is_query", "row_key", "text"]
    rows = pa.table({n: [row[i] for row in members + queries] for i, n in enumerate(names)})
    links = jaccard._verify(80, loose)(rows).to_pylist()
    assert all(r["link"] for r in links)
    if loose is not None:
        assert len(links) == 2 * 12 * 11 + 12
        return
    assert len(links) == 2 * 11 + 1
    root = list(range(100))
    for r in links:
        old, new = root[r["a"]], root[r["b"]]
        root = [new if x == old else x for x in root]
    assert len({root[k] for k in [*range(12), 99]}) == 1 and len({root[k] for k in range(12, 24)}) == 1


def test_large_group_of_near_copies(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_ROWS", 16)
    draw = np.random.default_rng(3)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in draw.integers(0, 80, draw.integers(0, 5)):
            words[at] = f"e{draw.integers(0, 10**6)}"
        texts.append(" ".join(words))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs_of(texts)).collect())
    assert got == sorted(plain_components(list(enumerate(texts))))


def test_components_of_odd_ids(docs_of):
    text = "a b c d e f g h"
    rows = jaccard.components(docs_of([text, text, text, "other words are here now"], ids=[None, 4, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    assert jaccard.components(docs_of([])).collect() == []


def test_connected(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 4), (10, 11), (3, 12), (7, 7)] + [(20 + i, 21 + i) for i in range(40)]
    roots = {r.node: r.root for r in jaccard.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {1: 1, 2: 1, 3: 1, 12: 1, 4: 4, 5: 4, 9: 4, 10: 10, 11: 10, **{20 + i: 20 for i in range(41)}}


def test_queries_are_registered():
    names = [n for n in registered.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert registered.queries()["pipeline"] is corpus_pipeline.run
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_pipeline_stages(spark, docs_of):
    texts = [*copied_texts(21, 60), *near_copies(2, 60), "write to jo.smith@mail.example.com or call +1 (555) 555-0100 today please", "12345 --", None, "ok", "ok"]
    docs = docs_of(texts, sources=["hot" if i % 3 else f"s{i % 4}" for i in range(len(texts))])
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "n-gram Jaccard join", "PII", "mixing sources", "byte-level BPE"]
    steps = []
    for stage in stages.values():
        before = docs.columns
        docs = write_table(stage(spark, docs, "unused"))
        steps.append(docs)
        if stage is not corpus_pipeline.byte_pairs:
            assert docs.columns == before
    told = {r.doc_id for r in steps[0].collect()}
    assert told == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    kept = {r.doc_id for r in steps[1].collect()}
    assert kept == {c for _, _, c in plain_components([(i, t) for i, t in enumerate(texts) if i in told])}
    cleaned = {r.doc_id: r for r in steps[2].collect()}
    assert set(cleaned) == kept
    private = next(i for i, t in enumerate(texts) if t and "jo.smith" in t)
    assert cleaned[private].text == "write to [EMAIL] or call [PHONE] today please"
    assert all(cleaned[i].text == texts[i] and cleaned[i].mark == "m" for i in kept - {private})
    mixed: dict = {}
    for r in steps[3].collect():
        assert set(r.text.split()) <= set(cleaned[r.doc_id].text.split())
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 3 * len(cleaned[i].text.split()) for i, n in mixed.items())
    rows = docs.collect()
    assert len(rows) == steps[3].count() and all(r.exact and r.n_tokens == len(r.ids) for r in rows)


def test_unlabelled_documents_stay(spark, docs_of):
    stage = dict(corpus_pipeline.STAGES)["language ID"]
    texts = ["some words", None, "12 34", "ärger"]
    kept = stage(spark, docs_of(texts, langs=[None] * 4), "").collect()
    assert sorted((r.doc_id, r.lang, r.text) for r in kept) == [(0, None, "some words"), (3, None, "ärger")]
    kept = stage(spark, docs_of(texts, langs=["und", None, "und", None]), "").collect()
    assert sorted((r.doc_id, r.lang) for r in kept) == [(0, "und"), (3, "und")]


def test_pipeline_of_nothing(spark, docs_of):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, "unused"))
        assert docs.count() == 0


def test_stages_take_small_batches(spark):
    """Ten megabytes in one task reach Python in pieces of ``BATCH_BYTES``, through mapped rows and through a group."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(2_000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 700) AS text", "'x' AS lang").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    before = spark.conf.get(name)
    try:
        corpus_pipeline.personal_data(spark, docs.limit(2), "")
        mapped = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        grouped = docs.groupBy("lang").applyInArrow(lambda rows: pa.table({"n": [b.nbytes for b in rows.to_batches()]}), "n long")
        for found in (mapped, [r.n for r in grouped.collect()]):
            assert sum(found) > 10 << 20 and max(found) <= text.BATCH_BYTES + (64 << 10)
    finally:
        spark.conf.set(name, before)


def _held_mb() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_workers_give_memory_back():
    """Small blocks that outlive a piece pin the heap over what was freed below them."""
    batch = pa.RecordBatch.from_pydict({"text": ["word " * 700_000]})
    kept, before = [], _held_mb()
    for _ in text.slices([batch] * 4, "text"):
        passing = [np.ones(200) for _ in range(100_000)]
        kept.append(np.ones(200))
        del passing
    assert _held_mb() - before < 60


def test_arrow_batches_of_the_pipeline(spark):
    """Four megabytes in one task come in pieces of a quarter."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(2_000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 250) AS text", "'x' AS lang").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    before = spark.conf.get(name)
    try:
        corpus_pipeline.personal_data(spark, docs.limit(2), "")
        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 4 << 20 and max(found) <= corpus_pipeline.BATCH_BYTES + (64 << 10)
    finally:
        spark.conf.set(name, before)
