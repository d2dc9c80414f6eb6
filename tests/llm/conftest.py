from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row_key long, bucket string, score double, mark string"


def rows_of(texts, ids=None, langs=None, sources=None):
    """Document rows with extra columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return [
        (i, t, langs[k] if langs else "en", sources[k] if sources else "s", len(t) if t else 0, 1, 2, "b", 0.5, "m")
        for k, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]


@pytest.fixture
def docs_of(spark):
    def build(*args, **kwargs):
        return spark.createDataFrame(rows_of(*args, **kwargs), DOCS)

    return build


def copied_texts(seed: int, n: int = 40, vocabulary: int = 400) -> list[str | None]:
    """Texts with exact copies, near copies, shared passages, repeats within a text, and odd rows."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 8))) for _ in range(vocabulary)]
    passage = " ".join(draw.choice(words) for _ in range(25))
    out: list[str | None] = [None, "", " \t\n", "one", "one", "ab", passage, passage.upper()]
    while len(out) < n:
        kind = draw.random()
        text = " ".join(draw.choice(words) for _ in range(draw.randint(1, 60)))
        known = [t for t in out if t and len(t) > 30]
        if kind < 0.2:
            text = draw.choice(known)
        elif kind < 0.4:
            parts = draw.choice(known).split(" ")
            parts[draw.randrange(len(parts))] = "edit"
            text = " ".join(parts)
        elif kind < 0.6:
            text = f"{text} {passage} {text[::-1]}"
        elif kind < 0.7:
            text = f"{text}  {text}"
        out.append(text)
    return out
