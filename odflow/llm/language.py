"""Language identification by known words, backing off to shorter and shorter character n-grams.

A word (a run of letters, lower-cased) that the training words hold counts with its log frequency in each language. For another word,
the longest n-grams (with its ends marked) of which the training grams hold any stand in, by the mean of their log frequencies;
then the next shorter. Documents sum their words and the languages' log shares.

Training: counts over a sample of labelled documents, taken by hashed id and bounded by ``train_rows`` in expectation. The bound is
dealt to the languages evenly, and what a rare one leaves free goes to the others, so that rare languages are read whole. All words and
n-grams of the sample form the model, as one row of each language that has them; it is bounded by the sample alone and is broadcast.
What a language's sample lacks has one frequency in all languages, below that of everything seen, so that a small sample is no
advantage. Everything else reads whole texts of all documents.

Cases: a null text, or one without any letter, is ``und`` with score 0; a text of letters is always given a language,
unless nothing could be learned (then ``und``); a language without a word in its sample is never given; ties go to the language first in code point order; repeated rows are judged alike; an
empty table gives no rows; a null ``doc_id`` is not held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.llm import text

TRAIN_ROWS = 40_000
LONGEST_GRAM = 5
#: Text that is worked on together: letters, hashes and n-grams take some hundred bytes for each of its bytes.
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
_EDGE = np.uint64(1)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _letters[0]


def _letter_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts; start, end and row of each word."""
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) for t in low], dtype=np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        none = np.zeros(0, dtype=np.int64)
        return points, none, none, none
    inside = _is_letter()[points]
    edge = np.zeros(len(points) + 1, dtype=bool)
    upto = np.concatenate(([0], np.cumsum(size)))
    edge[upto] = True
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1
    return points, starts, ends, np.searchsorted(upto, starts, side="right") - 1


def _grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' n-grams, ends marked, and the word of each."""
    size = ends - starts + 2
    word = np.repeat(np.arange(len(starts)), size)
    padded = np.full(int(size.sum()), _EDGE, dtype=np.uint64)
    first = np.cumsum(size) - size
    padded[text.ranges(first + 1, size - 2)] = points[text.ranges(starts, size - 2)]
    count = np.maximum(size - n + 1, 0)
    at = text.ranges(first, count)
    code = np.full(len(at), np.uint64(n), dtype=np.uint64)
    for k in range(n):
        code = text.mix64(code * np.uint64(0x9E3779B97F4A7C15) + padded[at + k])
    return code, word[at]


def _counted(keys: np.ndarray, langs: np.ndarray, weights: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((langs, keys))
    keys, langs, weights = keys[order], langs[order], weights[order]
    new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (langs[1:] != langs[:-1])))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], langs[new], np.add.reduceat(weights, new) if len(new) else weights


def _dealt(counts: dict[str, int], rows: int) -> dict[str, float]:
    """Share of each language's documents to read, so that ``rows`` are read of all: even parts, and what one lacks goes to the others."""
    shares, left = {}, float(rows)
    for i, (name, n) in enumerate(sorted(counts.items(), key=lambda item: (item[1], item[0]))):
        part = min(float(n), left / (len(counts) - i))
        shares[name], left = part / n, left - part
    return shares


def learn(train: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Fit on ``text, lang`` of rows with both; ``doc_id`` only spreads the sample."""
    rows = train.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "levels": [], "share": np.zeros(0)}
    bounds = train.sparkSession.createDataFrame(
        [(name, int(share * (1 << 31))) for name, share in _dealt(counts, train_rows).items()], "_lang string, _bound long"
    )
    sample = (
        rows.withColumn("_at", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 31)))
        .join(F.broadcast(bounds), F.col("lang") == F.col("_lang")).where(F.col("_at") < F.col("_bound")).select("text", "lang")
    )
    number = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, "text", SLICE_BYTES):
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            points, starts, ends, row = _letter_words(batch.column("text").to_pylist())
            whole = text.span_hashes(text.prefix_hashes(points), starts, ends)
            key, at, inverse = np.unique(whole, return_index=True, return_inverse=True)
            held, langs_, times = _counted(inverse, lang[row], np.ones(len(row), dtype=np.int64), len(langs))
            levels = [(0, key[held], langs_, times)]
            for n in range(1, LONGEST_GRAM + 1):
                code, word = _grams(points, starts[at[held]], ends[at[held]], n)
                levels.append((n, *_counted(code, langs_[word], times[word], len(langs))))
            for level, k, l, t in levels:  # noqa: E741
                yield pa.RecordBatch.from_pydict({"level": pa.array(np.full(len(k), level), pa.int32()), "key": pa.array(k.view(np.int64)), "lang_no": pa.array(l, pa.int32()), "n": pa.array(t, pa.int64())})

    found = sample.mapInArrow(count, "level int, key long, lang_no int, n long").groupBy("level", "key", "lang_no").agg(F.sum("n").alias("n")).toArrow()
    level_no, key, lang_no, n = (found.column(c).to_numpy() for c in ("level", "key", "lang_no", "n"))
    levels = []
    for level in range(LONGEST_GRAM + 1):
        mine = np.flatnonzero(level_no == level)
        mine = mine[np.lexsort((lang_no[mine], key[mine].view(np.uint64)))]
        keys, first = np.unique(key[mine].view(np.uint64), return_index=True)
        total = np.bincount(lang_no[mine], weights=n[mine], minlength=len(langs))
        # How far the log frequency lies above that of what no sample holds: half an occurrence in the largest.
        above = np.log(n[mine] / total[lang_no[mine]]) - np.log(0.5 / max(1.0, total.max(initial=1.0)))
        levels.append((keys, np.append(first, len(mine)).astype(np.int64), lang_no[mine].astype(np.int32), above.astype(np.float32)))
    prior = np.array([counts[x] for x in langs], dtype=float)
    spoken = np.bincount(levels[0][2], minlength=len(langs)) > 0
    return {"langs": langs if spoken.any() else [], "levels": levels, "share": np.where(spoken, np.log(prior / prior.sum()), -np.inf)}


def _known(level: tuple[np.ndarray, ...], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the level holds, and their places."""
    if not len(level[0]):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(level[0], keys), len(level[0]) - 1)
    return level[0][at] == keys, at


def _summed(level: tuple[np.ndarray, ...], at: np.ndarray, row: np.ndarray, n_rows: int, n_langs: int) -> np.ndarray:
    """Per row and language, the sum over the entries at ``at`` of how far they lie above what is unseen."""
    size = level[1][at + 1] - level[1][at]
    held = text.ranges(level[1][at], size)
    place = np.repeat(row, size) * n_langs + level[2][held]
    return np.bincount(place, weights=level[3][held], minlength=n_rows * n_langs).reshape(n_rows, n_langs)


def _judge(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of every text, and whether it has a letter."""
    langs, n_rows = model["langs"], len(texts)
    points, starts, ends, row = _letter_words(texts)
    n_words = np.bincount(row, minlength=n_rows)
    if not langs or not len(starts):
        return [UNKNOWN] * n_rows, np.zeros(n_rows), n_words > 0
    whole = text.span_hashes(text.prefix_hashes(points), starts, ends)
    key, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    value = np.zeros((len(key), len(langs)), dtype=np.float64)
    known, at = _known(model["levels"][0], key)
    value[known] = _summed(model["levels"][0], at[known], np.arange(np.count_nonzero(known)), np.count_nonzero(known), len(langs))
    open_ = np.flatnonzero(~known)
    for n in range(LONGEST_GRAM, 0, -1):
        if not len(open_):
            break
        code, word = _grams(points, starts[first[open_]], ends[first[open_]], n)
        held, at = _known(model["levels"][n], code)
        word = word[held]
        times = np.bincount(word, minlength=len(open_))
        sums = _summed(model["levels"][n], at[held], word, len(open_), len(langs))
        value[open_] = sums / np.maximum(times, 1)[:, None]
        open_ = open_[times == 0]
    total = np.stack([np.bincount(row, weights=value[inverse, k], minlength=n_rows) for k in range(len(langs))], axis=1)
    total = total + model["share"]
    total -= total.max(axis=1, keepdims=True)
    # Words of a text depend on each other: the evidence counts with the root of their number.
    odds = np.exp(total / np.sqrt(np.maximum(n_words, 1))[:, None])
    odds /= odds.sum(axis=1, keepdims=True)
    best = total.argmax(axis=1)
    names = [langs[b] if w else UNKNOWN for b, w in zip(best, n_words, strict=True)]
    return names, np.where(n_words > 0, odds[np.arange(n_rows), best], 0.0), n_words > 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``has_letters``, from the text alone; every other column stays as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "has_letters")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, "text", SLICE_BYTES):
            lang, score, letters = _judge(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.bool_())], [*names, "lang_pred", "score", "has_letters"])

    shape = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("has_letters", T.BooleanType())])
    return docs.mapInArrow(run, shape)
