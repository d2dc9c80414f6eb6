"""Document fingerprints by a randomised edit embedding.

A walk reads the characters of a text with a pointer that moves on, or stays, by shared random bits that hang on the step and the
character under it; two texts that differ by edits fall back into step soon after each edit. What stands under the pointer at
sampled steps makes the fingerprint, so that edit distance turns into the share of differing samples (Hamming distance).

A sample is a byte hashed from the four characters under the pointer. Steps are sampled at fixed shares of a range that doubles with
the text's length class; a fingerprint holds its own class and the next one, so texts of neighbouring classes compare
too. Two walks give half of the samples each.

Cases: a null text is empty; equal texts have equal fingerprints; two empty texts are alike (1), an empty and another text
are not (0); texts whose length classes differ by two or more have likeness 0; repeated rows are documents of their own; the edited
text of a single document uses itself as next; documents of a null id come last. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm import tables, text
from odflow.session import materialise

SAMPLES = 64
WALKS = 2
_PERIOD = 1 << 14
_CLASSES = 256
_SEED = 20
#: Samples per band: this many must agree for two documents to meet.
BAND = 4
_tables: list[np.ndarray] = []


def _waits() -> np.ndarray:
    """For each walk, class of character and step (modulo the period): how many steps the pointer stays."""
    if not _tables:
        bits = np.random.default_rng(_SEED).integers(0, 2, (WALKS * _CLASSES, _PERIOD), dtype=np.uint8)
        bits[:, -1] = 1
        step = np.arange(_PERIOD)
        moves = np.where(bits == 1, step, _PERIOD)
        nxt = np.minimum.accumulate(moves[:, ::-1], axis=1)[:, ::-1]
        _tables.append((nxt - step + 1).astype(np.int32).ravel())
    return _tables[0]


def _places() -> np.ndarray:
    """Sampled steps as shares of the range."""
    return np.sort(np.random.default_rng(_SEED + 1).random((WALKS, SAMPLES // WALKS)), axis=1)


def _walk(kinds: np.ndarray, start: np.ndarray, size: np.ndarray, begin: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
    """Arrival steps of every character: ``out[walk, at + i]``. ``begin`` holds the first steps, one row per walk."""
    waits, mask = _waits(), np.int32(_PERIOD - 1)
    order = np.argsort(-size, kind="stable")
    start, at, size, step = start[order], at[order], size[order], begin[:, order].astype(np.int32)
    if not len(size) or not size[0]:
        return
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    offset = (np.arange(WALKS, dtype=np.int32) * (_CLASSES * _PERIOD))[:, None]
    for i in range(int(size[0])):
        n = active[i]
        step = step[:, :n]
        out[:, at[:n] + i] = step
        step = step + waits[(kinds[start[:n] + i] + offset) + (step & mask)]


def _kinds(points: np.ndarray) -> np.ndarray:
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int32) * np.int32(_PERIOD)


def _prints(points: np.ndarray, start: np.ndarray, size: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Fingerprint bytes: length class, then the samples of that class and of the next."""
    shares = _places()
    half = SAMPLES // WALKS
    out = np.zeros((len(size), 1 + 2 * SAMPLES), dtype=np.uint8)
    kind = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    out[:, 0] = kind + 1
    out[size == 0, 0] = 0
    where = np.full((len(size), 2 * SAMPLES), -1, dtype=np.int64)
    for row in range(len(size)):
        n = size[row]
        if not n:
            continue
        own = steps[:, start[row] : start[row] + n]
        end = 2 * n
        for up in range(2):
            reach = shares * float(2 << (int(kind[row]) + up))
            for w in range(WALKS):
                i = np.searchsorted(own[w], reach[w], side="right") - 1
                i[reach[w] >= end] = -1
                where[row, up * SAMPLES + w * half : up * SAMPLES + (w + 1) * half] = i
    inside = where >= 0
    code = np.zeros(where.shape, dtype=np.uint64)
    for k in range(4):
        i = where + k
        fine = inside & (i < size[:, None])
        code = text.mix64(code * np.uint64(31) + np.where(fine, points[np.where(fine, i + start[:, None], 0)] if len(points) else 0, 0).astype(np.uint64) + np.uint64(k))
    out[:, 1:] = np.where(inside, (code & np.uint64(0xFF)).astype(np.uint8) | np.uint8(1), 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing samples of fingerprints in equal rows, among those that either text reaches."""
    own, up = slice(1, 1 + SAMPLES), slice(1 + SAMPLES, 1 + 2 * SAMPLES)
    gap = a[:, 0].astype(int) - b[:, 0].astype(int)
    left = np.where((gap < 0)[:, None], a[:, up], a[:, own])
    right = np.where((gap > 0)[:, None], b[:, up], b[:, own])
    held = (left > 0) | (right > 0)
    same = (left == right) & held
    share = same.sum(axis=1) / np.maximum(held.sum(axis=1), 1)
    share[np.abs(gap) > 1] = 0.0
    share[(a[:, 0] == 0) != (b[:, 0] == 0)] = 0.0
    share[(a == b).all(axis=1)] = 1.0
    return share


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t or "") for t in texts], dtype=np.int64)
    return np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), size


def _hex(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, "text"):
            points, size = _points(batch.column("text").to_pylist())
            start = np.cumsum(size) - size
            steps = np.zeros((WALKS, len(points)), dtype=np.int32)
            _walk(_kinds(points), start, size, np.zeros((WALKS, len(size))), steps, start)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_chars": pa.array(size), "fingerprint": _hex(_prints(points, start, size, steps))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def bands(prints: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, band``: one row per band key of a fingerprint, over samples of its own class and the next.

    A band beyond the text's end holds no sample and says nothing, so it gives no key.
    """
    starts = [1 + k * BAND for k in range(2 * SAMPLES // BAND)]
    length_class = F.conv(F.substring("fingerprint", 1, 2), 16, 10).cast("int")
    samples = [F.substring("fingerprint", 1 + 2 * s, 2 * BAND) for s in starts]
    keys = [
        F.when(held != "00" * BAND, F.xxhash64(F.lit(k % (SAMPLES // BAND)), length_class + (1 if k >= SAMPLES // BAND else 0), held))
        for k, held in enumerate(samples)
    ]
    return prints.select("doc_id", "fingerprint", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("band"))


def near_links(prints: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id, near_id, likeness``: verified links of documents that share a band, each from the larger id to the smaller.

    Equal fingerprints count once (``near_id`` the smallest id of their class, likeness 1). A round takes heads of every band, one of
    each hashed part of its members, and compares the band's other members with them. Heads then leave the band, and so do members that
    are like one; those that failed against all heads meet the next round's, of which there are four times as many, until no band
    holds two. A band of copies ends after one round; only members unlike all others of their band are compared with many.
    """
    classes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    found = [
        prints.join(classes, "fingerprint").where("doc_id <> first_id").select("doc_id", F.col("first_id").alias("near_id"), F.lit(1.0).alias("likeness"))
    ]
    left, heads_a_band = bands(classes.select(F.col("first_id").alias("doc_id"), "fingerprint")), 1
    while True:
        shared = left.groupBy("band").agg(F.count("*").alias("_n")).where("_n > 1")
        left = materialise(left.join(shared, "band", "left_semi"))
        if left.isEmpty():
            break
        part = F.pmod(F.xxhash64("doc_id", "band", F.lit(heads_a_band)), F.lit(heads_a_band))
        heads = left.groupBy("band", part.alias("_part")).agg(F.min(F.struct("doc_id", "fingerprint")).alias("head"))
        heads = materialise(heads.select("band", F.col("head.doc_id").alias("head_id"), F.col("head.fingerprint").alias("head_print")))
        met = left.join(heads, "band").where("doc_id <> head_id").withColumn("likeness", _likeness_of("fingerprint", "head_print"))
        met = materialise(met.where(F.col("likeness") >= least).select("band", "doc_id", "head_id", "likeness"))
        found.append(met.select(F.greatest("doc_id", "head_id").alias("doc_id"), F.least("doc_id", "head_id").alias("near_id"), "likeness"))
        gone = met.select("band", "doc_id").unionByName(heads.select("band", F.col("head_id").alias("doc_id"))).distinct()
        left, heads_a_band = left.join(gone, ["band", "doc_id"], "left_anti"), 4 * heads_a_band
    return reduce(DataFrame.unionByName, found).distinct()


def _likeness_of(left: str, right: str) -> Column:
    @F.pandas_udf("double")
    def compared(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = lambda s: np.frombuffer(bytes.fromhex("".join(s)), dtype=np.uint8).reshape(len(s), -1)
        return pd.Series(likeness(rows(a), rows(b)) if len(a) else [], dtype=float)

    return compared(F.col(left), F.col(right))


def _followed(docs: DataFrame) -> DataFrame:
    """Documents dealt to buckets of falling ids, each with the first document of the bucket below added at its end."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = 2 * tables.width(spark)
    cuts = own.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts), reverse=True)
    # Bucket 0 holds the largest ids; a null id is below all.
    above = F.aggregate(F.array(*[F.lit(c).cast("long") for c in cuts]), F.lit(0), lambda s, c: s + F.when(F.col("doc_id") >= c, 0).otherwise(1)) if cuts else F.lit(0)
    dealt = own.withColumn("bucket", above)
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()  # a row per bucket
    after = {r.head: heads[i - 1].bucket for i, r in enumerate(heads)}  # the first bucket follows the last
    to = F.lit(None).cast("int")
    for head, bucket in after.items():
        to = F.when(F.col("doc_id").eqNullSafe(F.lit(head).cast("long")), F.lit(bucket)).otherwise(to) if len(after) <= 8 else to
    if len(after) > 8:
        known = [h for h in after if h is not None]
        to = F.element_at(F.create_map(*[x for h in known for x in (F.lit(h).cast("long"), F.lit(after[h]))]), F.col("doc_id"))
        if None in after:
            to = F.when(F.col("doc_id").isNull(), F.lit(after[None])).otherwise(to)
    copies = F.array_compact(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra")), F.when(to.isNotNull(), F.struct(to.alias("bucket"), F.lit(1).alias("extra")))))
    spread = dealt.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.bucket", "c.extra")
    placed = spread.repartition(tables.width(spark), "bucket")
    return placed.sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Every document with its text's edited form and the next document, by falling id, and how near its fingerprint is to theirs.

    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in text.slices(batches, "text"):
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            held = pa.Table.from_batches([whole.slice(whole.num_rows - 1)]).combine_chunks().to_batches()[0]
            done = _edited(whole)
            if done is not None:
                yield done
        # The last row of a partition is the added one of its last bucket.

    shape = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _followed(docs).mapInArrow(run, shape)


def _edited(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    """All rows but the last, and but those that were added only to be followed by."""
    if rows.num_rows < 2:
        return None
    texts = [t or "" for t in rows.column("text").to_pylist()]
    points, size = _points(texts)
    start = np.cumsum(size) - size
    steps = np.zeros((WALKS, len(points)), dtype=np.int32)
    kinds = _kinds(points)
    _walk(kinds, start, size, np.zeros((WALKS, len(size))), steps, start)
    prints = _prints(points, start, size, steps)

    here = np.flatnonzero(pc.equal(rows.column("extra"), 0).to_numpy(zero_copy_only=False)[:-1])
    if not len(here):
        return None
    cut = size[here] // 3
    keep, take = size[here] - cut, np.minimum(cut, size[here + 1])
    edited = [texts[i][: int(k)] + texts[i + 1][: int(c)] for i, k, c in zip(here.tolist(), keep, take, strict=True)]
    new_size = keep + take
    new_start = np.cumsum(new_size) - new_size
    new_points = np.zeros(int(new_size.sum()), dtype=np.uint32)
    new_steps = np.zeros((WALKS, len(new_points)), dtype=np.int32)
    old, new = text.ranges(start[here], keep), text.ranges(new_start, keep)
    new_points[new], new_steps[:, new] = points[old], steps[:, old]
    new_points[text.ranges(new_start + keep, take)] = points[text.ranges(start[here + 1], take)]
    # The walk goes on from the last character that stays.
    begin = np.zeros((WALKS, len(here)), dtype=np.int32)
    some = keep > 0
    last = (start[here] + keep - 1)[some]
    arrived = steps[:, last]
    offset = (np.arange(WALKS, dtype=np.int32) * (_CLASSES * _PERIOD))[:, None]
    begin[:, some] = arrived + _waits()[kinds[last] + offset + (arrived & np.int32(_PERIOD - 1))]
    _walk(kinds, start[here + 1], take, begin, new_steps, new_start + keep)
    new_prints = _prints(new_points, new_start, new_size, new_steps)
    return pa.RecordBatch.from_pydict({
        "doc_id": rows.column("doc_id").take(pa.array(here)),
        "n_chars": pa.array(size[here], pa.int64()),
        "edited": pa.array(edited, pa.string()),
        "fingerprint": _hex(prints[here]),
        "edited_fingerprint": _hex(new_prints),
        "near_edited": likeness(prints[here], new_prints),
        "near_next": likeness(prints[here], prints[here + 1]),
    })
