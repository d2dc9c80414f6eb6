"""Quality of documents: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A word is a run of letters, of digits, or of other signs between blanks; single words, pairs of neighbours, and pairs of a
word with itself (next to each other, or with one between) as one n-gram whatever the word is, are hashed into ``BUCKETS`` places. A document's value at a place is the number of its n-grams there over the root of their number; one place more, the
bias, is always 1. The score is the logistic of the sparse dot product with the weights.

Training: labelled documents, at most ``train_rows`` in expectation, taken by hashed id, are dealt to ``shards`` tasks. Every task runs the updates over
its documents from the common state; the changes of the state are averaged, and the next round starts from there. State and model have
``BUCKETS + 1`` places, whatever the size of the input.

Cases: a null or empty text has the bias alone; several labels of an id count by their mean, ties as 1; of repeated ids one text is learned from;
without labels every score is 0.5; repeated rows score alike; an empty table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.llm import text
from odflow.session import write_table

BUCKETS = 1 << 18
TRAIN_ROWS = 20_000
SHARDS = 8
ROUNDS = 4
#: Learning rate and smoothing of the updates, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
THRESHOLD = 0.3
SLICE_BYTES = 2 << 20
#: Changes of the state are summed in steps of this fraction.
STEPS = float(1 << 32)

_BLANK, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, dtype=np.int8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of every n-gram of the texts; rows ascend."""
    data, offsets = text.flat(column)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    full = kind[cuts[:-1]] != _BLANK
    starts, ends = cuts[:-1][full], cuts[1:][full]
    row = np.searchsorted(offsets, starts, side="right") - 1
    one = text.span_hashes(text.prefix_hashes(data), starts, ends)
    two = text.mix64(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
    paired = row[:-1] == row[1:]
    codes, rows = [one, two[paired]], [row, row[:-1][paired]]
    for gap in (1, 2):
        again = (one[:-gap] == one[gap:]) & (row[:-gap] == row[gap:]) & (kind[starts[gap:]] == _LETTER)
        codes.append(np.full(int(again.sum()), gap, dtype=np.uint64))
        rows.append(row[gap:][again])
    place = (np.concatenate(codes) % np.uint64(BUCKETS)).astype(np.int64)
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return place[order], rows[order]


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _trained(z: np.ndarray, n: np.ndarray, batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Updates over the documents of a shard; the places they touch and what they change there."""
    z, n = z.copy(), n.copy()
    z0, n0 = z.copy(), n.copy()
    for label, places, values in zip(batch["label"].to_pylist(), batch["places"], batch["amounts"], strict=True):
        at = np.frombuffer(places.as_buffer(), dtype=np.int32)
        x = np.frombuffer(values.as_buffer(), dtype=np.float32).astype(np.float64)
        w = _weights(z[at], n[at])
        slope = (_logistic(w @ x) - label) * x
        step = (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / ALPHA
        z[at] += slope - step * w
        n[at] += slope * slope
    touched = np.flatnonzero(n != n0)
    return touched, (z - z0)[touched], (n - n0)[touched]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vectors of the sample: places and amounts as bytes of int32 and float32."""
    for batch in text.slices(batches, "text", SLICE_BYTES):
        place, row = grams(batch.column("text"))
        key, times = np.unique(row * BUCKETS + place, return_counts=True)
        first = np.searchsorted(key, np.arange(batch.num_rows + 1) * BUCKETS)
        places, amounts = [], []
        for k in range(batch.num_rows):
            held = slice(first[k], first[k + 1])
            size = max(1, times[held].sum())
            places.append(np.append(key[held] - k * BUCKETS, BUCKETS).astype(np.int32).tobytes())
            amounts.append(np.append(times[held] / np.sqrt(size), 1.0).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": batch.column("shard"), "turn": batch.column("turn"), "label": batch.column("label"), "places": pa.array(places, pa.binary()), "amounts": pa.array(amounts, pa.binary())})


def _round(state: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """What a shard's documents change in the state, in whole steps, so that sums do not hang on their order."""

    def run(group: pa.Table) -> pa.Table:
        at, dz, dn = _trained(*state.value, group.sort_by("turn"))
        whole = lambda x: pa.array(np.rint(x * STEPS).astype(np.int64))
        return pa.table({"place": pa.array(at, pa.int64()), "dz": whole(dz), "dn": whole(dn)})

    return run


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, shards: int = SHARDS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights fitted on ``doc_id, text`` of ``docs`` with ``doc_id, quality`` of ``labels``; the last one is the bias."""
    context = docs.sparkSession.sparkContext
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    share = min(1.0, train_rows / max(1, known.count()))
    taken = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 31)) < int(share * (1 << 31)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most ``train_rows`` ids of two numbers each, in expectation.
    rows = own.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("turn"), "text")).alias("_first"))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "_first.turn", "label", "_first.text")
    sample = write_table(dealt.mapInArrow(_packed, "shard int, turn long, label double, places binary, amounts binary"))
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        moved = sample.groupBy("shard").applyInArrow(_round(context.broadcast((z, n))), "place long, dz long, dn long")
        changes = moved.groupBy("place").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toArrow()
        at = changes["place"].to_numpy()
        z[at] += changes["dz"].to_numpy() / (STEPS * shards)
        n[at] += changes["dn"].to_numpy() / (STEPS * shards)
    return _weights(z, n)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score``, from the text alone; every other column stays as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, "text", SLICE_BYTES):
            place, row = grams(batch.column("text"))
            sums = np.bincount(row, weights=shared.value[place], minlength=batch.num_rows)
            size = np.maximum(np.bincount(row, minlength=batch.num_rows), 1)
            score = _logistic(sums / np.sqrt(size) + shared.value[BUCKETS])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
