"""Mixing sources to target weights, by blocks.

The words of a source form one stream, cut into blocks of fixed length. An output shard draws the number of its slots per
source from a multinomial; the n-th slot of a source takes the block at place n of a pseudorandom permutation of that source's
block numbers (again from the start after the last), and slots and blocks join by block number.

Multinomial totals scatter around the targets and might pass three rounds over a source. So a source's draws beyond
its quota are handed, in order, to the sources that fell short: totals equal the quotas, which are the targets in blocks.

Cases: a null text has no words and is taken 0 times; a null source is a source of its own and last in order; repeated rows
are documents of their own; an empty table, or one without words, gives targets of 0. Clashing extra columns are ignored.
Bound: one row per source reaches the driver, and the shards' draws hold one number per source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.llm import tables, text

BLOCK_WORDS = 64
SHARD_SLOTS = 1024
MOST_ROUNDS = 3
WEIGHTS = (1, 2, 3)
#: Rows that agree in these are alike.
KEY = ("doc_id", "source", "mark")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, mark, size`` of every document; ``mark`` is a hash of its text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, "text"):
            _, _, first = text.words(*text.flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], pa.array(np.diff(first), pa.int64())], [*KEY, "size"])

    return _keyed(docs).select(*KEY, "text").mapInArrow(count, "doc_id long, source string, mark long, size long")


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "text": F.col("text").cast("string")})
    return docs.withColumn("mark", F.xxhash64("text"))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Join on columns that may be null."""
    named = right.select(*[F.col(c).alias(f"_{c}") if c in columns else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return left.join(named, on, how).drop(*[f"_{c}" for c in columns])


def shares(sizes: Sequence[int], weights: Sequence[int], most: int = MOST_ROUNDS) -> list[float]:
    """Targets: all words shared by weight, none above ``most`` times its source; the excess is shared again by weight."""
    total = float(sum(sizes))
    target, stopped, left = [0.0] * len(sizes), [False] * len(sizes), total
    while left > 0 and not all(stopped):
        unit = left / sum(w for w, s in zip(weights, stopped, strict=True) if not s)
        over = [i for i, s in enumerate(stopped) if not s and weights[i] * unit >= most * sizes[i]]
        if not over:
            return [t if s else w * unit for t, s, w in zip(target, stopped, weights, strict=True)]
        for i in over:
            target[i], stopped[i] = float(most * sizes[i]), True
            left -= target[i]
    return target


def permuted(place: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place in a pseudorandom permutation of 0 … count - 1: four Feistel rounds, walked on until inside."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(count, 2)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)

    def once(x: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        left, right = x >> bits[at], x & low[at]
        for turn in range(4):
            mixed = text.mix64(right + key[at] + np.uint64(turn * 0x9E3779B9 + 1))
            left, right = right, (left ^ mixed) & low[at]
        return (left << bits[at]) | right

    out = once(place.astype(np.uint64), slice(None))
    while len(outside := np.flatnonzero(out >= count.astype(np.uint64))):
        out[outside] = once(out[outside], outside)
    return out.astype(np.int64)


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Return the documents, and the pieces of the mix.

    Documents: ``doc_id, source, mark, copy, row, size, source_size, target``; ``copy`` numbers rows that are alike, ``row`` is a
    document's place in its source's stream of words. Pieces: ``shard, slot, round, doc_id, source, mark, copy, first_word, n_words``:
    which words of a document fill which slot.
    """
    from odflow.session import write_table

    spark = docs.sparkSession
    sizes = write_table(sized(docs))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).collect()  # a row per source
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))]
    held = [int(r.source_size) for r in totals]
    targets = shares(held, weights)
    blocks = [-(-n // block_words) for n in held]
    quotas = [min(MOST_ROUNDS * b, round(t * b / n)) if n else 0 for t, b, n in zip(targets, blocks, held, strict=True)]
    frame = spark.createDataFrame(
        [(i, r.source, n, t) for i, (r, n, t) in enumerate(zip(totals, held, targets, strict=True))],
        "source_no int, source_name string, source_size long, target double",
    )
    numbered = sizes.join(F.broadcast(frame), F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    parts = tables.width(spark)
    # Rows that are alike are counted and then told apart by number.
    alike = numbered.groupBy("source_no", *KEY, "size", "source_size", "target").count()
    alike = alike.withColumn("all_size", F.col("size") * F.col("count"))
    placed = tables.running_start(alike, ["source_no"], ["doc_id", "mark"], "all_size", "start", parts)
    placed = placed.select("*", F.posexplode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy", "_")).drop("_", "count", "all_size")
    placed = write_table(placed.withColumn("start", F.col("start") + F.col("copy") * F.col("size")))
    documents = placed.select(*KEY, "copy", F.col("start").alias("row"), "size", "source_size", "target")

    slots = _slots(spark, quotas, blocks, shard_slots, seed, parts)
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.where("size > 0").select("source_no", *KEY, "start", "copy", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.select("source_no", *KEY, "copy", "block", (begin - F.col("start")).alias("first_word"), (end - begin).alias("n_words"))
    mixed = slots.join(pieces, ["source_no", "block"]).select("shard", "slot", "round", *KEY, "copy", "first_word", "n_words")
    return documents, mixed


def _slots(spark, quotas: list[int], blocks: list[int], shard_slots: int, seed: int, parts: int) -> DataFrame:
    """``shard, slot, source_no, round, block`` for every slot of the mix."""
    total = sum(quotas)
    shape = "shard long, slot long, source_no int, round int, block long"
    if not total:
        return spark.createDataFrame([], shape)
    n_shards = -(-total // shard_slots)
    odds = np.array(quotas, dtype=float) / total

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                size = min(shard_slots, total - shard * shard_slots)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(size, odds)
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "source_no": some, "n": counts[some]})

    draws = spark.range(0, n_shards, 1, min(parts, n_shards)).mapInPandas(draw, "shard long, source_no int, n long")
    draws = tables.running_start(draws, ["source_no"], ["shard"], "n", "first", parts)
    drawn = {r.source_no: int(r.n) for r in draws.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    quota = np.array(quotas, dtype=np.int64)
    got = np.array([drawn.get(i, 0) for i in range(len(quotas))], dtype=np.int64)
    surplus, short = np.maximum(got - quota, 0), np.maximum(quota - got, 0)
    surplus_start, short_end = np.cumsum(surplus) - surplus, np.cumsum(short)
    n_blocks = np.array(blocks, dtype=np.int64)
    keys = text.mix64(np.arange(len(quotas), dtype=np.uint64) + np.uint64(seed << 20))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count = batch["n"].to_numpy(np.int64)
            source = np.repeat(batch["source_no"].to_numpy(np.int64), count)
            shard = np.repeat(batch["shard"].to_numpy(np.int64), count)
            nth = text.ranges(batch["first"].to_numpy(np.int64), count)
            over = np.flatnonzero(nth >= quota[source])
            extra = surplus_start[source[over]] + nth[over] - quota[source[over]]
            to = np.searchsorted(short_end, extra, side="right")
            nth[over] = quota[to] - (short_end[to] - extra)
            source[over] = to
            yield pd.DataFrame({
                "shard": shard,
                "slot": text.ranges(np.zeros(len(count), dtype=np.int64), count),
                "source_no": source,
                "round": nth // n_blocks[source],
                "block": permuted(nth % n_blocks[source], n_blocks[source], keys[source]),
            })

    return draws.select("shard", "source_no", "n", "first").mapInPandas(fill, shape)


def taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """Documents with ``taken``: words that the mix takes of each, repeats counted."""
    sums = pieces.groupBy(*KEY, "copy").agg(F.sum("n_words").alias("taken"))
    joined = _same(documents, sums, [*KEY, "copy"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """The mix as rows of ``docs``: for each round in which words of a document are taken, those words as ``text``; ``n_chars`` follows.

    Runs of words keep the text between them; a gap becomes a line feed. Of rows that are alike, one gives the other columns.
    """
    docs, named = tables.shielded(docs, ("doc_id", "source", "text", "n_chars"))
    names = docs.columns
    _, pieces = mix(docs, block_words, shard_slots, seed)
    spans = pieces.groupBy(*KEY, "copy", "round").agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("spans"))
    keyed = _keyed(docs)
    once = keyed.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in keyed.columns if c not in KEY])
    rows = _same(once, spans.select(*KEY, "spans"), KEY, "inner").select(*names, "spans")
    shape = T.StructType([T.StructField(c, T.LongType() if c == "n_chars" else rows.schema[c].dataType) for c in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, "text"):
            data, offsets = text.flat(batch.column("text"))
            starts, ends, first = text.words(data, offsets)
            body, new = data.tobytes(), []
            for at, spans in zip(first.tolist(), batch.column("spans").to_pylist(), strict=False):
                runs: list[list[int]] = []
                for s in spans:
                    if runs and runs[-1][1] == s["first_word"]:
                        runs[-1][1] += s["n_words"]
                    else:
                        runs.append([s["first_word"], s["first_word"] + s["n_words"]])
                new.append(b"\n".join(body[starts[at + a] : ends[at + b - 1]] for a, b in runs).decode())
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in new], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return named(rows.mapInArrow(cut, shape))
