"""Phrases that hold together, mined from persisted occurrence relations, one phrase length after the other.

The occurrence relation of a length holds the position and number of every frequent phrase, sorted by position, in blocks of whole
documents; positions of consecutive words of a piece are consecutive, and a piece's end leaves a gap. A step merge-joins the
sorted relation with itself by piece and adjacent position (two phrases of ``k`` words that overlap in ``k - 1`` give one of ``k + 1``), counts the
groups over all documents, keeps the frequent ones, and writes the occurrences of these (the semi-join) as the next relation. A phrase is
known by the numbers of its first and of its last ``k`` words, so that all counts are exact.

The semi-join looks groups up in every task while their table has ``most_shipped`` rows at most; a larger one is joined by a shuffle, with the
positions of a group within a block as one row.

Cases: a null text has no words; a null language is ``und``; repeated rows count each time; ties of rank go to the phrase first in the order of
bytes; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.llm import text
from odflow.session import write_table

LEAST_COUNT = 30
LONGEST = 4
BEST = 2000
UNKNOWN = "und"
#: Rows of a table of groups that every task holds at most: 16 bytes each, or a word.
MOST_SHIPPED = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False


def words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Distinct words and the word of each occurrence; distinct languages and the language of each; positions, with gaps at the ends of pieces."""
    data, offsets = text.flat(batch.column("text"))
    lang = pc.fill_null(batch.column("lang").cast(pa.large_string()), UNKNOWN).dictionary_encode()
    data = _LOWER[data]
    inside, stops = _INSIDE[data], np.concatenate(([0], np.cumsum(_ENDS[data])))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    size = ends - starts
    upto = np.concatenate(([0], np.cumsum(size)))
    held = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(upto), pa.py_buffer(data[text.ranges(starts, size)])).dictionary_encode()
    broken = (stops[starts[1:]] > stops[ends[:-1]]) | (row[1:] != row[:-1])
    at = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(broken)))[: len(starts)]
    return held.dictionary, held.indices.to_numpy().astype(np.int64), lang.dictionary, lang.indices.to_numpy().astype(np.int64)[row], at


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a slice; a null word stands for all words of its language."""
    for batch in text.slices(batches, "text"):
        names, word, langs, lang, _ = words(batch)
        key, n = np.unique(lang * max(1, len(names)) + word, return_counts=True)
        used, total = np.unique(lang, return_counts=True)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.concat_arrays([langs.take(key // max(1, len(names))), langs.take(used)]).cast(pa.string()),
            "word": pa.concat_arrays([names.take(key % max(1, len(names))), pa.nulls(len(used), pa.large_string())]).cast(pa.string()),
            "n": pa.array(np.concatenate((n, total)), pa.int64()),
        })


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte: high bytes are mostly alike."""
    return text.tight(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T))


def _unplaned(cell: pa.Buffer) -> np.ndarray:
    flat = text.untight(cell, np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<i8").ravel()


RELATION = "block long, at binary, phrase binary"


def _block(block: int, at: np.ndarray, phrase: np.ndarray) -> pa.RecordBatch:
    """A block of an occurrence relation: positions ascend."""
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "at": pa.array([_planes(np.diff(at, prepend=0))], pa.binary()), "phrase": pa.array([_planes(phrase)], pa.binary())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for block, at, phrase in zip(batch.column("block").to_pylist(), batch.column("at"), batch.column("phrase"), strict=True):
            yield block, np.cumsum(_unplaned(at.as_buffer())), _unplaned(phrase.as_buffer())


def _merged(at: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The relation joined with itself by adjacent position: position, first and second phrase."""
    next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[next_to], phrase[next_to], phrase[next_to + 1]


def _coded(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each pair, equal for equal pairs only, and the numbers the parts have in it."""
    held, code = np.unique(np.concatenate((first, second)), return_inverse=True)
    return code[: len(first)] * max(1, len(held)) + code[len(first) :], held


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, at, phrase in _blocks(batches):
        _, first, second = _merged(at, phrase)
        code, held = _coded(first, second)
        key, n = np.unique(code, return_counts=True)
        yield pa.RecordBatch.from_pydict({"first": pa.array(held[key // max(1, len(held))]), "second": pa.array(held[key % max(1, len(held))]), "n": pa.array(n, pa.int64())})


def _grouped(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct codes, and the positions of each."""
    order = np.argsort(code, kind="stable")
    key, first = np.unique(code[order], return_index=True)
    return key, pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(at[order], pa.int64()))


def _numbered(frame: DataFrame) -> DataFrame:
    """Written, with ``id`` counting from 0: a task's rows follow those of the tasks before it."""
    rows = write_table(frame.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    sizes = sorted((r.task, r["count"]) for r in rows.groupBy(task.alias("task")).count().collect())
    starts, upto = [], 0
    for k, n in sizes:
        starts.append((k, upto))
        upto += n
    base = rows.sparkSession.createDataFrame(starts, "_task long, _base long")
    return rows.join(F.broadcast(base), task == F.col("_task")).withColumn("id", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_task", "_base")


def _task_block(number: int) -> int:
    return (TaskContext.get().partitionId() << 33) + number


def _regrouped(parts: DataFrame) -> DataFrame:
    """Relation from rows ``block, id, places``: the blocks that a shuffled semi-join has left in pieces."""

    def run(group: pa.Table) -> pa.Table:
        places = group["places"].combine_chunks()
        at = places.flatten().to_numpy()
        phrase = np.repeat(group["id"].to_numpy(), pc.list_value_length(places).to_numpy())
        order = np.argsort(at)
        return pa.Table.from_batches([_block(group["block"][0].as_py(), at[order], phrase[order])])

    return parts.groupBy("block").applyInArrow(run, RELATION)


def _word_relation(docs: DataFrame, known: DataFrame, ship: bool) -> DataFrame:
    """Occurrences of the words in ``known`` (``lang, word, id``)."""
    if ship:
        table = known.select("lang", "word", "id").toArrow()
        langs, names = table["lang"].combine_chunks().cast(pa.large_string()).dictionary_encode(), table["word"].combine_chunks().cast(pa.large_string()).dictionary_encode()
        key = langs.indices.to_numpy().astype(np.int64) * max(1, len(names.dictionary)) + names.indices.to_numpy()
        order = np.argsort(key)
        shared = docs.sparkSession.sparkContext.broadcast((langs.dictionary, names.dictionary, key[order], table["id"].to_numpy()[order]))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_langs, all_names, keys, ids = shared.value
            for number, batch in enumerate(text.slices(batches, "text")):
                own, word, own_langs, lang, at = words(batch)
                place = pc.fill_null(pc.index_in(own, all_names), -1).to_numpy().astype(np.int64)[word]
                tongue = pc.fill_null(pc.index_in(own_langs, all_langs), -1).to_numpy().astype(np.int64)[lang]
                found, where = _found(keys, np.where((place < 0) | (tongue < 0), -1, tongue * max(1, len(all_names)) + place))
                yield _block(_task_block(number), at[found], ids[where[found]])

        return docs.mapInArrow(look_up, RELATION)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(text.slices(batches, "text")):
            own, word, own_langs, lang, at = words(batch)
            key, places = _grouped(lang * max(1, len(own)) + word, at)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(len(key), _task_block(number))), "lang": own_langs.take(key // max(1, len(own))).cast(pa.string()),
                "word": own.take(key % max(1, len(own))).cast(pa.string()), "places": places,
            })

    spread_out = docs.mapInArrow(spread, "block long, lang string, word string, places array<long>")
    return _regrouped(spread_out.join(known.select("lang", "word", "id"), ["lang", "word"]).select("block", "id", "places"))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted keys the sorted ones hold, and where."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[where] == wanted, where


def _longer_relation(relation: DataFrame, known: DataFrame, phrases: int, ship: bool) -> DataFrame:
    """Occurrences of the pairs in ``known`` (``first, second, id``), where the relation's phrases are numbered below ``phrases``."""
    if ship and phrases < 1 << 31:
        table = known.select("first", "second", "id").toArrow()
        key = table["first"].to_numpy() * phrases + table["second"].to_numpy()
        order = np.argsort(key)
        shared = relation.sparkSession.sparkContext.broadcast((key[order], table["id"].to_numpy()[order]))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, ids = shared.value
            for block, at, phrase in _blocks(batches):
                at, first, second = _merged(at, phrase)
                found, where = _found(keys, first * phrases + second)
                yield _block(block, at[found], ids[where[found]])

        return relation.mapInArrow(look_up, RELATION)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, at, phrase in _blocks(batches):
            at, first, second = _merged(at, phrase)
            code, held = _coded(first, second)
            key, places = _grouped(code, at)
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(key), block)), "first": pa.array(held[key // max(1, len(held))]), "second": pa.array(held[key % max(1, len(held))]), "places": places})

    spread_out = relation.mapInArrow(spread, "block long, first long, second long, places array<long>")
    return _regrouped(spread_out.join(known.select("first", "second", "id"), ["first", "second"]).select("block", "id", "places"))


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, most_shipped: int = MOST_SHIPPED) -> tuple[DataFrame, list[DataFrame]]:
    """Word totals (``lang, n``) and, per length from 1, the frequent phrases: ``id, lang, phrase, n`` and the parts they are made of.

    From length 2 on ``first`` and ``second`` are the ids of their first and last words but one. ``heads`` and ``tails`` hold the counts of
    their first, and of their last, 1, 2, … words.
    """
    docs = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = docs.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = _numbered(counts.where((F.col("n") >= least) | F.col("word").isNull()))
    known = counted.where("word IS NOT NULL")
    level = write_table(known.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", F.array("n").alias("heads"), F.array("n").alias("tails")))
    levels, size = [level], counted.count()
    relation = write_table(_word_relation(docs, known, known.count() <= most_shipped)) if longest > 1 else None
    for length in range(2, longest + 1):
        pairs = relation.mapInArrow(_pair_counts, "first long, second long, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))
        known = _numbered(pairs.where(F.col("n") >= least))
        part = lambda name: levels[-1].select(*[F.col(c).alias(f"_{name}_{c}") for c in levels[-1].columns])
        named = known.join(part("first"), F.col("first") == F.col("_first_id")).join(part("second"), F.col("second") == F.col("_second_id"))
        levels.append(write_table(named.select(
            "id", F.col("_first_lang").alias("lang"), F.concat_ws(" ", "_first_phrase", "_second_last").alias("phrase"), F.col("_second_last").alias("last"), "n",
            F.concat("_first_heads", F.array("n")).alias("heads"), F.concat("_second_tails", F.array("n")).alias("tails"), "first", "second",
        )))
        if length < longest:
            held = known.count()
            relation, size = write_table(_longer_relation(relation, known, size, held <= most_shipped)), held
    return counted.where("word IS NULL").select("lang", "n"), levels


def _exact(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def _cut(length: int) -> Column:
    """The cut of least score, the first of equal ones."""
    cuts = []
    for k in range(1, length):
        left, right = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        score = F.floor(F.try_divide(F.lit(2_000_000).cast("decimal(7,0)") * _exact(F.col("n")), _exact(left) + _exact(right))).cast("long")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, best: int = BEST, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``best`` phrases that no longer one explains."""
    totals, levels = mine(docs, most_shipped=most_shipped)
    rated = []
    for length in range(2, len(levels) + 1):
        own = levels[length - 1]
        if length < len(levels):
            # A phrase within a longer one is also within one that has a single word more and is at least as frequent.
            ends = F.explode(F.array("first", "second")).alias("id")
            longer = levels[length].select(ends, F.col("n").alias("_longer")).groupBy("id").agg(F.max("_longer").alias("_longer"))
            explained = _exact(F.col("_longer")) * 100 >= _exact(F.col("n")) * 80
            own = own.join(longer, "id", "left").where(~F.coalesce(explained, F.lit(False)))
        rated.append(own.select("lang", "phrase", F.col("n").alias("a"), _cut(length).alias("_cut")))
    every = rated[0]
    for more in rated[1:]:
        every = every.unionByName(more)
    every = every.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
