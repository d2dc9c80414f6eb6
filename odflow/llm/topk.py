"""Exact top-k inner products by norm buckets.

Vectors are grouped by length into buckets. A query with a running k-th best score s turns s into a local cosine threshold
for each bucket, s / (|q| · longest of the bucket). Above 1 the bucket is left out; where it is high, vectors are pruned by their
coordinates on the query's largest axes; where it is low, by length alone. Products of what is left are computed exactly.

Cases: null vectors, and vectors with null or non-finite components, take no part. Vectors of other lengths than the
query's are no candidates for it. Repeated ids are rows of their own; a query's own row, and any row of its id, is no candidate of it. Ties go to
the smaller id. An empty table gives no rows. Other columns are ignored.
Bound: a task holds a block of queries and a block of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm import tables

BUCKET_ROWS = 4096
QUERY_ROWS = 512
#: Axes that coordinate pruning looks at.
FOCUS = 4
#: Above this local cosine threshold coordinates prune better than lengths.
HIGH_COSINE = 0.6
#: Up to this magnitude products of doubles are exact integers.
EXACT = 2.0**53


def whole_numbers(vectors: DataFrame, factor: float = 256.0) -> DataFrame:
    """``vec_id, v array<long>, norm``: components times ``factor``, rounded down; only vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = vectors.select(F.col("vec_id").cast("long"), "embedding", x.alias("x")).where(fine)
    scaled = scaled.select("vec_id", F.transform("x", lambda c: F.floor(c * factor)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return scaled.withColumn("norm", norm).withColumn("dim", F.size("v"))


def _matrix(block: pd.DataFrame) -> np.ndarray:
    return np.array(block["v"].tolist(), dtype=np.int64)


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: ids and components as bytes."""
    shape = ", ".join(f"{k} long" for k in keys) + ", ids binary, body binary, top double, n int"

    def pack(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by([("norm", "descending"), ("vec_id", "ascending")])
        ids = block.column("vec_id").to_numpy().astype(np.int64)
        body = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        top = float(block.column("norm")[0].as_py())
        return pa.table({**{k: pa.array([v.as_py()], pa.int64()) for k, v in zip(keys, key, strict=True)}, "ids": [ids.tobytes()], "body": [body.tobytes()], "top": [top], "n": pa.array([len(ids)], pa.int32())})

    return rows.groupBy(*keys).applyInArrow(pack, shape)


def _blocks(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """Rows with ``bucket`` (by length) and ``part`` (blocks of about ``size`` rows within a bucket, by hashed id)."""
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.expr("percentile_approx(norm, array(0.5, 0.75, 0.9, 0.97, 0.99), 1000)").alias("cuts"))
    cut = F.aggregate("cuts", F.lit(0).cast("long"), lambda s, c: s + F.when(F.col("norm") > c, 1).otherwise(0))
    joined = rows.join(F.broadcast(counts), "dim")
    parts = F.ceil(F.col("n") / F.lit(size)).cast("long")
    return joined.withColumn("bucket", cut).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(seed)), parts)).drop("n", "cuts")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where that is exact."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if bound < EXACT:
        return np.rint(queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def _search(query_ids, queries, floors, ids, rows, top, k):
    """Best candidates of one block for every query that may gain from it."""
    dim = queries.shape[1]
    q = queries.astype(np.float64)
    q_norm = np.sqrt((q * q).sum(axis=1))
    v = rows.astype(np.float64)
    v_norm = np.sqrt((v * v).sum(axis=1))
    unit = v / np.maximum(v_norm, 1e-300)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = floors / (q_norm * top)
    slack = 1e-9
    open_ = np.flatnonzero((q_norm == 0) | (top == 0) | ~(local > 1 + slack))
    out = []
    low = open_[~(local[open_] > HIGH_COSINE)]
    if len(low):
        # Length pruning: rows are sorted by length, so what may still reach the weakest floor is a prefix.
        least = np.min(np.where(q_norm[low] > 0, floors[low] / np.maximum(q_norm[low], 1e-300), -np.inf))
        upto = len(v_norm) if not least > 0 else int(np.searchsorted(-v_norm, -(least * (1 - slack)), side="right"))
        if upto:
            scores = _products(queries[low], rows[:upto])
            for i, s in zip(low, scores, strict=True):
                out.append((i, s, slice(0, upto)))
    for i in open_[local[open_] > HIGH_COSINE]:
        axes = np.argsort(-np.abs(q[i]))[: min(FOCUS, dim)]
        part = q[i, axes] / q_norm[i]
        seen = unit[:, axes] @ part
        rest_q = np.sqrt(max(0.0, 1 - part @ part))
        rest_v = np.sqrt(np.maximum(0.0, 1 - (unit[:, axes] ** 2).sum(axis=1)))
        keep = np.flatnonzero((seen + rest_q * rest_v) * v_norm * q_norm[i] >= floors[i] - slack * abs(floors[i]) - 1e-6)
        if len(keep):
            out.append((i, _products(queries[i : i + 1], rows[keep])[0], keep))
    for i, scores, places in out:
        own = ids[places] == query_ids[i]
        scores, cand = scores[~own], ids[places][~own]
        best = _best(cand, scores, k)
        for j in best:
            if not scores[j] < floors[i]:
                yield int(query_ids[i]), int(cand[j]), int(scores[j])


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row where ``is_query`` holds (null ids are no queries).

    A first pass scores each query against one block of the longest vectors; the k-th best there is its floor. The
    second pass opens, for every block of queries, the buckets whose longest vector can reach the weakest floor.
    """
    from odflow.session import write_table

    spark = vectors.sparkSession
    rows = write_table(whole_numbers(vectors))
    cand = write_table(_packed(_blocks(rows.where("vec_id is not null"), BUCKET_ROWS, 1), ["dim", "bucket", "part"]))
    queries = rows.where(is_query & F.col("vec_id").isNotNull()).distinct()
    packed = write_table(_packed(_blocks(queries, QUERY_ROWS, 2), ["dim", "bucket", "part"]).select("dim", *[F.col(c).alias(f"q_{c}") for c in ("bucket", "part", "ids", "body", "top", "n")]))

    lead = cand.groupBy("dim").agg(F.max_by(F.struct("bucket", "part"), F.struct("top", "bucket", "part")).alias("lead"))
    seeds = cand.join(F.broadcast(lead), "dim").where((F.col("bucket") == F.col("lead.bucket")) & (F.col("part") == F.col("lead.part")))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qi, q, ids, body = _unpack(r)
                scores = _products(q, body).astype(np.float64)
                scores[qi[:, None] == ids[None, :]] = -np.inf
                kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(qi), -np.inf)
                reach = np.where(kth > 0, kth / np.maximum(np.sqrt((q.astype(float) ** 2).sum(axis=1)), 1e-300), 0.0).min(initial=np.inf)
                yield pa.RecordBatch.from_pydict({"dim": [r["dim"]], "q_bucket": [r["q_bucket"]], "q_part": [r["q_part"]], "floors": [kth.tobytes()], "reach": [float(reach)]})

    with_seed = packed.join(seeds.select("dim", "ids", "body"), "dim").repartition(tables.width(spark), "q_bucket", "q_part")
    floor = write_table(with_seed.mapInArrow(floors, "dim long, q_bucket long, q_part long, floors binary, reach double"))

    # Which blocks meet is settled on their keys and lengths alone; then each side's bytes are joined on.
    names = cand.select("dim", "bucket", "part", "top")
    opened = floor.select("dim", "q_bucket", "q_part", "reach").join(names, "dim").where(F.col("top") >= F.col("reach") * (1 - 1e-9)).drop("reach", "top")
    work = opened.join(packed.join(floor.drop("reach"), ["dim", "q_bucket", "q_part"]), ["dim", "q_bucket", "q_part"]).join(cand, ["dim", "bucket", "part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qi, q, ids, body = _unpack(r)
                found = list(_search(qi, q, np.frombuffer(r["floors"], dtype=np.float64), ids, body, r["top"], k))
                if found:
                    yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), map(list, zip(*found, strict=True)), strict=True)))

    spread = work.repartition(tables.width(spark), "q_bucket", "q_part", "bucket", "part")
    found = spread.mapInArrow(search, "query_id long, vec_id long, score long")
    # Each block gives k at most; arrays are cut to k in the map-side part of the sum.
    worst_first = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("vec_id"))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(worst_first)), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )


def _unpack(r: dict):
    qi, ids = np.frombuffer(r["q_ids"], dtype=np.int64), np.frombuffer(r["ids"], dtype=np.int64)
    return qi, np.frombuffer(r["q_body"], dtype=np.int64).reshape(len(qi), -1), ids, np.frombuffer(r["body"], dtype=np.int64).reshape(len(ids), -1)
