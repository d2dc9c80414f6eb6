"""Seeded samples. Draws hang on row ids and a seed, never on partitioning or task order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.spread import hash_order, hash_uniform, lookup_join
from odflow.operators.zones import AREA
from odflow.session import shuffle_width, write_table

# Revealed shares.
EDGE_SHARES = {"1pct_edges": 0.01, "10pct_edges": 0.10}
ZONE_SHARE = 0.10

_BUCKET_BITS = 10
# Draws of an origin that one row of it makes, and draws of one task, in the mean.
DRAWS_A_PIECE = 1 << 16
DRAWS_A_TASK = 1 << 22


def hash_sample(
    rows: DataFrame, keys: Sequence[str], ids: Sequence[str], sizes: DataFrame, seed: int = 0, apart: bool = False
) -> DataFrame:
    """Exactly ``size`` rows per key (all if fewer): those with the smallest hash of their ids.

    Rows fall into 1,024 hash buckets; bucket counts say which buckets are taken whole and where the
    cut lies, so ranking happens inside single buckets and never over a whole key. With ``apart``, for tables too large to sort, buckets taken
    whole are not ranked at all: ``rows`` are read once for these and once for the bucket of the cut.
    """
    hashed = rows.withColumn("_h", hash_order(*keys, *ids, seed=seed)).withColumn(
        "_bucket", F.shiftright("_h", 64 - _BUCKET_BITS)
    )
    counts = hashed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(sizes.select(*keys, "size"), list(keys))
        .where(F.col("_before") < F.col("size"))
        .select(*keys, "_bucket", (F.col("size") - F.col("_before")).alias("_take"), (F.col("_before") + F.col("_n") <= F.col("size")).alias("_whole"))
    )
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_h", *ids))
    met, more = hashed.join(cuts, [*keys, "_bucket"]), ["_h", "_bucket", "_take", "_whole"]
    if not apart:
        return met.withColumn("_place", place).where(F.col("_place") <= F.col("_take")).drop(*more, "_place")
    met = hashed.join(F.broadcast(write_table(cuts)), [*keys, "_bucket"])
    ranked = met.where(~F.col("_whole")).withColumn("_place", place).where(F.col("_place") <= F.col("_take"))
    return met.where("_whole").drop(*more).unionByName(ranked.drop(*more, "_place"))


def origin_holdout(zones: DataFrame, size: int | Column, area: Sequence[str] = AREA, seed: int = 0) -> DataFrame:
    """``size`` random origins per area as test, the rest as train: (area, zone, role)."""
    every = zones.select(*area, "zone")
    wanted = F.lit(size) if isinstance(size, int) else size
    sizes = every.groupBy(*area).agg(F.count("*").alias("n")).select(
        *area, F.least(wanted.cast("long"), F.col("n")).alias("size")
    )
    held = hash_sample(every, area, ["zone"], sizes, seed).withColumn("_held", F.lit(True))
    return every.join(held, [*area, "zone"], "left").select(
        *area, "zone", F.when(F.col("_held"), "test").otherwise("train").alias("role")
    )


def weighted_destinations(cells: DataFrame, keys: Sequence[str], most: int | None = None, seed: int = 0) -> DataFrame:
    """Destinations drawn with replacement in proportion to flow: (keys, origin, draw, destination).

    An origin gets as many draws as its flow, at least one. ``most`` bounds the draws of a key by thinning
    all its origins in proportion (each keeps one at least); no origin is left out. A draw finds its destination as the
    last cumulative-flow boundary at or before it, by halving the sorted boundaries of its origin: draws are neither shuffled nor sorted.
    """
    positive = cells.where(F.col("flow") > 0)
    upto = Window.partitionBy(*keys, "origin").orderBy(*zone_order("destination")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    bounds = positive.withColumn("_at", F.coalesce(F.sum("flow").over(upto), F.lit(0.0)))
    # Equal boundaries keep the order of zones, so that the last of them is found.
    entry = F.struct("_at", *[c.alias(f"_{i}") for i, c in enumerate(zone_order("destination"))])
    kept = write_table(
        bounds.groupBy(*keys, "origin").agg(F.sum("flow").alias("_mass"), F.sort_array(F.collect_list(entry)).alias("_cells"))
        .select(*keys, "origin", "_mass", F.col("_cells._at").alias("_bounds"), F.col("_cells._1").alias("_names"))
    )
    rate = F.lit(1.0)
    if most is not None:
        whole = write_table(kept.groupBy(*keys).agg(F.sum("_mass").alias("_whole")))
        kept = lookup_join(kept, whole, list(keys), spread=["origin"])
        rate = F.least(F.lit(1.0), F.lit(float(most)) / F.col("_whole"))
    number = F.greatest(F.floor(F.col("_mass") * rate).cast("long"), F.lit(1).cast("long"))
    # Pieces of an origin's draws are dealt with its boundaries, so that an origin of much flow is no single task's work.
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / DRAWS_A_PIECE).cast("long"))
    kept = kept.withColumn("_n", number)
    most_cells, draws = kept.agg(F.max(F.size("_bounds")), F.sum("_n")).first()
    tasks = max(shuffle_width(cells.sparkSession), math.ceil((draws or 0) / DRAWS_A_TASK))
    kept = kept.withColumn("_piece", F.explode(pieces)).repartition(tasks, *keys, "origin", "_piece")
    first, last = F.col("_piece") * DRAWS_A_PIECE + 1, F.least(F.col("_n"), (F.col("_piece") + 1) * DRAWS_A_PIECE)
    found = kept.withColumn("draw", F.explode(F.sequence(first, last))).withColumn(
        "_at", hash_uniform(*keys, "origin", "draw", seed=seed) * F.col("_mass")
    ).withColumn("_place", F.lit(0))
    for bit in reversed(range(max((most_cells or 1) - 1, 0).bit_length())):
        further = F.col("_place") + (1 << bit)
        found = found.withColumn("_place", F.when(F.get("_bounds", further) <= F.col("_at"), further).otherwise(F.col("_place")))
    return found.select(*keys, "origin", "draw", F.get("_names", F.col("_place")).alias("destination"))


def zone_order(column: str) -> list[Column]:
    """Order of zone ids: by number when they are numbers, else as text."""
    return [F.col(column).try_cast("bigint"), F.col(column)]


def capped_destinations(
    pairs: DataFrame, keys: Sequence[str], cap: int, seed: int = 0
) -> DataFrame:
    """Every destination with flow, filled up to ``cap`` per origin with random others."""
    first = Window.partitionBy(*keys, "origin").orderBy(
        (F.col("flow") > 0).desc(), hash_order(*keys, "origin", "destination", seed=seed), "destination"
    )
    return pairs.withColumn("_place", F.row_number().over(first)).where(
        (F.col("flow") > 0) | (F.col("_place") <= cap)
    ).drop("_place")


def reveal_mask(
    pairs: DataFrame,
    zones: DataFrame,
    train: DataFrame,
    mask: str,
    area: Sequence[str] = AREA,
    seed: int = 0,
) -> DataFrame:
    """Pairs (area, fold, origin, destination) whose target flow is revealed.

    Edge masks reveal a share of N² cells among those of non-held-out origins; the zone mask reveals
    all pairs within a share of the zones, whatever is held out.
    """
    folds = train.select(*area, "fold").distinct()
    counts = zones.groupBy(*area).agg(F.count("*").alias("n")).join(folds, list(area))
    at = [*area, "fold"]
    if mask in EDGE_SHARES:
        size = F.greatest(F.floor(EDGE_SHARES[mask] * F.col("n") * F.col("n")).cast("long"), F.lit(1))
        candidates = lookup_join(pairs.select(*area, "origin", "destination"), train, [*area, "origin"], spread=["destination"])
        return hash_sample(
            candidates, at, ["origin", "destination"], counts.select(*at, size.alias("size")), seed, apart=True
        ).select(*at, "origin", "destination")
    if mask == "10pct_zones":
        size = F.greatest(F.floor(ZONE_SHARE * F.col("n")).cast("long"), F.lit(1))
        candidates = zones.select(*area, "zone").join(folds, list(area))
        chosen = write_table(hash_sample(candidates, at, ["zone"], counts.select(*at, size.alias("size")), seed))
        starts = lookup_join(pairs.select(*area, "origin", "destination"), chosen.withColumnRenamed("zone", "origin"), [*area, "origin"], spread=["destination"])
        ends = chosen.withColumnRenamed("zone", "destination")
        return lookup_join(starts, ends, [*at, "destination"], "left_semi", spread=["origin"]).select(*at, "origin", "destination")
    raise ValueError(f"no such mask: {mask}")
