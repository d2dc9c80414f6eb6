"""Zone adjacency: hop distances, seeds, balanced blocks, folds, random contiguous merging.

Edges are (area, src, dst). Every loop carries all areas at once; a round writes its result to the
checkpoint folder as a table, so the plan stays short and a lost executor costs one round. A checkpoint would keep the planner's
estimate of its size: joins multiply it, so it doubles its digits each round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.spread import hash_order
from odflow.operators.sampling import hash_sample, zone_order
from odflow.operators.zones import AREA
from odflow.session import write_table as materialise

# Number of spatial blocks and zones an area needs for a mechanism study.
N_BLOCKS = 5
MIN_MECHANISM_ZONES = 80
#: Levels of a breadth-first search in one job.
HOPS_A_ROUND = 4


def undirected(edges: DataFrame, keys: Sequence[str] = AREA) -> DataFrame:
    """Both directions of every edge, once; self-loops dropped."""
    there = edges.select(*keys, "src", "dst")
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return there.unionByName(back).where(F.col("src") != F.col("dst")).distinct()


def hop_distances(
    edges: DataFrame, sources: DataFrame, keys: Sequence[str] = AREA, below: DataFrame | None = None
) -> DataFrame:
    """Fewest hops from the nearest source (keys, zone) to every zone reached: (keys, zone, hops).

    A round goes ``HOPS_A_ROUND`` hops from the last level in one job. Edges must be undirected, so it can only meet again what this round's
    band of levels and the one before hold. With ``below`` (keys, zone, hops) only zones that come nearer than listed are visited.
    """
    at = [*keys, "zone"]
    band = materialise(sources.select(*at).distinct().withColumn("hops", F.lit(0)))
    before, bands, hops = None, [], 0
    while not band.isEmpty():
        bands.append(band)
        seen = band if before is None else band.unionByName(before)
        step, steps = band.where(F.col("hops") == hops).select(*at), []
        for more in range(1, HOPS_A_ROUND + 1):
            step = edges.join(step.withColumnRenamed("zone", "src"), [*keys, "src"]).select(*keys, F.col("dst").alias("zone")).distinct()
            steps.append(step.withColumn("hops", F.lit(hops + more)))
        near = reduce(DataFrame.unionByName, steps).groupBy(*at).agg(F.min("hops").alias("hops"))
        near = near.join(seen.select(*at), at, "left_anti")
        if below is not None:
            known = below.select(*at, F.col("hops").alias("_known"))
            near = near.join(known, at, "left").where(F.col("_known").isNull() | (F.col("_known") > F.col("hops"))).drop("_known")
        before, band, hops = band, materialise(near), hops + HOPS_A_ROUND
    if not bands:
        return sources.select(*at, F.lit(0).alias("hops"))
    return reduce(DataFrame.unionByName, bands)


def farthest_seeds(
    edges: DataFrame, zones: DataFrame, n_seeds: int = N_BLOCKS, keys: Sequence[str] = AREA
) -> DataFrame:
    """Seeds far apart on the graph: (keys, seed_no, zone).

    The first zone comes first; each next one is farthest from its nearest seed (smallest id on
    ties). Zones no seed reaches come after all reached ones.
    """
    links = materialise(undirected(edges, keys))
    every = zones.select(*keys, "zone")

    def pick(candidates: DataFrame, number: int) -> DataFrame:
        first = F.min(F.struct((-F.col("_far")).alias("far"), *[c.alias(f"o{i}") for i, c in enumerate(zone_order("zone"))], "zone"))
        return candidates.groupBy(*keys).agg(first.alias("_best")).select(
            *keys, F.lit(number).alias("seed_no"), F.col("_best.zone").alias("zone")
        )

    seeds = materialise(pick(every.withColumn("_far", F.lit(0)), 0))
    nearest = materialise(hop_distances(links, seeds, keys))
    for number in range(1, n_seeds):
        left = every.join(seeds, [*keys, "zone"], "left_anti").join(nearest, [*keys, "zone"], "left")
        new = materialise(pick(left.withColumn("_far", F.coalesce("hops", F.lit(-1))), number))
        if new.isEmpty():
            break
        seeds = seeds.unionByName(new)
        if number < n_seeds - 1:
            nearer = hop_distances(links, new, keys, below=nearest)
            nearest = materialise(
                nearest.unionByName(nearer).groupBy(*keys, "zone").agg(F.min("hops").alias("hops"))
            )
    return seeds


def balanced_blocks(
    edges: DataFrame, zones: DataFrame, n_blocks: int = N_BLOCKS, keys: Sequence[str] = AREA
) -> DataFrame:
    """Blocks grown from far-apart seeds, sizes differing by at most one: (keys, zone, block).

    A round lets every open zone next to a block with room ask the emptiest such block; a block
    takes no more than its room, smallest ids first. Zones left without a block that has room next
    to them fill the remaining places in id order, so the size bound always holds while connected
    blocks are best effort (see :func:`block_quality`).
    """
    links = materialise(undirected(edges, keys))
    every = materialise(zones.select(*keys, "zone"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    quotas = materialise(
        every.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("block", blocks).select(
            *keys, "block",
            (F.floor(F.col("_n") / n_blocks) + F.when(F.col("block") < F.col("_n") % n_blocks, 1).otherwise(0)).alias("quota"),
        )
    )
    placed = materialise(
        farthest_seeds(edges, zones, n_blocks, keys).select(*keys, "zone", F.col("seed_no").alias("block"))
    )
    while True:
        sizes = placed.groupBy(*keys, "block").agg(F.count("*").alias("_size"))
        room = quotas.join(sizes, [*keys, "block"], "left").select(
            *keys, "block", (F.col("quota") - F.coalesce("_size", F.lit(0))).alias("_room")
        )
        open_blocks = room.where(F.col("_room") > 0)
        asked = (
            links.join(placed.withColumnRenamed("zone", "src"), [*keys, "src"])
            .select(*keys, F.col("dst").alias("zone"), "block")
            .distinct()
            .join(placed, [*keys, "zone"], "left_anti")
            .join(open_blocks, [*keys, "block"])
            .groupBy(*keys, "zone")
            .agg(F.min(F.struct((-F.col("_room")).alias("least"), "block")).alias("_to"))
            .select(*keys, "zone", F.col("_to.block").alias("block"), (-F.col("_to.least")).alias("_room"))
        )
        turn = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(*zone_order("zone")))
        taken = materialise(asked.withColumn("_turn", turn).where(F.col("_turn") <= F.col("_room")).select(*keys, "zone", "block"))
        if taken.isEmpty():
            break
        placed = materialise(placed.unionByName(taken))
    upto = Window.partitionBy(*keys).orderBy("block")
    slots = open_blocks.withColumn("_end", F.sum("_room").over(upto)).withColumn("_start", F.col("_end") - F.col("_room"))
    places = slots.withColumn("_slot", F.explode(F.sequence(F.col("_start") + 1, F.col("_end")))).select(*keys, "_slot", "block")
    left = every.join(placed, [*keys, "zone"], "left_anti").withColumn(
        "_slot", F.row_number().over(Window.partitionBy(*keys).orderBy(*zone_order("zone"))).cast("long")
    )
    return placed.unionByName(left.join(places, [*keys, "_slot"]).select(*keys, "zone", "block"))


def block_quality(blocks: DataFrame, edges: DataFrame, keys: Sequence[str] = AREA) -> DataFrame:
    """Per area: blocks, size spread and how many blocks are connected."""
    held = materialise(blocks.select(*keys, "zone", "block"))
    links = undirected(edges, keys)
    inside = (
        links.join(held.select(*keys, F.col("zone").alias("src"), "block"), [*keys, "src"])
        .join(held.select(*keys, F.col("zone").alias("dst"), F.col("block").alias("_other")), [*keys, "dst"])
        .where(F.col("block") == F.col("_other"))
        .select(*keys, "block", "src", "dst")
    )
    at = [*keys, "block"]
    start = held.groupBy(*at).agg(F.min("zone").alias("zone"))
    reached = hop_distances(materialise(inside), start, at).groupBy(*at).agg(F.count("*").alias("_reached"))
    sizes = held.groupBy(*at).agg(F.count("*").alias("_size"))
    return sizes.join(reached, at, "left").groupBy(*keys).agg(
        F.count("*").alias("n_blocks"),
        (F.max("_size") - F.min("_size")).alias("size_spread"),
        F.count_if(F.col("_size") == F.col("_reached")).alias("n_connected"),
    )


def block_folds(blocks: DataFrame, keys: Sequence[str] = AREA) -> DataFrame:
    """One fold per block: its zones test, all others train: (keys, fold, zone, role)."""
    folds = blocks.select(*keys, F.col("block").alias("fold")).distinct()
    return blocks.join(folds, list(keys)).select(
        *keys, "fold", "zone", F.when(F.col("block") == F.col("fold"), "test").otherwise("train").alias("role")
    )


def size_guard(zones: DataFrame, keys: Sequence[str] = AREA, minimum: int = MIN_MECHANISM_ZONES) -> DataFrame:
    """Whether an area has enough zones for a mechanism study."""
    return zones.groupBy(*keys).agg(F.count("*").alias("n_zones")).withColumn(
        "mechanism_ok", F.col("n_zones") >= minimum
    )


def contiguous_merge(
    edges: DataFrame,
    zones: DataFrame,
    realisations: int = 3,
    target: DataFrame | None = None,
    keys: Sequence[str] = AREA,
    seed: int = 0,
    max_rounds: int = 200,
) -> DataFrame:
    """Random merging of neighbours until the zone count is halved: (keys, realisation, zone, group).

    ``target`` (keys, target_n) overrides the half. A round tosses a coin per group; tails join one
    random neighbouring heads group, no more of them than are still needed. All realisations run as
    one keyed job. Merging stops early where no two groups touch; if ``max_rounds`` end it before the goal, it fails.
    """
    at = [*keys, "realisation"]
    links = materialise(undirected(edges, keys))
    every = zones.select(*keys, "zone")
    counts = every.groupBy(*keys).agg(F.count("*").alias("_n"))
    goals = (
        counts.select(*keys, F.greatest(F.floor(F.col("_n") / 2), F.lit(1)).cast("long").alias("_goal"))
        if target is None
        else target.select(*keys, F.col("target_n").cast("long").alias("_goal"))
    )
    mapping = materialise(
        every.withColumn("realisation", F.explode(F.sequence(F.lit(0), F.lit(realisations - 1)))).select(
            *at, "zone", F.col("zone").alias("group")
        )
    )
    for turn in range(max_rounds):
        left = (
            mapping.groupBy(*at).agg(F.countDistinct("group").alias("_groups")).join(goals, list(keys))
            .select(*at, (F.col("_groups") - F.col("_goal")).alias("size"))
            .where(F.col("size") > 0)
        )
        touching = materialise(
            mapping.join(left, at, "left_semi")
            .select(*at, F.col("zone").alias("src"), F.col("group").alias("near"))
            .join(links, [*keys, "src"])
            .join(mapping.select(*at, F.col("zone").alias("dst"), F.col("group").alias("far")), [*at, "dst"])
            .where(F.col("near") != F.col("far"))
            .select(*at, "near", "far")
            .distinct()
        )
        if touching.isEmpty():
            break

        def tails(group: str, turn: int = turn):
            return F.pmod(hash_order("realisation", group, F.lit(turn), seed=seed), F.lit(2)) == 1

        offers = touching.where(tails("near") & ~tails("far")).groupBy(*at, "near").agg(
            F.min(F.struct(hash_order("realisation", "near", "far", F.lit(turn), seed=seed + 1), "far")).alias("_to")
        )
        joins = hash_sample(
            offers.select(*at, "near", F.col("_to.far").alias("into")), at, ["near"], left, seed + 2 + turn
        )
        mapping = materialise(
            mapping.join(joins.withColumnRenamed("near", "group"), [*at, "group"], "left").select(
                *at, "zone", F.coalesce("into", "group").alias("group")
            )
        )
    else:
        raise RuntimeError(f"merging did not reach its goal in {max_rounds} rounds")
    return mapping
