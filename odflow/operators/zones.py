"""Zone tables: clipping, distances, pair tables, merging zones into groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.labels import in_band, length_band
from odflow.functions.spread import dealt, lookup_join, planned_small
from odflow.session import shuffle_width, write_table

AREA = ("study_area",)
# Zones of one area that share a bucket of the pair join.
PAIR_BUCKET = 64
# Zone pairs of one task, in the mean.
PAIRS_A_TASK = 1 << 20
# A written zone list up to this size (a million zones, about) is broadcast to its pairs, whatever the session's threshold.
PAIR_BROADCAST_BYTES = 16 << 20


def intra_zonal_distance(area: Column) -> Column:
    """Radius of the circle with the zone's area; a negative area fails the job."""
    return F.when(area < 0, F.raise_error(F.lit("zone area must not be negative")).cast("double")).otherwise(
        F.sqrt(area / F.pi())
    )


def clip_to_zones(flows: DataFrame, zones: DataFrame, keys: Sequence[str] = AREA) -> DataFrame:
    """Rows whose origin and destination are both zones (of the same area, if zones carry areas)."""
    shared = [k for k in keys if k in zones.columns]
    known = zones.select(*shared, F.col("zone").cast("string").alias("zone")).distinct()
    for end, other in (("origin", "destination"), ("destination", "origin")):
        on = {**{k: k for k in shared}, end: "zone"}
        flows = lookup_join(flows, known, on, "left_semi", spread=[other])
    return flows


def attach_zone(
    rows: DataFrame, zones: DataFrame, columns: dict[str, str], end: str, keys: Sequence[str] = AREA
) -> DataFrame:
    """Add zone attributes (``{attribute: new name}``) of one end of each pair, NULL for unknown zones.

    A left join also adds no filter below, so that steps sharing the cells share their exchange.
    """
    shared = [k for k in keys if k in zones.columns]
    table = zones.select(*shared, "zone", *[F.col(c).alias(n) for c, n in columns.items()])
    other = "destination" if end == "origin" else "origin"
    return lookup_join(rows, table, {**{k: k for k in shared}, end: "zone"}, "left", spread=[other])


def centroid_distance(with_area: bool = True) -> Column:
    """Euclidean distance from ``x_o, y_o, x_d, y_d``; within a zone the equal-area radius, or 0."""
    within = intra_zonal_distance(F.col("area_o")) if with_area else F.lit(0.0)
    straight = F.sqrt(
        (F.col("x_o") - F.col("x_d")) * (F.col("x_o") - F.col("x_d"))
        + (F.col("y_o") - F.col("y_d")) * (F.col("y_o") - F.col("y_d"))
    )
    return F.when(F.col("origin") == F.col("destination"), within).otherwise(straight)


def with_distance(cells: DataFrame, zones: DataFrame, keys: Sequence[str] = AREA) -> DataFrame:
    """Distance of every stored cell from zone coordinates: two lookups, no pair table."""
    has_area = "area" in zones.columns
    start = {"x": "x_o", "y": "y_o", **({"area": "area_o"} if has_area else {})}
    placed = attach_zone(cells, zones, start, "origin", keys)
    placed = attach_zone(placed, zones, {"x": "x_d", "y": "y_d"}, "destination", keys)
    return placed.withColumn("distance", centroid_distance(has_area)).drop(
        "x_o", "y_o", "x_d", "y_d", *(["area_o"] if has_area else [])
    )


def zone_pairs(
    zones: DataFrame,
    origin_columns: dict[str, str] | None = None,
    destination_columns: dict[str, str] | None = None,
    keys: Sequence[str] = AREA,
    copies: int = 1,
) -> DataFrame:
    """All ordered zone pairs of each area with their distance: the N² table generators emit on.

    Only the zones are written; pairs are formed where they are read, by as many tasks as their number asks for. Destinations up to
    ``PAIR_BROADCAST_BYTES`` are broadcast; rows come out hash-partitioned and sorted by (area, origin), the key of every row-wise step
    that follows: none of them shuffles or sorts a pair. Above that the join is on (area, bucket), origins in buckets of about
    ``PAIR_BUCKET`` zones and a copy of the destinations in each, and the first row-wise step shuffles the pairs once more.
    ``copies`` says how many rows later steps make of a pair.
    """
    has_area = "area" in zones.columns
    start = {"x": "x_o", "y": "y_o", **({"area": "area_o"} if has_area else {}), **(origin_columns or {})}
    finish = {"x": "x_d", "y": "y_d", **(destination_columns or {})}
    zones = write_table(zones.select(*keys, "zone", *dict.fromkeys([*start, *finish])))
    origins = zones.select(*keys, F.col("zone").alias("origin"), *[F.col(c).alias(n) for c, n in start.items()])
    destinations = zones.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("zone").alias("destination"),
        *[F.col(c).alias(n) for c, n in finish.items()],
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_{k}"))
    tasks = pair_tasks(zones, keys, copies)
    if planned_small(destinations, PAIR_BROADCAST_BYTES):
        # The window sorts the origins; a sort alone would be dropped below the join.
        held = F.count("*").over(Window.partitionBy(*keys, "origin"))
        origins = dealt_by_origin(origins, tasks, keys)
        origins = origins.withColumn("_held", held).where(F.col("_held") > 0).drop("_held")
        destinations = F.broadcast(destinations)
    else:
        sizes = zones.groupBy(*keys).agg(F.ceil(F.count("*") / PAIR_BUCKET).cast("int").alias("_buckets"))
        origins = lookup_join(origins, sizes, list(keys), spread=["origin"]).withColumn("_bucket", F.pmod(F.xxhash64("origin"), F.col("_buckets")).cast("int"))
        destinations = lookup_join(destinations, sizes, {f"_{k}": k for k in keys}, spread=["destination"])
        destinations = destinations.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1))).drop("_buckets")
        condition = condition & (F.col("_bucket") == F.col("_at"))
        # The session's shuffle width would leave each task a fixed share of all pairs.
        origins = origins.repartition(tasks, *keys, "_bucket")
        destinations = destinations.repartition(tasks, *[f"_{k}" for k in keys], "_at")
    kept = [*(origin_columns or {}).values(), *(destination_columns or {}).values()]
    return origins.join(destinations, condition).select(
        *keys, "origin", "destination", centroid_distance(has_area).alias("distance"), *kept
    )


def pair_tasks(zones: DataFrame, keys: Sequence[str] = AREA, copies: int = 1) -> int:
    """Tasks of the pair table of these zones, or of one with ``copies`` rows a pair; at least the shuffle width."""
    squares = zones.groupBy(*keys).agg((F.count("*").cast("double") * F.count("*")).alias("n")).agg(F.sum("n")).first()[0] or 0.0
    return max(shuffle_width(zones.sparkSession), math.ceil(squares * copies / PAIRS_A_TASK))


def dealt_by_origin(rows: DataFrame, tasks: int, keys: Sequence[str] = AREA) -> DataFrame:
    """Rows laid out as the pair table is: a union of both keeps the layout."""
    return rows.repartition(tasks, *keys, "origin")


def with_length_band(cells: DataFrame, distance: str = "distance") -> DataFrame:
    return cells.withColumn("band", length_band(F.col(distance)))


def keep_length_band(cells: DataFrame, band: str, distance: str = "distance") -> DataFrame:
    """Zero every cell outside the band, i.e. store only the cells inside it."""
    return cells.where(in_band(F.col(distance), band))


def dissolve(cells: DataFrame, mapping: DataFrame, keys: Sequence[str], value: str = "flow", tasks: int = 0) -> DataFrame:
    """Sum flows between groups of zones; a zone without a group stands for itself.

    ``mapping`` has (zone, group) and may carry some of the keys (``study_area``, ``realisation``). ``tasks`` deals the sums wider than the session does.
    """
    shared = [k for k in keys if k in mapping.columns]
    for end, other in (("origin", "destination"), ("destination", "origin")):
        groups = mapping.select(*shared, "zone", F.col("group").alias("_group"))
        cells = lookup_join(cells, groups, {**{k: k for k in shared}, end: "zone"}, "left", spread=[other])
        cells = cells.withColumn(end, F.coalesce("_group", end)).drop("_group")
    return dealt(cells, tasks, ["origin", "destination"]).groupBy(*keys, "origin", "destination").agg(F.sum(value).alias(value))


def dissolve_zones(zones: DataFrame, mapping: DataFrame, keys: Sequence[str] = AREA) -> DataFrame:
    """The coarse zone list that goes with :func:`dissolve` (group ids only)."""
    shared = [k for k in keys if k in mapping.columns]
    groups = mapping.select(*shared, "zone", F.col("group").alias("_group"))
    mapped = lookup_join(zones.select(*keys, "zone"), groups, [*shared, "zone"], "left", spread=["zone"])
    return mapped.select(*keys, F.coalesce("_group", "zone").alias("zone")).distinct()
