"""Flow tables as sparse OD matrices: building, densifying, margins, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.functions.numeric import ratio
from odflow.functions.spread import lookup_join
from odflow.operators.zones import AREA, clip_to_zones, dealt_by_origin, pair_tasks, zone_pairs
from odflow.session import write_table


def only_partition(flows: DataFrame, partition: str) -> DataFrame:
    return flows.where(F.col("partition") == partition)


def od_matrix(
    flows: DataFrame,
    keys: Sequence[str],
    zones: DataFrame | None = None,
    partition: str | None = None,
    date: object | None = None,
) -> DataFrame:
    """Flow per (keys, origin, destination), sparse: an absent cell is zero.

    Trips are summed before the zone clip, so the clip meets one row per cell.
    """
    if partition is not None:
        flows = only_partition(flows, partition)
    if date is not None:
        flows = flows.where(F.col("date") == F.lit(date).cast("date"))
    cells = flows.groupBy(*keys, "origin", "destination").agg(F.sum("flow").alias("flow"))
    return cells if zones is None else clip_to_zones(cells, zones, keys)


def densify(
    cells: DataFrame, zones: DataFrame, keys: Sequence[str], area: Sequence[str] = AREA,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Every zone pair of every key, absent cells as 0.

    ``targets`` lists the keys to fill (default: those with a stored cell). The cells are dealt as the pairs lie, so that only they are shuffled.
    """
    wanted = write_table(cells.select(*keys).distinct() if targets is None else targets.select(*keys).distinct())
    zones = write_table(zones.select(*area, "zone", *[c for c in ("x", "y", "area") if c in zones.columns]))
    copies = wanted.groupBy(*area).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    universe = lookup_join(zone_pairs(zones, keys=area, copies=copies).select(*area, "origin", "destination"), wanted, list(area))
    blank = universe.select(*keys, "origin", "destination", F.lit(0.0).alias("flow"))
    stored = dealt_by_origin(cells.select(*keys, "origin", "destination", "flow"), pair_tasks(zones, area, copies), area)
    return (
        blank.unionByName(stored)
        .groupBy(*keys, "origin", "destination")
        .agg(F.sum("flow").alias("flow"))
    )


def matrix_to_flows(cells: DataFrame, keys: Sequence[str], drop_zeros: bool = False) -> DataFrame:
    """Matrix cells back to the flow table; a repeated cell fails the job."""
    once = cells.groupBy(*keys, "origin", "destination").agg(
        F.when(F.count("*") > 1, F.raise_error(F.lit("matrix cell given more than once")).cast("double"))
        .otherwise(F.max("flow"))
        .alias("flow")
    )
    named = once.select(
        *[k for k in keys if k not in ("partition", "date")], "origin", "destination", "flow",
        F.col("partition") if "partition" in keys else F.lit(None).cast("string").alias("partition"),
        F.col("date") if "date" in keys else F.lit(None).cast("date").alias("date"),
    )
    return named.where(F.col("flow") != 0) if drop_zeros else named


def transpose(cells: DataFrame) -> DataFrame:
    swapped = {"origin": "destination", "destination": "origin"}
    return cells.select(*[F.col(swapped.get(c, c)).alias(c) for c in cells.columns])


def totals(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum("flow").alias("total"))


def row_sums(cells: DataFrame, keys: Sequence[str], name: str = "out_sum") -> DataFrame:
    return cells.groupBy(*keys, "origin").agg(F.sum("flow").alias(name))


def column_sums(cells: DataFrame, keys: Sequence[str], name: str = "in_sum") -> DataFrame:
    return cells.groupBy(*keys, "destination").agg(F.sum("flow").alias(name))


def margins(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both margins in one aggregation: (keys, zone, out_sum, in_sum)."""
    ends = F.array(
        F.struct(F.col("origin").alias("zone"), F.col("flow").alias("out"), F.lit(0.0).alias("in")),
        F.struct(F.col("destination").alias("zone"), F.lit(0.0).alias("out"), F.col("flow").alias("in")),
    )
    return (
        cells.select(*keys, F.explode(ends).alias("end"))
        .groupBy(*keys, F.col("end.zone").alias("zone"))
        .agg(F.sum("end.out").alias("out_sum"), F.sum("end.in").alias("in_sum"))
    )


def on_diagonal(value: Column) -> Column:
    return F.when(F.col("origin") == F.col("destination"), value).otherwise(0.0)


def intra_share(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of flow inside zones, NULL when the total is not positive."""
    return cells.groupBy(*keys).agg(
        ratio(F.sum(on_diagonal(F.col("flow"))), F.sum("flow")).alias("h_intra")
    )


def zone_counts(zones: DataFrame, area: Sequence[str] = AREA) -> DataFrame:
    return zones.groupBy(*area).agg(F.countDistinct("zone").alias("n_zones"))


def inclusion(
    cells: DataFrame, zones: DataFrame, area: Sequence[str] = AREA, min_zones: int = 25, max_share: float = 0.70
) -> DataFrame:
    """Whether an area is large enough and not dominated by flows inside zones."""
    share = intra_share(cells, area)
    joined = lookup_join(zone_counts(zones, area), share, list(area), "left", spread=["n_zones"])
    fits = (F.col("n_zones") >= min_zones) & (F.col("h_intra") <= max_share)
    return joined.withColumn("included", F.coalesce(fits, F.lit(False)))


def spread_over(
    cells: DataFrame, wanted: DataFrame, shared: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Repeat each cell for every wanted key that agrees on ``shared``.

    The keys are written: a few rows, which the planner would size as the table they come from, and shuffle the cells to.
    """
    have = [c for c in cells.columns if c not in keys]
    listed = write_table(wanted.select(*keys).distinct())
    return lookup_join(cells.select(*shared, *have), listed, list(shared)).select(*keys, *have)


def align(keys: Sequence[str], carry: Sequence[str] = (), by_origin: bool = False, **sides: DataFrame) -> DataFrame:
    """One row per cell with a column per side, absent cells 0.

    Sides are stacked and folded in one aggregation, instead of chaining outer joins. ``carry`` are
    columns that depend on the pair only, such as the distance; sides without them give NULL. ``by_origin`` deals the one
    shuffle by (keys, origin), so that later sums by origin are nearly done on the map side.
    """
    names = list(sides)
    stacked = None
    for name, cells in sides.items():
        tagged = cells.select(
            *keys, "origin", "destination",
            *[(F.col("flow") if n == name else F.lit(0.0)).cast("double").alias(n) for n in names],
            *[(F.col(c) if c in cells.columns else F.lit(None).cast("double")).alias(c) for c in carry],
        )
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    if by_origin:
        stacked = stacked.repartition(*keys, "origin")
    return stacked.groupBy(*keys, "origin", "destination").agg(
        *[F.sum(n).alias(n) for n in names], *[F.max(c).alias(c) for c in carry]
    )


def independence(cells: DataFrame, keys: Sequence[str], zones: DataFrame, area: Sequence[str] = AREA) -> DataFrame:
    """Product of the margins over the total for every zone pair; zeros when the total is not positive."""
    whole = totals(cells, keys)
    outs = lookup_join(row_sums(cells, keys), whole, list(keys), spread=["origin"])
    universe = densify(cells, zones, keys, area).drop("flow")
    joined = lookup_join(universe, outs, [*keys, "origin"], "left", spread=["destination"])
    joined = lookup_join(joined, column_sums(cells, keys), [*keys, "destination"], "left", spread=["origin"])
    product = F.when(F.col("total") > 0, F.try_divide(F.col("out_sum") * F.col("in_sum"), F.col("total")))
    return joined.select(*keys, "origin", "destination", F.coalesce(product, F.lit(0.0)).alias("flow"))
