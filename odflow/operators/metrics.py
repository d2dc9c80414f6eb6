"""Similarity of two aligned OD matrices ``a`` and ``b``, one row of scores per key.

Input is sparse: one row per cell with a ≠ 0 or b ≠ 0. Cells stored nowhere are zero in both and only
matter for NRMSE and JSD, which take the zone count of the area.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.functions.numeric import TINY, correlation, dice, ratio
from odflow.functions.spread import lookup_join
from odflow.operators.flows import align, spread_over, transpose
from odflow.operators.zones import with_distance

# Inner edges of the trip-length histogram (km) and number of cell-size bins.
LENGTH_EDGES = (0.5, 2.0, 10.0, 50.0)
SIZE_BINS = 20
# Order of the scores.
PAIR_SCORES = ("CPC", "CPL", "R2", "pearson_r", "NRMSE", "JSD", "CPCd")


def _sides() -> tuple[Column, Column]:
    return F.col("a"), F.col("b")


def _squares() -> Column:
    gap = F.col("a") - F.col("b")
    return F.sum(gap * gap)


def _positive(side: str) -> Column:
    return F.sum(F.when(F.col(side) > 0, F.col(side)).otherwise(0.0))


def _ones(condition: Column) -> Column:
    return F.sum(F.when(condition, 1.0).otherwise(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Common part of two matrices: 2Σmin / (Σa + Σb)."""
    return dice(F.sum(F.least(a, b)), F.sum(a), F.sum(b))


def support_overlap(a: Column, b: Column) -> Column:
    return dice(_ones((a > 0) & (b > 0)), _ones(a > 0), _ones(b > 0))


def log_correlation(a: Column, b: Column) -> Column:
    """Pearson r of log(1+a), log(1+b) over cells with a+b > 0."""
    used = a + b > 0
    x, y = F.when(used, F.log1p(a)), F.when(used, F.log1p(b))
    return correlation(F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y), F.count(x))


def cpc(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(overlap(*_sides()).alias("CPC"))


def cpl(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(support_overlap(*_sides()).alias("CPL"))


def pearson_log(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    scored = cells.groupBy(*keys).agg(log_correlation(*_sides()).alias("pearson_r"))
    return scored.withColumn("R2", F.col("pearson_r") * F.col("pearson_r"))


def length_bin(distance: Column, edges: Sequence[float] = LENGTH_EDGES) -> Column:
    """Number of inner edges at or below the distance, NULL for an unknown distance."""
    return F.when(distance.isNotNull(), reduce(add, [(distance >= edge).cast("int") for edge in edges]))


def with_length_bin(cells: DataFrame, edges: Sequence[float] = LENGTH_EDGES) -> DataFrame:
    return cells.withColumn("length_bin", length_bin(F.col("distance"), edges))


def _length_masses(side: str, bins: int) -> list[Column]:
    value, held = F.col(side), F.col("length_bin")
    return [F.sum(F.when((held == k) & (value > 0), value).otherwise(0.0)) for k in range(bins)]


def length_histogram(
    cells: DataFrame, keys: Sequence[str], edges: Sequence[float] = LENGTH_EDGES
) -> DataFrame:
    """Positive flow of both sides per trip-length bin (empty bins absent)."""
    return (
        with_length_bin(cells, edges)
        .groupBy(*keys, "length_bin")
        .agg(
            _positive("a").alias("mass_a"),
            _positive("b").alias("mass_b"),
        )
    )


def length_overlap(bins: int = len(LENGTH_EDGES) + 1) -> Column:
    """Dice overlap of the two trip-length histograms, as one aggregate over binned cells."""
    left, right = _length_masses("a", bins), _length_masses("b", bins)
    common = [F.least(x, y) for x, y in zip(left, right, strict=True)]
    return dice(reduce(add, common), _positive("a"), _positive("b"))


def cpcd(cells: DataFrame, keys: Sequence[str], edges: Sequence[float] = LENGTH_EDGES) -> DataFrame:
    return with_length_bin(cells, edges).groupBy(*keys).agg(length_overlap(len(edges) + 1).alias("CPCd"))


def _nrmse(squares: Column, total: Column, pairs: Column) -> Column:
    return F.when(total != 0, F.try_divide(F.sqrt(squares / pairs), total / pairs))


def nrmse(cells: DataFrame, keys: Sequence[str], counts: DataFrame, area: Sequence[str]) -> DataFrame:
    """Root mean square error over all zone pairs, by the mean cell of ``a``."""
    sums = cells.groupBy(*keys).agg(
        _squares().alias("_squares"), F.sum("a").alias("_total")
    )
    counted = lookup_join(sums, counts, list(area), spread=["_total"])
    pairs = F.col("n_zones").cast("double") * F.col("n_zones")
    return counted.select(*keys, _nrmse(F.col("_squares"), F.col("_total"), pairs).alias("NRMSE"))


def size_bin(value: Column, largest: Column, bins: int = SIZE_BINS) -> Column:
    """Log-spaced bin of a cell value: bin 0 below ``lo``, the largest value in the last bin.

    Negative values lie outside. When the range collapses the bins are linear.
    """
    low = F.greatest(largest / 1e6, F.lit(TINY))
    share = (F.log10(value) - F.log10(low)) / (F.log10(largest) - F.log10(low))
    log_bin = F.when(value < low, 0).otherwise(F.floor(share * (bins - 1)) + 1)
    even_bin = F.floor(F.try_divide(value, largest) * bins)
    chosen = F.when(largest > low, log_bin).otherwise(even_bin)
    return F.when(value >= 0, F.least(chosen, F.lit(bins - 1)).cast("int"))


def _size_counts(side: str, bins: int) -> Column:
    counts = ", ".join(f"cast(count_if(_bin_{side} = {k}) AS double)" for k in range(bins))
    return F.expr(f"array({counts})")


def _with_divergence(parts: DataFrame) -> DataFrame:
    """Add JSD from the bin counts ``_sizes_a``, ``_sizes_b``.

    The zone pairs stored nowhere (``_pairs`` − ``_stored``) are zero cells: they join bin 0 of both.
    """

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def toward(share: Column, other: Column) -> Column:
        middle = F.greatest((share + other) / 2, F.lit(TINY))
        return F.when(share > 0, share * F.log(share / middle)).otherwise(0.0)

    unseen = F.col("_pairs") - F.col("_stored")
    for side in ("_sizes_a", "_sizes_b"):
        parts = parts.withColumn(side, F.transform(side, lambda c, i: c + F.when(i == 0, unseen).otherwise(0.0)))
    totals = parts.withColumns({"_in_a": total(F.col("_sizes_a")), "_in_b": total(F.col("_sizes_b"))})
    shares = totals.withColumns(
        {
            "_sizes_a": F.transform("_sizes_a", lambda c: F.try_divide(c, F.col("_in_a"))),
            "_sizes_b": F.transform("_sizes_b", lambda c: F.try_divide(c, F.col("_in_b"))),
        }
    )
    terms = F.zip_with("_sizes_a", "_sizes_b", lambda p, q: (toward(p, q) + toward(q, p)) / 2)
    return shares.withColumn("JSD", F.when(F.col("_largest") > 0, total(terms)).otherwise(0.0))


def _largest(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.max(F.greatest("a", "b")).alias("_largest"))


def with_size_bins(cells: DataFrame) -> DataFrame:
    """Add the cell-size bins of both sides; ``_largest`` is the key's largest cell."""
    return cells.withColumns(
        {f"_bin_{side}": size_bin(F.col(side), F.col("_largest")) for side in ("a", "b")}
    )


def _jsd_parts(bins: int = SIZE_BINS) -> list[Column]:
    return [
        _size_counts("a", bins).alias("_sizes_a"),
        _size_counts("b", bins).alias("_sizes_b"),
        F.max("_largest").alias("_largest"),
        F.count("*").alias("_stored"),
    ]


def _with_pairs(parts: DataFrame, counts: DataFrame, area: Sequence[str]) -> DataFrame:
    """Add the number of zone pairs of the area."""
    counted = lookup_join(parts, counts, list(area), spread=["_stored"])
    return counted.withColumn("_pairs", F.col("n_zones").cast("double") * F.col("n_zones"))


def jsd(cells: DataFrame, keys: Sequence[str], counts: DataFrame, area: Sequence[str]) -> DataFrame:
    """Divergence of the two cell-size histograms over all zone pairs."""
    ranged = lookup_join(cells, _largest(cells, keys), list(keys))
    parts = with_size_bins(ranged).groupBy(*keys).agg(*_jsd_parts())
    return _with_divergence(_with_pairs(parts, counts, area)).select(*keys, "JSD")


def score_aggregates(
    cells: DataFrame,
    keys: Sequence[str],
    counts: DataFrame,
    area: Sequence[str],
    more: Sequence[Column] = (),
) -> DataFrame:
    """All pair scores in one aggregation over cells with ``_largest``, plus ``more`` aggregates."""
    with_length = "distance" in cells.columns
    binned = with_size_bins(with_length_bin(cells) if with_length else cells)
    parts = binned.groupBy(*keys).agg(
        overlap(*_sides()).alias("CPC"),
        support_overlap(*_sides()).alias("CPL"),
        log_correlation(*_sides()).alias("pearson_r"),
        _squares().alias("_squares"),
        F.sum("a").alias("_total"),
        (length_overlap() if with_length else F.lit(None).cast("double")).alias("CPCd"),
        *_jsd_parts(),
        *more,
    )
    return _with_divergence(_with_pairs(parts, counts, area)).withColumns(
        {
            "R2": F.col("pearson_r") * F.col("pearson_r"),
            "NRMSE": _nrmse(F.col("_squares"), F.col("_total"), F.col("_pairs")),
        }
    )


def score_pair(
    cells: DataFrame,
    keys: Sequence[str],
    counts: DataFrame,
    area: Sequence[str],
    zones: DataFrame | None = None,
) -> DataFrame:
    """All scores of (a, b) per key: one pass for the largest cell, one for everything else.

    CPCd needs a ``distance`` column or ``zones`` with coordinates and is NULL otherwise. ``counts``
    gives ``n_zones`` per area. Distances are added after the two passes part, so both read one
    exchange of the cells.
    """
    ranged = lookup_join(cells, _largest(cells, keys), list(keys))
    if zones is not None and {"x", "y"} <= set(zones.columns):
        ranged = with_distance(ranged, zones, area)
    return score_aggregates(ranged, keys, counts, area).select(*keys, *PAIR_SCORES)


def stack_reference(
    targets: DataFrame, reference: DataFrame, keys: Sequence[str], shared: Sequence[str]
) -> DataFrame:
    """Cells (keys, origin, destination, t, r, rt): a target, the reference and its transpose.

    The reference carries the ``shared`` keys only and is repeated for every target key.
    """
    spread = spread_over(reference.select(*shared, "origin", "destination", "flow"), targets, shared, keys)
    return align(keys, by_origin=True, t=targets, r=spread, rt=transpose(spread))


def delta_cpc(
    cells: DataFrame, keys: Sequence[str], scale: float | None = None
) -> DataFrame:
    """Overlap with the mass-scaled reference and its transpose, and their difference.

    ``cells`` come from :func:`stack_reference`. The scale is Σt / Σr unless given; without it a
    reference of no mass leaves every score NULL.
    """
    sums = cells.groupBy(*keys).agg(F.sum("t").alias("_t"), F.sum("r").alias("_r"), F.sum("rt").alias("_rt"))
    factor = ratio(F.col("_t"), F.col("_r")) if scale is None else F.lit(float(scale))
    scaled = lookup_join(cells, sums.select(*keys, factor.alias("lambda")), list(keys))
    t, r, rt = F.col("t"), F.col("lambda") * F.col("r"), F.col("lambda") * F.col("rt")
    scores = scaled.groupBy(*keys).agg(
        F.max("lambda").alias("lambda"), overlap(t, r).alias("CPC_R"), overlap(t, rt).alias("CPC_RT")
    )
    return scores.withColumn("Delta", F.col("CPC_RT") - F.col("CPC_R"))
