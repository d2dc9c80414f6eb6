"""Row normalisation, production-constrained emission and its check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.functions.spread import lookup_join
from odflow.operators.zones import AREA
from odflow.session import write_table

# Tolerance of the row-sum check.
ROW_TOLERANCE = 1e-6


def per_origin(rows: DataFrame, keys: Sequence[str], *values: Column) -> DataFrame:
    """``rows`` with aggregates over the rows of their origin.

    One aggregation and a lookup of its N rows, instead of a window, which would sort and buffer all pairs. ``rows`` are read twice: write
    them first where that costs more than to form them.
    """
    at = [*keys, "origin"]
    return lookup_join(rows, write_table(rows.groupBy(*at).agg(*values)), at, "left", spread=["destination"])


def row_shares(weights: DataFrame, keys: Sequence[str], value: str = "w", name: str = "p") -> DataFrame:
    """p(j|i) = w / Σ_j w; a row without weight stays zero."""
    summed = per_origin(weights, keys, F.sum(value).alias("_whole"))
    share = F.when(F.col("_whole") > 0, F.try_divide(F.col(value), F.col("_whole")))
    return summed.withColumn(name, F.coalesce(share, F.lit(0.0))).drop("_whole", *({value} - {name}))


def row_softmax(scores: DataFrame, keys: Sequence[str], value: str = "score", name: str = "p") -> DataFrame:
    """exp(score − row maximum), normalised per origin."""
    raised = per_origin(scores, keys, F.max(value).alias("_top")).withColumn("_e", F.exp(F.col(value) - F.col("_top")))
    return row_shares(raised.drop("_top", *({value} - {name})), keys, "_e", name)


def emit(
    probabilities: DataFrame, outflows: DataFrame, keys: Sequence[str], area: Sequence[str] = AREA
) -> DataFrame:
    """Flow = outflow of the origin × its renormalised destination probability.

    ``outflows`` has (area, …, origin, out_sum) and may add keys such as the target partition; the
    result carries both sets. The outflows are looked up per origin.
    """
    shared = [k for k in keys if k in outflows.columns and k in probabilities.columns]
    own = [k for k in keys if k in probabilities.columns]
    shares = row_shares(probabilities, own, "p", "p")
    return lookup_join(shares, outflows, [*shared, "origin"], spread=["destination"]).select(
        *keys,
        "origin",
        "destination",
        (F.col("out_sum") * F.col("p")).alias("flow"),
        *[c for c in ("distance",) if c in probabilities.columns],
    )


def row_violations(
    emitted: DataFrame, outflows: DataFrame, keys: Sequence[str], tolerance: float = ROW_TOLERANCE
) -> DataFrame:
    """Origins whose emitted flow differs from the outflow by more than tol + tol·outflow."""
    stacked = emitted.select(*keys, "origin", "flow", F.lit(0.0).alias("wanted")).unionByName(
        outflows.select(*keys, "origin", F.lit(0.0).alias("flow"), F.col("out_sum").alias("wanted"))
    )
    sums = stacked.groupBy(*keys, "origin").agg(
        F.sum("flow").alias("row_sum"), F.sum("wanted").alias("out_sum")
    )
    return sums.where(_off(F.col("row_sum"), F.col("out_sum"), tolerance))


def _off(row: Column, wanted: Column, tolerance: float) -> Column:
    return F.abs(row - wanted) > tolerance + tolerance * F.abs(wanted)


def assert_row_sums(
    emitted: DataFrame, outflows: DataFrame, keys: Sequence[str], tolerance: float = ROW_TOLERANCE
) -> None:
    """Fail when any origin's emitted flow misses its outflow."""
    worst = (
        row_violations(emitted, outflows, keys, tolerance)
        .agg(F.max(F.abs(F.col("row_sum") - F.col("out_sum"))).alias("gap"))
        .first()
    )
    if worst.gap is not None:
        raise AssertionError(f"emitted row sums miss the outflows by up to {worst.gap}")
