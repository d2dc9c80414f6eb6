"""Steps both vendor products share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.functions.numeric import flush_tiny, number_or_zero
from odflow.operators.zones import clip_to_zones


def first_present(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The first listed name the table has; names compare without case, as Spark does."""
    have = {c.lower(): c for c in columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def rename_aliases(raw: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Give each column its standard name; a standard name already present wins over its aliases."""
    found = {target: first_present(raw.columns, (target, *names)) for target, names in aliases.items()}
    return raw.withColumnsRenamed({v: k for k, v in found.items() if v is not None and v != k})


def require(raw: DataFrame, *names: str) -> None:
    absent = [n for n in names if first_present(raw.columns, (n,)) is None]
    if absent:
        raise KeyError(f"raw table lacks {absent}")


def sum_by_pair(
    flows: DataFrame, zones: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Sum trips per pair, partition and date (NULL dates form a group), then clip to the zones.

    Summing first lets map-side aggregation shrink the trips before any exchange.
    """
    summed = (
        flows.withColumn("flow", flush_tiny(number_or_zero(F.col("flow"))))
        .groupBy(*keys, "origin", "destination", "partition", "date")
        .agg(flush_tiny(F.sum("flow")).alias("flow"))
        .select(*keys, "origin", "destination", "flow", "partition", "date")
    )
    return summed if zones is None else clip_to_zones(summed, zones, keys)
