"""Vendor product B: trips by motive and time band, without a calendar date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.operators.zones import clip_to_zones
from odflow.schema import conform_flows
from odflow.sources.common import first_present, rename_aliases, require, sum_by_pair

# Column names of the product, by standard name.
COLUMN_ALIASES = {
    "origin": ("ORIGINE", "origin_id"),
    "destination": ("DESTINAZIONE",),
    "motive": ("MOTIVO",),
    "time_band": ("FASCIA_ORARIA",),
}
# Flow columns in order of preference after "flow".
FLOW_COLUMNS = ("TRIPS", "n_trips", "VALORE", "flow")
# Motives, morning bands and the loose morning pattern.
WORK_MOTIVES = ("lavoro", "work")
STUDY_MOTIVES = ("studio", "study")
MORNING_BANDS = ("mattina", "am", "7-10", "07-10")
MORNING_PATTERN = "matt|am|07|7-"
# Partition names.
REFERENCE, STUDY = "R_HBW_AM", "study_heldout"


def standard_columns(raw: DataFrame) -> DataFrame:
    return rename_aliases(raw, COLUMN_ALIASES)


def is_morning(band: Column, bands: Sequence[str] = MORNING_BANDS, strict: bool = False) -> Column:
    """Band is a listed morning band, or (unless strict) looks like one."""
    word = F.lower(band.cast("string"))
    listed = word.isin(*[b.lower() for b in bands])
    return F.coalesce(listed if strict else listed | word.rlike(MORNING_PATTERN), F.lit(False))


def has_motive(motive: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(motive.cast("string")).isin(*words), F.lit(False))


def to_flows(
    raw: DataFrame,
    partition: str | Column,
    zones: DataFrame | None = None,
    flow_col: str = "flow",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Project vendor rows onto the flow table; the date is always NULL."""
    table = standard_columns(raw)
    trips = first_present(table.columns, (flow_col, *FLOW_COLUMNS))
    if trips is None:
        raise KeyError(f"raw table has no flow column out of {(flow_col, *FLOW_COLUMNS)}")
    named = F.lit(partition) if isinstance(partition, str) else partition
    flows = conform_flows(
        table.select(
            *keys, "origin", "destination", F.col(trips).alias("flow"),
            named.alias("partition"), F.lit(None).cast("date").alias("date"),
        ),
        keys,
    )
    return flows if zones is None else clip_to_zones(flows, zones, keys)


def reference_flows(
    raw: DataFrame,
    bands: Sequence[str] = MORNING_BANDS,
    strict: bool = False,
    zones: DataFrame | None = None,
    keys: Sequence[str] = (),
    motive_col: str = "motive",
    time_col: str = "time_band",
) -> DataFrame:
    """Morning work flows, and study flows of any hour as a held-out partition.

    ``motive_col`` and ``time_col`` name other columns to read motive and band from; one that is not there gives way to the usual column.
    """
    table = standard_columns(raw)
    motive_col = motive_col if motive_col in table.columns else "motive"
    time_col = time_col if time_col in table.columns else "time_band"
    require(table, motive_col)
    morning = is_morning(F.col(time_col), bands, strict) if time_col in table.columns else F.lit(True)
    label = F.when(has_motive(F.col(motive_col), WORK_MOTIVES) & morning, REFERENCE).when(
        has_motive(F.col(motive_col), STUDY_MOTIVES), STUDY
    )
    labelled = table.withColumn("_label", label).where(F.col("_label").isNotNull())
    return sum_by_pair(to_flows(labelled, F.col("_label"), keys=keys), zones, keys)
