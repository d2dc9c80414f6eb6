"""Vendor product A: hourly trips with activities at both ends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.functions import labels
from odflow.operators.zones import clip_to_zones
from odflow.schema import conform_flows
from odflow.sources.common import rename_aliases, require, sum_by_pair

# Column names of the product, by standard name.
COLUMN_ALIASES = {
    "origin": ("origen", "origin_id"),
    "destination": ("destino", "destination_id"),
    "hour": ("hora",),
    "activity_origin": ("actividad_origen",),
    "activity_destination": ("actividad_destino",),
}
# Flow and study-flag columns, morning hours and partition names.
FLOW_COLUMN = "n_trips"
STUDY_COLUMN = "estudio_destino_posible"
MORNING_HOURS = (7, 8, 9)
REFERENCE, STUDY = "R_HBW_AM", "study_AM"


def standard_columns(raw: DataFrame) -> DataFrame:
    return rename_aliases(raw, COLUMN_ALIASES)


def to_flows(
    raw: DataFrame,
    partition: str | Column,
    zones: DataFrame | None = None,
    flow_col: str = FLOW_COLUMN,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Project vendor rows onto the flow table under one partition name."""
    table = standard_columns(raw)
    require(table, flow_col)
    day = (
        labels.calendar_day(F.col("date"), table.schema["date"].dataType)
        if "date" in table.columns
        else F.lit(None).cast("date")
    )
    named = F.lit(partition) if isinstance(partition, str) else partition
    flows = conform_flows(
        table.select(
            *keys, "origin", "destination", F.col(flow_col).alias("flow"),
            named.alias("partition"), day.alias("date"),
        ),
        keys,
    )
    return flows if zones is None else clip_to_zones(flows, zones, keys)


def morning_weekdays(
    raw: DataFrame, hours: Sequence[int] = MORNING_HOURS, weekdays_only: bool = True
) -> DataFrame:
    """Rows of the morning hours, Monday to Friday."""
    table = standard_columns(raw)
    require(table, "hour")
    kept = table.where(labels.hour_in(F.col("hour"), table.schema["hour"].dataType, hours))
    if weekdays_only and "date" in table.columns:
        day = labels.calendar_day(F.col("date"), table.schema["date"].dataType)
        kept = kept.where(labels.is_weekday(day))
    return kept


def reference_flows(
    raw: DataFrame,
    hours: Sequence[int] = MORNING_HOURS,
    weekdays_only: bool = True,
    zones: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Morning home-to-work flows; possible study trips form a partition of their own.

    One pass: the study flag picks the partition name instead of splitting the table in two.
    """
    table = morning_weekdays(raw, hours, weekdays_only)
    require(table, "activity_origin", "activity_destination")
    commutes = table.where(
        (labels.activity(F.col("activity_origin")) == "home")
        & (labels.activity(F.col("activity_destination")) == "work_or_study")
    )
    study = (
        labels.is_flagged(F.col(STUDY_COLUMN)) if STUDY_COLUMN in table.columns else F.lit(False)
    )
    return sum_by_pair(to_flows(commutes, F.when(study, STUDY).otherwise(REFERENCE), keys=keys), zones, keys)


def cut_flows(
    raw: DataFrame,
    cuts: Mapping[str, Column] | None = None,
    zones: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Flows cut by attribute labels, all cuts in one scan.

    ``cuts`` maps a cut name to a label expression over the standard columns; rows whose label is
    NULL do not belong to that cut. Default: destination purpose × period.
    """
    table = standard_columns(raw)
    named = cuts or {"purpose_time": purpose_time_label()}
    stacked = table.withColumn("_label", F.explode(F.array(*named.values()))).where(
        F.col("_label").isNotNull()
    )
    return sum_by_pair(to_flows(stacked, F.col("_label"), keys=keys), zones, keys)


def purpose_time_label(hours: Mapping[str, Sequence[int]] | None = None) -> Column:
    return labels.purpose_period(
        labels.coarse_purpose(labels.activity(F.col("activity_destination"))),
        labels.period(F.col("hour"), hours),
    )
