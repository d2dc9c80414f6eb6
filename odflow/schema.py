"""Table shapes: the flow long table and the eight report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.functions.numeric import flush_tiny, number_or_zero

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("destination", T.StringType()),
        T.StructField("flow", T.DoubleType()),
        T.StructField("partition", T.StringType()),
        T.StructField("date", T.DateType()),
    ]
)

_TEXT = ("study_area", "product", "attributes_present", "partition", "band", "target", "law_model", "scale_layer")
_WHOLE = ("N", "days")

# Column lists of the report tables.
REPORT_COLUMNS = {
    "table1_study_areas": ["study_area", "product", "N", "h_intra", "days", "attributes_present"],
    "table2_purpose_time": [
        "study_area", "partition", "lambda", "CPC_T_lambdaR", "CPC_T_lambdaRT", "Delta",
        "CPL", "CPCd", "R2", "NRMSE", "JSD",
    ],
    "table3_day_sex_age": [
        "study_area", "partition", "lambda", "CPC_T_lambdaR", "Delta",
        "CPL", "CPCd", "R2", "NRMSE", "JSD",
    ],
    "table4_length_bands": ["study_area", "band", "CPC", "CPL", "CPCd", "R2", "NRMSE", "JSD"],
    "table5_additional": [
        "study_area", "partition", "CPC", "Delta", "CPL", "CPCd", "R2", "NRMSE", "JSD",
    ],
    "table6_condition_g_blocks": [
        "study_area", "target", "law_model", "CPC", "CPL", "CPCd", "R2", "NRMSE", "JSD",
    ],
    "table7_panel_no_holdout": [
        "study_area", "target", "law_model", "CPC", "CPL", "CPCd", "R2", "NRMSE", "JSD",
    ],
    "table8_scale": ["study_area", "scale_layer", "spearman_CPC", "frac_delta_sign_kept"],
}


def conform_flows(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Check and coerce a flow table: text ids, double flow, tiny flows to zero.

    ``keys`` are further columns to keep in front (such as ``study_area``).
    """
    absent = [c for c in FLOW_SCHEMA.fieldNames() if c not in df.columns]
    if absent:
        raise ValueError(f"flow table lacks columns {absent}")
    return df.select(
        *keys,
        F.col("origin").cast("string").alias("origin"),
        F.col("destination").cast("string").alias("destination"),
        flush_tiny(number_or_zero(F.col("flow"))).alias("flow"),
        F.col("partition").cast("string").alias("partition"),
        F.col("date"),
    )


def report_schema(table: str) -> T.StructType:
    """Schema of a report table; an unknown name is a KeyError."""

    def dtype(column: str) -> T.DataType:
        if column in _TEXT:
            return T.StringType()
        return T.LongType() if column in _WHOLE else T.DoubleType()

    return T.StructType([T.StructField(c, dtype(c)) for c in REPORT_COLUMNS[table]])


def empty_report(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], report_schema(table))


def conform_report(df: DataFrame, table: str) -> DataFrame:
    """Columns of the report table in order, absent ones NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in report_schema(table).fields
        ]
    )
