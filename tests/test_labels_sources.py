from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from odflow.functions import labels
from odflow.operators.zones import clip_to_zones
from odflow.schema import (
    REPORT_COLUMNS,
    conform_flows,
    conform_report,
    empty_report,
    report_schema,
)
from odflow.sources import files, product_a, product_b


def values(spark, items, ddl, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {ddl}")
    return [r.out for r in frame.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_activity_words(spark):
    words = ["casa", " Trabajo_Estudio ", "FRECUENTE", "no_frecuente", "Shop", "home"]
    assert values(spark, words, "string", labels.activity) == [
        "home", "work_or_study", "frequent_activity", "infrequent_activity", "shop", "home",
    ]


def test_coarse_purpose_does_not_trim(spark):
    words = ["Casa", "lavoro", " home", "frecuente", None]
    assert values(spark, words, "string", labels.coarse_purpose) == ["home", "work", "other", "other", "other"]


def test_period_bins_and_gaps(spark):
    hours = [0, 6, 7, 9, 10, 15, 16, 19, 20, 23, 24, -1]
    assert values(spark, hours, "int", labels.period) == [
        "overnight", "overnight", "AM", "AM", "interpeak", "interpeak", "PM", "PM", "night", "night",
        "interpeak", "interpeak",
    ]
    own = values(spark, [5, 8], "int", lambda c: labels.period(c, {"early": (4, 5)}))
    assert own == ["early", "interpeak"]


def test_length_bands_are_half_open(spark):
    d = [0.4, 0.5, 1.99, 2.0, 10.0, 49.9, 50.0, 900.0]
    assert values(spark, d, "double", labels.length_band) == [
        None, "0.5-2", "0.5-2", "2-10", "10-50", "10-50", ">50", ">50",
    ]
    with pytest.raises(ValueError):
        labels.in_band(F.lit(1.0), "1-2")


def test_study_flag(spark):
    flags = ["1", "TRUE", "t", "Yes", "no", "0", None, "1.0", "2"]
    assert values(spark, flags, "string", labels.is_flagged) == [
        True, True, True, True, False, False, False, True, False,
    ]


def test_days_in_every_spelling(spark):
    parsed = values(
        spark, ["20240105", "2024-01-06", "x", None], "string",
        lambda c: labels.calendar_day(c, spark.createDataFrame([], "v string").schema["v"].dataType),
    )
    assert parsed == [dt.date(2024, 1, 5), dt.date(2024, 1, 6), None, None]
    whole = spark.createDataFrame([(20240107,)], "v int")
    assert whole.select(labels.calendar_day(F.col("v"), whole.schema["v"].dataType)).first()[0] == dt.date(2024, 1, 7)


RAW_A = [
    # origen, destino, date, hora, from, to, study, trips
    ("1", "2", "20240108", 7, "casa", "trabajo_estudio", "0", "2.5"),
    ("1", "2", "20240108", 8, " Home", "work_or_study", None, "1.5"),
    ("1", "2", "20240108", 8, "casa", "trabajo_estudio", "true", "4"),
    ("1", "2", "20240106", 8, "casa", "trabajo_estudio", "0", "8"),  # Saturday
    ("1", "2", "20240108", 10, "casa", "trabajo_estudio", "0", "16"),  # not morning
    ("1", "2", "20240108", 9, "casa", "frecuente", "0", "32"),  # not work
    ("1", "9", "20240108", 9, "casa", "trabajo_estudio", "0", "bad"),
    ("3", "1", "20240109", 9, "casa", "trabajo_estudio", "no", "0.0000001"),
]
DDL_A = (
    "origen string, destino string, date string, hora int, actividad_origen string, "
    "actividad_destino string, estudio_destino_posible string, n_trips string"
)


def test_reference_of_product_a(spark):
    raw = spark.createDataFrame(RAW_A, DDL_A)
    rows = {(r.origin, r.destination, r.partition): r for r in product_a.reference_flows(raw).collect()}
    assert {k: r.flow for k, r in rows.items()} == {
        ("1", "2", "R_HBW_AM"): 4.0, ("1", "2", "study_AM"): 4.0,
        ("1", "9", "R_HBW_AM"): 0.0, ("3", "1", "R_HBW_AM"): 0.0,
    }
    assert rows["1", "2", "R_HBW_AM"].date == dt.date(2024, 1, 8)
    zones = spark.createDataFrame([("1",), ("2",)], "zone string")
    assert product_a.reference_flows(raw, zones=zones).count() == 2
    weekend = product_a.reference_flows(raw, weekdays_only=False)
    assert weekend.where("date = '2024-01-06'").first().flow == 8.0


def test_reference_a_needs_its_columns(spark):
    raw = spark.createDataFrame(RAW_A, DDL_A)
    for column in ("hora", "actividad_origen", "n_trips"):
        with pytest.raises(KeyError):
            product_a.reference_flows(raw.drop(column))
    assert product_a.reference_flows(raw.drop("estudio_destino_posible")).where("partition = 'study_AM'").isEmpty()


def test_standard_name_beats_alias(spark):
    raw = spark.createDataFrame([("a", "b", "c", 1.0)], "origin string, origen string, destino string, n_trips double")
    row = product_a.to_flows(raw, "p").first()
    assert (row.origin, row.destination, row.date) == ("a", "c", None)


def test_cuts_share_one_scan(spark):
    raw = spark.createDataFrame(RAW_A, DDL_A)
    day = F.when(labels.is_weekday(labels.calendar_day(F.col("date"), raw.schema["date"].dataType)), "weekday")
    cuts = product_a.cut_flows(raw, {"pt": product_a.purpose_time_label(), "day": day})
    sums = {r.partition: r.f for r in cuts.groupBy("partition").agg(F.sum("flow").alias("f")).collect()}
    assert sums == {"work|AM": 16.0, "work|interpeak": 16.0, "other|AM": 32.0, "weekday": 56.0}


def test_product_b(spark):
    rows = [
        ("1", "2", "Lavoro", "Mattina", 1.0), ("1", "2", "lavoro", "17-20", 2.0), ("1", "2", "work", "sera", 4.0),
        ("1", "2", "Studio", "sera", 8.0), ("2", "2", "rientri a casa", "Mattina", 16.0),
    ]
    raw = spark.createDataFrame(rows, "ORIGINE string, DESTINAZIONE string, MOTIVO string, FASCIA_ORARIA string, TRIPS double")
    loose = {r.partition: (r.flow, r.date) for r in product_b.reference_flows(raw).collect()}
    assert loose == {"R_HBW_AM": (3.0, None), "study_heldout": (8.0, None)}
    strict = {r.partition: r.flow for r in product_b.reference_flows(raw, strict=True).collect()}
    assert strict == {"R_HBW_AM": 1.0, "study_heldout": 8.0}
    named = raw.withColumnsRenamed({"MOTIVO": "why", "FASCIA_ORARIA": "when"})
    other = {r.partition: (r.flow, r.date) for r in product_b.reference_flows(named, motive_col="why", time_col="when").collect()}
    assert other == loose
    assert {r.partition: (r.flow, r.date) for r in product_b.reference_flows(raw, motive_col="absent", time_col="absent").collect()} == loose
    always = {r.partition: r.flow for r in product_b.reference_flows(raw.drop("FASCIA_ORARIA")).collect()}
    assert always == {"R_HBW_AM": 7.0, "study_heldout": 8.0}
    with pytest.raises(KeyError):
        product_b.to_flows(raw.drop("TRIPS"), "p")


def test_flow_schema(spark):
    rows = [("a", 1, "2.5", "p"), ("b", 2, "x", "p"), ("c", 3, "nan", "p"), ("d", 4, "-3", "p"), ("e", 5, "5e-7", "p"), (None, 6, None, "p")]
    raw = spark.createDataFrame(rows, "origin string, destination int, flow string, partition string").withColumn("date", F.lit(None).cast("date"))
    out = conform_flows(raw)
    assert out.columns == ["origin", "destination", "flow", "partition", "date"]
    assert [r.flow for r in out.orderBy("destination").collect()] == [2.5, 0.0, 0.0, -3.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        conform_flows(raw.drop("date"))


def test_clip_keeps_pairs_inside_their_own_area(spark):
    flows = spark.createDataFrame(
        [("x", "1", "2", 1.0), ("x", "1", "3", 1.0), ("y", "1", "2", 1.0), ("x", None, "2", 1.0)],
        "study_area string, origin string, destination string, flow double",
    )
    zones = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "study_area string, zone string")
    kept = clip_to_zones(flows, zones).collect()
    assert [(r.study_area, r.origin, r.destination) for r in kept] == [("x", "1", "2")]


def test_file_round_trips(spark, tmp_path):
    rows = [("A", "p", "1", "2", 3.0), ("A", "q", "1", "1", 4.0), ("B", "p", "2", "1", 5.0)]
    flows = spark.createDataFrame(rows, "study_area string, partition string, origin string, destination string, flow double")
    files.write_partitions(flows, str(tmp_path / "parts"))
    back = files.read_partitions(spark, str(tmp_path / "parts"))
    assert back.where("study_area = 'A' AND partition = 'q'").first().flow == 4.0
    assert "PartitionFilters: [isnotnull(partition" in back.where("partition = 'q'")._jdf.queryExecution().toString()
    assert back.count() == 3
    for fmt in ("csv", "parquet"):
        files.write_scores(flows, str(tmp_path / f"scores.{fmt}"), fmt)
        assert files.read_raw(spark, str(tmp_path / f"scores.{fmt}")).count() == 3
    with pytest.raises(ValueError):
        files.write_scores(flows, str(tmp_path / "x"), "xml")
    (tmp_path / "adj.json").write_text(json.dumps({"0": ["1"], "1": ["0", "2"]}, indent=1))
    edges = files.read_adjacency(spark, str(tmp_path / "adj.json"), "A")
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("0", "1"), ("1", "0"), ("1", "2")]
    (tmp_path / "map.json").write_text(json.dumps({"0": "g", "1": "g"}))
    assert {r.zone: r.group for r in files.read_mapping(spark, str(tmp_path / "map.json"), "A").collect()} == {"0": "g", "1": "g"}
    (tmp_path / "blocks.json").write_text(json.dumps({"n": 3, "blocks": [["0", "2"], ["1"]]}))
    blocks = files.read_blocks(spark, str(tmp_path / "blocks.json"), "A")
    assert sorted((r.zone, r.block) for r in blocks.collect()) == [("0", 0), ("1", 1), ("2", 0)]


def test_objects_by_line_and_by_file(spark, tmp_path):
    folder = tmp_path / "adj [1] a"
    folder.mkdir()
    (folder / "lines.json").write_text('{"0": ["1"]}\n\n{"1": ["0", "2"]}\n{"2": ["1"]}\n')
    (folder / "whole b.json").write_text(json.dumps({"7": ["8"], "8": ["7"]}, indent=1))
    edges = files.read_adjacency(spark, str(tmp_path / "adj*"), "A")
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("0", "1"), ("1", "0"), ("1", "2"), ("2", "1"), ("7", "8"), ("8", "7")]
    (tmp_path / "map.json").write_text('{"0": "g"}\n{"1": "h"}\n')
    assert {r.zone: r.group for r in files.read_mapping(spark, str(tmp_path / "map.json"), "A").collect()} == {"0": "g", "1": "h"}
    (tmp_path / "broken.json").write_text('{"0": ["1"]}\n{"1": ["0"]\n')
    (tmp_path / "two.json").write_text('{"0": ["1"]} {"1": ["0"]}\n')
    for name in ("broken", "two"):
        with pytest.raises(Exception, match="not one JSON object"):
            files.read_adjacency(spark, str(tmp_path / f"{name}.json"), "A").collect()
    (tmp_path / "blocks.json").write_text('{"blocks": [["0"]]}\n{"blocks": [["1"]]}\n')
    with pytest.raises(Exception, match="not one JSON object"):
        files.read_blocks(spark, str(tmp_path / "blocks.json"), "A").collect()


def test_report_tables(spark):
    assert len(REPORT_COLUMNS) == 8
    for name in REPORT_COLUMNS:
        assert empty_report(spark, name).columns == REPORT_COLUMNS[name]
    with pytest.raises(KeyError):
        report_schema("table9")
    scores = spark.createDataFrame([("A", 0.5)], "study_area string, CPC double")
    row = conform_report(scores, "table4_length_bands").first()
    assert row.CPC == 0.5 and row.band is None
