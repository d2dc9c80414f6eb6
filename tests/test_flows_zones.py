from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import LINE_T, dense, gravity_field
from odflow.catalog import views
from odflow.catalog.queries import QUERIES
from odflow.operators import flows, zones as zone_ops
from odflow.operators.generators import emission

AREA = ["study_area"]


def test_distance_within_a_zone(spark):
    frame = spark.createDataFrame([(4.0,), (0.0,), (100.0,)], "area double")
    radius = [r[0] for r in frame.select(zone_ops.intra_zonal_distance(F.col("area"))).collect()]
    assert [np.pi * r * r for r in radius] == pytest.approx([4.0, 0.0, 100.0])
    bad = spark.createDataFrame([(-1.0,)], "area double")
    with pytest.raises(PySparkException):
        bad.select(zone_ops.intra_zonal_distance(F.col("area"))).collect()


def test_inclusion_by_size_and_mixing(spark, cells_of, zones_of):
    trips = gravity_field(26, 1)[1]
    zones = zones_of({"mixed": (range(26),) * 5, "inward": (range(26),) * 5, "few": (range(24),) * 5, "silent": (range(4),) * 5})
    cells = cells_of({("mixed",): trips, ("inward",): np.diag(trips.sum(axis=1)), ("few",): trips[:24, :24]})
    found = {r.study_area: r for r in flows.inclusion(cells, zones).collect()}
    assert found["mixed"].included and found["mixed"].n_zones == 26
    assert found["mixed"].h_intra == pytest.approx(np.trace(trips) / trips.sum())
    assert not found["inward"].included and found["inward"].h_intra == 1
    assert not found["few"].included and found["few"].n_zones == 24
    assert not found["silent"].included and found["silent"].h_intra is None


def test_pairs_of_two_areas(zones_of):
    _, _, d, xy, m = gravity_field(7)
    zones = zones_of({"a": (xy[:, 0], xy[:, 1], np.ones(7), m, m), "b": ([0, 3], [0, 4], [1, 1], [1, 1], [1, 1])})
    rows = zone_ops.zone_pairs(zones).collect()
    assert len(rows) == 49 + 4
    assert dense(rows, 7, "distance", study_area="a") == pytest.approx(d)
    assert dense(rows, 2, "distance", study_area="b")[0, 1] == 5


def test_many_pair_buckets_still_give_every_pair_once(zones_of, monkeypatch):
    monkeypatch.setattr(zone_ops, "PAIR_BUCKET", 3)
    zones = zones_of({"a": (range(20),) * 5})
    pairs = zone_ops.zone_pairs(zones).select("origin", "destination")
    assert pairs.count() == 400 and pairs.distinct().count() == 400


def test_pair_tasks_above_the_broadcast_threshold(spark, zones_of, monkeypatch):
    """A zone list above the session's threshold is broadcast still; where nothing may be, no task holds a fixed share of all pairs."""
    monkeypatch.setattr(zone_ops, "PAIR_BUCKET", 3)
    monkeypatch.setattr(zone_ops, "PAIRS_A_TASK", 20)
    zones, name = zones_of({"a": (range(20),) * 5}), "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(name)
    try:
        spark.conf.set(name, "100")
        pairs = zone_ops.zone_pairs(zones)
        assert "_bucket" not in pairs._jdf.queryExecution().optimizedPlan().toString() and pairs.count() == 400
        spark.conf.set(name, "-1")
        pairs = zone_ops.zone_pairs(zones)
        found = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert "_bucket" in pairs._jdf.queryExecution().optimizedPlan().toString()
        assert sum(found) == 400 == pairs.select("origin", "destination").distinct().count() and max(found) < 200
    finally:
        spark.conf.set(name, threshold)


def test_distance_without_areas_is_zero_inside(zones_of, cells_of):
    zones = zones_of({"a": ([0, 3], [0, 4], [1, 1], [1, 1], [1, 1])}).drop("area")
    rows = zone_ops.with_distance(cells_of({("a",): np.ones((2, 2))}), zones).collect()
    assert dense(rows, 2, "distance").tolist() == [[0, 5], [5, 0]]


def test_sparse_and_dense_matrix(spark, zones_of):
    rows = [("a", "0", "1", 1.0, "p"), ("a", "0", "1", 2.0, "p"), ("a", "9", "1", 5.0, "p"), ("a", "1", "1", 4.0, "q")]
    long = spark.createDataFrame(rows, "study_area string, origin string, destination string, flow double, partition string")
    zones = zones_of({"a": (range(3),) * 5})
    keys = ["study_area", "partition"]
    cells = flows.od_matrix(long, keys, zones)
    assert {(r.partition, r.origin, r.destination): r.flow for r in cells.collect()} == {("p", "0", "1"): 3.0, ("q", "1", "1"): 4.0}
    full = flows.densify(cells, zones, keys)
    assert full.count() == 18
    assert flows.matrix_to_flows(full, keys, drop_zeros=True).count() == 2
    assert flows.matrix_to_flows(full, keys).columns == ["study_area", "origin", "destination", "flow", "partition", "date"]
    assert flows.od_matrix(long, AREA, zones, partition="q").count() == 1
    with pytest.raises(PySparkException):
        flows.matrix_to_flows(full.unionByName(full), keys).collect()


def test_one_day_of_a_stack(spark):
    long = spark.createDataFrame([("a", "0", "1", 1.0, "2024-01-01"), ("a", "0", "1", 2.0, "2024-01-02")], "study_area string, origin string, destination string, flow double, date string").withColumn("date", F.col("date").cast("date"))
    assert flows.od_matrix(long, AREA, date="2024-01-02").first().flow == 2.0


def test_margins_and_transpose(cells_of):
    t = np.array(LINE_T, float)
    cells = cells_of({("a",): t})
    found = {r.zone: (r.out_sum, r.in_sum) for r in flows.margins(cells, AREA).collect()}
    assert found == {str(i): (t.sum(1)[i], t.sum(0)[i]) for i in range(3)}
    assert dense(flows.transpose(cells).collect(), 3).tolist() == t.T.tolist()
    assert flows.intra_share(cells, AREA).first().h_intra == pytest.approx(16 / 30)
    assert flows.totals(cells, AREA).first().total == 30


def test_independence_margins(cells_of, zones_of):
    t = gravity_field(6)[0]
    zones = zones_of({"a": (range(6),) * 5})
    expected = dense(flows.independence(cells_of({("a",): t}), AREA, zones).collect(), 6)
    assert expected.sum() == pytest.approx(t.sum())
    assert expected.sum(1) == pytest.approx(t.sum(1))
    assert expected.sum(0) == pytest.approx(t.sum(0))


def test_dissolve_keeps_unmapped_zones(spark, cells_of):
    cells = cells_of({("a",): LINE_T})
    mapping = spark.createDataFrame([("a", "0", "2"), ("a", "1", "x")], "study_area string, zone string, group string")
    found = {(r.origin, r.destination): r.flow for r in zone_ops.dissolve(cells, mapping, AREA).collect()}
    # Zone 2 has no group and merges with the group of the same name.
    assert found == {("2", "2"): 13.0, ("2", "x"): 7.0, ("x", "2"): 7.0, ("x", "x"): 3.0}
    groups = zone_ops.dissolve_zones(spark.createDataFrame([("a", str(i)) for i in range(3)], "study_area string, zone string"), mapping)
    assert sorted(r.zone for r in groups.collect()) == ["2", "x"]


def test_worked_dissolve(spark, cells_of):
    mapping = spark.createDataFrame([("0", "a"), ("1", "a"), ("2", "b")], "zone string, group string")
    found = {(r.origin, r.destination): r.flow for r in zone_ops.dissolve(cells_of({("z",): LINE_T}), mapping, AREA).collect()}
    assert found == {("a", "a"): 10, ("a", "b"): 6, ("b", "a"): 5, ("b", "b"): 9}


def test_length_band_keeps_only_its_cells(line):
    zones, targets, _ = line
    placed = zone_ops.with_distance(targets, zones)
    kept = zone_ops.keep_length_band(placed, "2-10").collect()
    assert {(r.origin, r.destination) for r in kept} == {("1", "2"), ("2", "1")}
    bands = {r.band: r.f for r in zone_ops.with_length_band(placed).groupBy("band").agg(F.sum("flow").alias("f")).collect()}
    assert bands == {"0.5-2": 19.0, "2-10": 11.0}


def test_row_steps_neither_sort_nor_shuffle_pairs(zones_of):
    zones = zones_of({"a": (range(20),) * 5, "b": (range(3),) * 5})
    p = emission.row_softmax(zone_ops.zone_pairs(zones).withColumn("score", -F.col("distance")), AREA)
    plan = p._jdf.queryExecution().executedPlan().toString()
    # The origins alone are dealt and sorted, below the join that makes pairs of them.
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert plan.rindex("BroadcastHashJoin") < plan.index("Exchange hashpartitioning")
    assert {(r.study_area, r.origin): pytest.approx(1.0) for r in p.select("study_area", "origin").distinct().collect()} == {
        (r.study_area, r.origin): r.whole for r in p.groupBy("study_area", "origin").agg(F.sum("p").alias("whole")).collect()
    }


def test_dense_matrix_shuffles_its_cells_only(zones_of, cells_of):
    zones = zones_of({"a": (range(20),) * 5})
    full = flows.densify(cells_of({("a", "p"): np.eye(20), ("a", "q"): 2 * np.eye(20)}, "study_area string, partition string"), zones, ["study_area", "partition"])
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Exchange" not in plan[: plan.index("Union")]
    assert full.count() == 800 and full.agg(F.sum("flow")).first()[0] == 60


def test_dissolve_deals_rows_by_their_number(spark, monkeypatch):
    """No task holds a fixed share of the cells, however many rows there are; small tables stay at the shuffle width."""
    sf_dir = "/root/testdata/sf0.001"
    rows = lambda frame: sorted(tuple(r) for r in frame.collect())
    plain = rows(QUERIES["dissolve"](spark, sf_dir))
    monkeypatch.setattr(views, "LINES_A_TASK", 100)
    wide = QUERIES["dissolve"](spark, sf_dir)
    dealt = [x for x in wide._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x and "origin" in x]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in x for x in dealt) and rows(wide) == plain
