from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import LINE_R, LINE_T, gravity_field
from odflow.operators import flows, metrics, zones as zone_ops

AREA = ["study_area"]


def pair(cells_of, a, b, **kwargs):
    return flows.align(AREA, a=cells_of({("z",): a}, **kwargs), b=cells_of({("z",): b}, **kwargs))


def counts(spark, n, name="z"):
    return spark.createDataFrame([(name, n)], "study_area string, n_zones long")


def plain_scores(a, b, d):
    """Dense definitions, for comparison."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    out = {"CPC": 2 * np.minimum(a, b).sum() / (a.sum() + b.sum())}
    out["CPL"] = 2 * ((a > 0) & (b > 0)).sum() / ((a > 0).sum() + (b > 0).sum())
    used = a + b > 0
    out["pearson_r"] = np.corrcoef(np.log1p(a[used]), np.log1p(b[used]))[0, 1]
    out["NRMSE"] = np.sqrt(((a - b) ** 2).mean()) / a.mean()
    edges = [-np.inf, 0.5, 2, 10, 50, np.inf]
    ha, hb = (np.array([m[(d >= lo) & (d < hi)].sum() for lo, hi in zip(edges, edges[1:])]) for m in (a, b))
    out["CPCd"] = 2 * np.minimum(ha, hb).sum() / (ha.sum() + hb.sum())
    top = max(a.max(), b.max())
    low = max(top / 1e6, 1e-12)

    def shares(m):
        where = np.zeros(m.shape, int)
        big = m >= low
        where[big] = np.minimum(np.floor(np.log10(m[big] / low) / np.log10(top / low) * 19).astype(int) + 1, 19)
        return np.bincount(where.ravel(), minlength=20) / m.size

    p, q = shares(a), shares(b)
    middle = (p + q) / 2
    out["JSD"] = sum(0.5 * (x[x > 0] * np.log(x[x > 0] / middle[x > 0])).sum() for x in (p, q))
    return out


def test_overlap_of_shifted_flow(cells_of):
    # 7 of the 10 and 14 trips lie on common cells: 2·7 / 24.
    a, b = [[4, 0, 1], [0, 5, 0]], [[2, 3, 2], [1, 4, 2]]
    square = [[*r] for r in (*a, [0, 0, 0])], [[*r] for r in (*b, [0, 0, 0])]
    assert metrics.cpc(pair(cells_of, *square), AREA).first().CPC == pytest.approx(14 / 24)
    for n in (3, 6):
        t = gravity_field(n)[0]
        assert metrics.cpc(pair(cells_of, t, t), AREA).first().CPC == pytest.approx(1.0)


def test_way_back_scores_its_transpose(cells_of):
    r = gravity_field(6, 2)[1]
    row = metrics.delta_cpc(metrics.stack_reference(cells_of({("z",): 3 * r.T}), cells_of({("z",): r}), AREA, AREA), AREA).first()
    plain = 2 * np.minimum(3 * r.T, 3 * r).sum() / (6 * r.sum())
    assert (row["lambda"], row.CPC_RT) == pytest.approx((3.0, 1.0))
    assert row.CPC_R == pytest.approx(plain) and row.Delta == pytest.approx(1.0 - plain)
    half = metrics.stack_reference(cells_of({("z",): r}), cells_of({("z",): r}), AREA, AREA)
    assert metrics.delta_cpc(half, AREA, scale=0.5).first()["lambda"] == 0.5


def test_worked_scores(spark, line):
    zones, targets, reference = line
    cells = metrics.stack_reference(targets.drop("partition"), reference, AREA, AREA)
    row = metrics.delta_cpc(cells, AREA).first()
    assert [row["lambda"], row.CPC_R, row.CPC_RT, row.Delta] == pytest.approx([1.5, 0.8, 0.816667, 0.016667], abs=1e-6)
    scaled = reference.withColumn("flow", F.col("flow") * 1.5)
    placed = zone_ops.with_distance(flows.align(AREA, a=targets.drop("partition"), b=scaled), zones)
    hist = {r.length_bin: (r.mass_a, r.mass_b) for r in metrics.length_histogram(placed, AREA).collect()}
    assert hist == {1: (19.0, 16.5), 2: (11.0, 13.5)}
    row = metrics.score_pair(placed, AREA, counts(spark, 3, "line"), AREA).first()
    assert [row.CPL, row.CPCd, row.pearson_r, row.R2, row.NRMSE, row.JSD] == pytest.approx(
        [1.0, 0.916667, 0.537643, 0.28906, 0.52915, 0.061368], abs=1e-6
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_match_dense_definitions(spark, cells_of, zones_of, seed):
    n = 12
    t, r, d, xy, mass = gravity_field(n, seed)
    draw = np.random.default_rng(seed)
    t[draw.random((n, n)) < 0.4] = 0
    r[draw.random((n, n)) < 0.3] = 0
    zones = zones_of({"z": (xy[:, 0], xy[:, 1], np.ones(n), mass, mass)})
    placed = zone_ops.with_distance(pair(cells_of, t, r), zones)
    expected = plain_scores(t, r, d)
    row = metrics.score_pair(placed, AREA, counts(spark, n), AREA).first().asDict()
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-9), name
    single = {
        "CPC": metrics.cpc(placed, AREA), "CPL": metrics.cpl(placed, AREA), "CPCd": metrics.cpcd(placed, AREA),
        "pearson_r": metrics.pearson_log(placed, AREA), "NRMSE": metrics.nrmse(placed, AREA, counts(spark, n), AREA),
        "JSD": metrics.jsd(placed, AREA, counts(spark, n), AREA),
    }
    for name, frame in single.items():
        assert frame.first()[name] == pytest.approx(expected[name], abs=1e-9), name


def test_partitioning_and_stored_zeros_do_not_matter(spark, cells_of):
    t, r = gravity_field(8, 3)[:2]
    t[t < 2] = 0
    plain = metrics.score_pair(pair(cells_of, t, r), AREA, counts(spark, 8), AREA).first()
    mixed = pair(cells_of, t, r, keep_zeros=True).repartition(7, "destination")
    again = metrics.score_pair(mixed, AREA, counts(spark, 8), AREA).first()
    for name in metrics.PAIR_SCORES[:-1]:
        assert again[name] == pytest.approx(plain[name], abs=1e-12)
    assert plain.CPCd is None


def test_undefined_scores_are_null(spark, cells_of):
    keys = "study_area string"
    a = cells_of({("zero",): [[0, 0], [0, 0]], ("flat",): [[1, 1], [1, 1]], ("one",): [[5, 0], [0, 0]]}, keys, keep_zeros=True)
    b = cells_of({("zero",): [[0, 0], [0, 0]], ("flat",): [[1, 2], [3, 4]], ("one",): [[5, 0], [0, 0]]}, keys, keep_zeros=True)
    both = flows.align(AREA, a=a, b=b)
    sizes = spark.createDataFrame([(k, 2) for k in ("zero", "flat", "one")], "study_area string, n_zones long")
    found = {r.study_area: r for r in metrics.score_pair(both, AREA, sizes, AREA).collect()}
    zero = found["zero"]
    assert (zero.CPC, zero.CPL, zero.pearson_r, zero.R2, zero.NRMSE, zero.JSD) == (None, None, None, None, None, 0.0)
    assert found["flat"].pearson_r is None and found["flat"].CPC == pytest.approx(2 * 4 / 14)
    assert found["one"].pearson_r is None and found["one"].CPC == 1.0 and found["one"].JSD == 0.0


def test_hot_key_is_spread(spark):
    """A key holding most cells still gives exact scores through the salted lookup."""
    rows = [("hot", str(i % 40), str(i // 40), float(i % 7 + 1)) for i in range(1600)] + [("cold", "0", "1", 2.0)]
    t = spark.createDataFrame(rows, "study_area string, origin string, destination string, flow double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = metrics.stack_reference(t, flows.transpose(t), AREA, AREA)
        found = {r.study_area: r for r in metrics.delta_cpc(cells, AREA).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    m = np.zeros((40, 40))
    for _, o, d, f in rows[:-1]:
        m[int(o), int(d)] = f
    assert found["hot"].CPC_R == pytest.approx(np.minimum(m, m.T).sum() / m.sum())
    assert found["hot"].CPC_RT == pytest.approx(1.0) and found["cold"].CPC_R == 0.0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 9), min_size=18, max_size=18).filter(lambda v: sum(v[:9]) and sum(v[9:])))
def test_overlap_is_symmetric_and_bounded(cells_of, values):
    a, b = np.array(values[:9]).reshape(3, 3), np.array(values[9:]).reshape(3, 3)
    there = metrics.cpc(pair(cells_of, a, b), AREA).first().CPC
    back = metrics.cpc(pair(cells_of, b, a), AREA).first().CPC
    assert there == pytest.approx(back) and 0 <= there <= 1
