"""Scores from shares against scores of the emitted matrix."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import gravity_field
from odflow.operators import flows, metrics
from odflow.operators.generators import emission, gravity
from odflow.plans import condition_g, factors
from odflow.session import write_table

KEYS = ["study_area", "partition"]


@pytest.fixture
def study(cells_of, zones_of):
    matrices, areas = {}, {}
    for k, n in enumerate((7, 10)):
        t, _, _, xy, m = gravity_field(n, k)
        draw = np.random.default_rng(k)
        areas[f"z{k}"] = (xy[:, 0], xy[:, 1], np.ones(n), m, m)
        for name, share in (("p", 0.5), ("q", 0.9)):
            matrices[f"z{k}", name] = np.where(draw.random((n, n)) < share, t, 0.0)
    matrices["z0", "p"][3] = 0  # an origin without outflow
    zones = zones_of(areas)
    return cells_of(matrices, "study_area string, partition string"), zones, condition_g.generator_pairs(zones)


def rows(frame, at):
    return {tuple(r[c] for c in at): [r[c] for c in metrics.PAIR_SCORES] for r in frame.collect()}


def test_shares_and_matrix_score_alike(study):
    targets, zones, pairs = study
    laws = [gravity.gravity_probabilities(pairs, law, beta).withColumn("law_model", F.lit(f"{law}{beta}")) for law, beta in (("power", 1.0), ("exp", 0.3), ("power", 3.0))]
    # A law that leaves out some pairs: their cells are zero.
    sparse = laws[0].where((F.col("origin") == F.col("destination")) | (F.xxhash64("origin", "destination") % 3 != 0)).withColumn("law_model", F.lit("sparse"))
    shares = write_table(laws[0].unionByName(laws[1]).unionByName(laws[2]).unionByName(sparse))
    at = [*KEYS, "law_model"]
    emitted = emission.emit(shares, flows.row_sums(targets, KEYS), at)
    want = rows(condition_g.score_condition_g(emitted, targets, zones, at, KEYS), at)
    got = rows(factors.share_scores(shares, targets, zones, at, KEYS), at)
    assert len(want) == 16 and set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9), key
    as_flows = emitted.select(*at, "origin", "destination", "distance", F.col("flow").alias("p"))
    got = rows(factors.share_scores(as_flows, targets, zones, at, KEYS, emitted=True), at)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9), key


def test_weights_known_at_single_pairs_meet_the_cells_alone(study, monkeypatch):
    """No share is written or joined with the cells; a cell of an unknown zone still counts on the target's side."""
    targets, zones, pairs = study
    lost = targets.limit(1).withColumn("destination", F.lit("nowhere"))
    targets = write_table(targets.unionByName(lost))
    weights = lambda rows: rows.withColumn("w", F.col("m_d") * gravity.deterrence(F.col("distance"), "power", 1.0))
    law = condition_g.weighted_law("g", weights, pairs, targets, zones, KEYS, by_fold=False)
    shares = gravity.gravity_probabilities(pairs, "power", 1.0)
    want = rows(factors.share_scores(shares, targets, zones, KEYS, KEYS), KEYS)
    written = []
    monkeypatch.setattr(condition_g, "write_table", lambda frame, by=(): written.append(frame) or write_table(frame, by))
    _, once = condition_g.score_laws([law], targets, zones, KEYS)
    got = rows(once, KEYS)
    assert not written and len(want) == 4 and set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9), key


def test_without_places(study):
    targets, zones, pairs = study
    shares = gravity.gravity_probabilities(pairs, "power", 1.0).withColumn("law_model", F.lit("g"))
    found = rows(factors.share_scores(shares, targets, zones.drop("x", "y"), [*KEYS, "law_model"], KEYS), KEYS)
    assert all(v[-1] is None and v[0] > 0 for v in found.values())


@pytest.mark.parametrize("broken", ["empty row", "no number", "flows"])
def test_rows_that_miss_their_outflow_fail(study, broken):
    targets, zones, pairs = study
    shares = gravity.gravity_probabilities(pairs, "power", 1.0)
    first = F.col("origin") == "0"
    if broken == "empty row":
        shares = shares.withColumn("p", F.when(first, 0.0).otherwise(F.col("p")))
    elif broken == "no number":
        shares = shares.withColumn("p", F.when(first, float("nan")).otherwise(F.col("p")))
    with pytest.raises(PySparkException, match="row sums"):
        factors.share_scores(shares, targets, zones, KEYS, KEYS, emitted=broken == "flows").collect()


def test_no_matrix_is_written_or_shuffled_per_target(study, monkeypatch):
    targets, zones, _ = study
    written = []

    def watched(frame, by=()):
        written.append(set(frame.columns))
        return write_table(frame, by)

    monkeypatch.setattr(condition_g, "write_table", watched)
    monkeypatch.setattr(factors, "write_table", watched)
    reference = targets.where("partition = 'q'").drop("partition")
    scores = condition_g.run_generators(targets, reference, zones, KEYS, max_cycles=2)
    assert scores.select(*KEYS).distinct().count() == 4
    cells = [c for c in written if {"origin", "destination"} <= c]
    # Only shares that were themselves fitted per target (the Oracle's) carry the target.
    assert len([c for c in cells if "partition" in c]) == 1 and not any("flow" in c for c in cells)
