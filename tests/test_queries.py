"""Registered queries against their SQL on the small tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered

TABLES = Path("/root/testdata/sf0.001")
EVERY = os.environ.get("ODFLOW_ALL_QUERIES") == "1"
SAMPLE = (
    "flow_schema", "od_matrix_dense", "od_margins", "zone_distances", "dissolve", "score_pair",
    "condition_s_scores", "independence", "reference_r_a", "reference_r_b", "purpose_time_cuts",
    "radiation_emit", "gravity_power_emit", "gravity_loglik_grid", "reveal_mask_sizes", "report_table4",
)

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def comparable(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else str(v).removesuffix(" 00:00:00") for v in row) for row in frame.itertuples(index=False))


def test_every_sql_has_its_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", list(registered.oracle_sql()) if EVERY else SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    mine = registered.queries()[name](spark, str(TABLES)).toPandas()
    theirs = duck.execute(registered.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert comparable(mine) == comparable(theirs)


def test_entry_gives_scores(spark):
    rows = registered.entry(spark).collect()
    assert len(rows) == 4 and all(0 < r.CPC_R < 1 for r in rows)
