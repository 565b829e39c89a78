"""Registered queries against their checking SQL on the smallest tables; ``check.py`` covers all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from pelagia.workload.views import TABLES

FOLDER = "/root/testdata/sf0.001"
NAMES = ["flagship_hourly_proximity", "j2_k_nearest_ports", "j4_point_in_polygon", "j8_latest_file_asof", "j9_nearest_time_slice", "a1_ols_trend",
         "a14_percentile", "w1_governing_reading", "w4_local_extrema", "g4_gradient_per_km", "g3_bilinear_sample", "v2_baseline", "v7_ceiling_rules", "n1_sea_condition_band",
         "n3_intents", "n7_unsourced_numbers", "s1_hourly_json", "s2_geojson_segments", "s5_bulletin_html", "x2_alert_transitions", "r2_blocked_reason"]


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
