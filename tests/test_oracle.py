"""Registered queries against their SQL twins. TIDEMARK_ORACLE=all runs every query; the default is a sample."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.001")
SAMPLE = ["E7_forward_outcome", "J1_asof_backward", "J12_interval_path_join", "W3_W4_regime", "A3_resample_complete", "B2_B4_B5_B6_B8_snapshot_metrics", "R2_cluster_bootstrap",
          "R8_newey_west_slope", "Q5_scd2_compress", "A21_change_decomposition", "L6_warning_state", "S1_read_klines_headerless", "T3_stream_tumbling_bars"]
NAMES = sorted(entry.queries()) if os.environ.get("TIDEMARK_ORACLE") == "all" else SAMPLE


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    verdict, _, _ = check.compare(spark, con, SF, name)
    assert verdict in ("ok", "no-oracle") or verdict.startswith("CLOSE"), verdict


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200
