"""Registered queries against their SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["time_axis_diagnostics", "time_gate", "profile_table", "signal_measurements", "correlation_matrix", "outlier_audit", "gap_limits",
          "knn_impute", "scale_inverse", "smooth_moving_median", "smooth_savgol", "smooth_resampled", "clean_run", "stage_metrics", "recommend_rules",
          "spec_validity", "corrupt_block_missing", "corrupt_nested", "candidate_rank", "reconstruction_loss", "benchmark_summary", "near_tie_winners",
          "recording_blocks", "flag_validity", "delimited_round_trip", "imputed_segments", "fixed_windows", "column_roles", "clock_parsing",
          "fingerprint_changes", "audit_fields", "stage_parameters", "smoothing_volatility", "signal_errors", "knn_impute_one_long_recording"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    cur = duck.execute(entry_points.oracle_sql()[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["recording_id", "domain", "quality_index"] and df.count() > 0


def test_every_sql_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
