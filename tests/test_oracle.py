"""Registered queries against DuckDB.  A sample of the fast ones by default; FULL_ORACLE=1 runs all
(``python check.py`` does the same with timings)."""

import os

import pytest

from compare import difference, duck
from fleetsight.plans import ORACLES, QUERIES

SAMPLE = ["flagship_route_status", "F22_route", "F24_review_route", "S01_upsert", "L02_object_page", "J01_L03_knn",
          "J06_camera_aware_match", "J07_object_match", "J12_mask_overlaps", "A21_stage_stats", "A29_T10_mode_votes",
          "R08_balance", "V07_voxel_downsample", "V12_dominant_plane", "W07_rolling_accuracy", "J26_camera_alignment",
          "T02_windowed_metrics", "V15_merge_weighted", "V25_dominant_colors", "W15_skip_flags"]
NAMES = sorted(QUERIES) if os.environ.get("FULL_ORACLE") else SAMPLE


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(name, spark, con, sf_dir):
    assert difference(spark, con, sf_dir, QUERIES[name], ORACLES.get(name)) is None
