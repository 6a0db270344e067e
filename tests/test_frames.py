"""Frame tables: every mask and pixel of a frame in one partition, so that pixels are not dealt again."""

from __future__ import annotations

import datetime as dt

import numpy as np

from fleetsight.operators import depth as dp, imaging as im, masks as mk
from fleetsight.plans.masks import STALE_US, _claims
from fleetsight.sources import derive as src


def _events(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i % 3, "view", float(i % 90), "{}")
            for i in [*range(60), 5, 30, 31]]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, "
                                "props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_show_the_lowest_mask_over_them(spark, tmp_path):
    d = _events(spark, tmp_path)
    tops = {}
    for p in src.mask_pixels(spark, d).collect():
        at = (p.frame_key, p.v, p.u)
        tops[at] = min(p.mask_id, tops.get(at, p.mask_id))
    found = src.pixels(spark, d).collect()
    assert len(found) == 3 * src.GRID_W * src.GRID_H
    for p in found:
        top = tops.get((p.frame_key, p.v, p.u))
        none = (p.u * 7 + p.v * 13 + p.frame_key) % 97 == 0
        assert p.depth_raw == (0 if none else 4500 if top is None else 1500 + 500 * (top % 5))


def test_pixels_take_their_object_from_runs(spark, tmp_path):
    d = _events(spark, tmp_path)
    above = _plan(src.pixels(spark, d).select("frame_key", "depth_raw")).split("ObjectHashAggregate")[0]
    assert "Generate explode(sequence(" in above
    assert "posexplode" not in above and "Filter (" not in above


def test_pixels_of_boxes_beyond_the_image_and_of_no_frame(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1), 1, "view", 1.0, "{}") for i in (-50, -49, -7, 3, None, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, "
                                "props string").write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    boxes = src.masks(spark, d).collect()
    found = src.pixels(spark, d).collect()
    frames = {b.frame_key for b in boxes}
    assert None in frames and len(found) == len(frames) * src.GRID_W * src.GRID_H
    assert any(b.x1 is not None and (b.x1 < 0 or b.y1 < 0) for b in boxes)
    for p in found:
        top = min((b.mask_id for b in boxes if p.frame_key is not None and b.frame_key == p.frame_key
                   and b.y1 <= p.v < b.y2 and b.x1 <= p.u < b.x2), default=None)
        none = p.frame_key is not None and int(np.fmod(p.u * 7 + p.v * 13 + p.frame_key, 97)) == 0
        assert p.depth_raw == (0 if none else 4500 if top is None else 1500 + 500 * int(np.fmod(top, 5)))


def test_joins_of_masks_and_frames_shuffle_and_broadcast_no_pixels(spark, tmp_path):
    d = _events(spark, tmp_path)
    px, pixels = src.mask_pixels(spark, d), src.pixels(spark, d)
    places = src.masks(spark, d).selectExpr("frame_key", "mask_id", "y1 AS v", "x1 AS u")
    for df in (mk.depth_stats(px, pixels), dp.extract_masks(px, pixels, 1), mk.crop(px, pixels),
               dp.consistent_pixels(px, pixels), im.mask_image(px, src.masks(spark, d)), im.window_median(places, pixels)):
        plan = _plan(df)
        assert "BroadcastExchange" not in plan
        assert all("REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_labelled_runs_do_not_read_the_pixels_again(spark, tmp_path):
    d = _events(spark, tmp_path)
    assert "FileScan" not in _plan(dp.connected_regions(src.pixels(spark, d), src.GRID_H))


def test_words_of_masks_and_claims_are_dealt_by_frame_and_by_scene(spark, tmp_path):
    d = _events(spark, tmp_path)
    words = mk.words(src.mask_pixels(spark, d))
    plan = _plan(mk.overlaps(words, mk.areas(words)))
    assert all("REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    new, claims = _claims(spark, d)
    plan = _plan(mk.claim_overlaps(new, claims, STALE_US, 0.0))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("v#" in line.split("REPARTITION")[0] for line in dealt)
    boxes = {m.mask_id: m for m in src.masks(spark, d).distinct().collect()}
    want = {(a.mask_id, b.mask_id) for a in boxes.values() for b in boxes.values()
            if a.source != "fastsam" and b.source == "fastsam" and a.object_id != b.object_id
            and 0 <= a.frame_key - b.frame_key <= 5 and min(a.x2, b.x2) > max(a.x1, b.x1) and min(a.y2, b.y2) > max(a.y1, b.y1)}
    assert {(r.mask_id, r.claim_id) for r in mk.claim_overlaps(new, claims, STALE_US, 0.0).collect()} == want
