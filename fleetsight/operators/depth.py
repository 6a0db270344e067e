"""Depth images as long pixel tables: edges, regions, masks and their refinement.

Frames are dense grids of ``height`` x ``width`` pixels.  Work is keyed by image row or by mask, never
by frame alone, so one frame can spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetsight.operators.blocks import slices
from fleetsight.operators.graph import components
from fleetsight.operators.masks import MAX_AREA, MIN_AREA, depth_stats, fused, shape
from fleetsight.session import checkpoint

# Depth range in metres, gradient limit and depth spread.
MIN_DEPTH, MAX_DEPTH = 0.2, 5.0
GRADIENT, SPREAD = 0.1, 0.1
BAND = 64
#: Cells of stacked windows that morphology holds at once.
STACK = 1_000_000


def valid_depth(raw: Column, low: float = MIN_DEPTH, high: float = MAX_DEPTH) -> Column:
    return (raw > low * 1000) & (raw < high * 1000)


def neighbour_rows(rows: DataFrame, ids: list[str], height: Column) -> DataFrame:
    """Every image row ``(ids, v, x)`` with the rows above and below it; the border mirrors the second
    row."""
    v = F.col("v")
    to = lambda role, at, ok: F.when(ok, F.struct(F.lit(role).alias("role"), at.cast("int").alias("at")))
    roles = F.array(to(0, v, F.lit(True)), to(-1, v + 1, v + 1 < height), to(1, v - 1, v > 0),
                    to(-1, F.lit(0), v == 1), to(1, height - 1, v == height - 2))
    sent = rows.withColumn("t", F.explode(roles)).filter(F.col("t").isNotNull())
    pick = lambda r: F.first(F.when(F.col("t.role") == r, F.col("x")), ignorenulls=True)
    return sent.groupBy(*ids, F.col("t.at").alias("v")).agg(
        pick(-1).alias("up"), pick(0).alias("x"), pick(1).alias("down")).withColumns(
        {"up": F.coalesce("up", "x"), "down": F.coalesce("down", "x")})


def image_rows(pixels: DataFrame, value: Column, ids: list[str]) -> DataFrame:
    """One array per image row, in column order; a row is as long as its image is wide."""
    cells = F.array_sort(F.collect_list(F.struct("u", value.alias("x"))))
    return pixels.groupBy(*ids, "v").agg(cells.alias("c")).select(*ids, "v", F.col("c.x").alias("x"))


def sobel(up: np.ndarray, mid: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3x3 Sobel gradients of stacked image rows; the border mirrors the second column."""
    if mid.shape[1] == 1:
        up, mid, down = (np.repeat(r, 3, axis=1) for r in (up, mid, down))
        return tuple(g[:, 1:2] for g in sobel(up, mid, down))
    left = lambda r: np.concatenate([r[:, 1:2], r[:, :-1]], axis=1)
    right = lambda r: np.concatenate([r[:, 1:], r[:, -2:-1]], axis=1)
    across = lambda r: right(r) - left(r)
    smooth = lambda r: left(r) + 2 * r + right(r)
    return across(up) + 2 * across(mid) + across(down), smooth(down) - smooth(up)


def _edge_rows(pixels: DataFrame, height: int, gradient: float, relative: bool, whole_rows: bool = False) -> DataFrame:
    """Per image row: which pixels have a valid depth, and which of them are edges.  With ``whole_rows`` the input has
    one row per image row, with its depths in column order."""
    ids = ["frame_key"]
    value = lambda raw: F.when(valid_depth(raw), raw).otherwise(0)
    if whole_rows:
        rows = pixels.select(*ids, "v", F.transform("depth_raw", value).alias("x"))
    else:
        rows = image_rows(pixels, value(F.col("depth_raw")), ids)
    rows3 = neighbour_rows(rows, ids, F.lit(height))

    def run(batches):
        for b in batches:
            # Frames of different widths do not stack; each width is handled on its own.
            for _, part in b.groupby(b["x"].map(len)):
                up, mid, down = (np.stack(part[c].to_numpy()).astype(np.int64) for c in ("up", "x", "down"))
                gx, gy = sobel(up, mid, down)
                size = np.sqrt((gx * gx + gy * gy).astype(np.float64))
                limit = mid * gradient if relative else gradient * 1000
                yield pd.DataFrame({
                    "frame_key": part["frame_key"], "v": part["v"], "valid": list(mid > 0),
                    "edge": list((mid > 0) & (size > limit))})

    return rows3.mapInPandas(run, "frame_key long, v int, valid array<boolean>, edge array<boolean>")


def edges(pixels: DataFrame, height: int, gradient: float = GRADIENT,
          relative: bool = False, whole_rows: bool = False) -> DataFrame:
    """Pixels whose depth gradient exceeds the limit (absolute, or a fraction of the depth)."""
    rows = _edge_rows(pixels, height, gradient, relative, whole_rows)
    return rows.select("frame_key", "v", F.posexplode("edge").alias("u", "e")).filter("e").select(
        "frame_key", "v", "u")


def _runs(rows: DataFrame) -> DataFrame:
    """Horizontal runs of valid pixels that are not edges."""
    on = F.zip_with("valid", "edge", lambda x, e: x & ~e)
    r = rows.select("frame_key", "v", on.alias("on"))
    idx = F.sequence(F.lit(0), F.size("on") - 1)
    is_on = lambda i: F.coalesce(F.get("on", i), F.lit(False))
    starts = F.filter(idx, lambda i: is_on(i) & ~F.when(i > 0, is_on(i - 1)).otherwise(False))
    ends = F.filter(idx, lambda i: is_on(i) & ~is_on(i + 1))
    z = F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b")))
    return r.select("frame_key", "v", z.alias("z")).select(
        "frame_key", "v", F.col("z.a").alias("u0"), F.col("z.b").alias("u1"))


def run_id(key: Column, v: Column, u: Column) -> Column:
    """One number per run; keeps the order (key, v, u) and needs images below 65,536 pixels wide."""
    return key * F.lit(1 << 32) + v.cast("long") * F.lit(1 << 16) + u.cast("long")


def label_runs(runs: DataFrame, key: str, reach: int = 1) -> DataFrame:
    """Component of every run; runs of neighbouring rows touch within ``reach`` columns."""
    # Runs are few beside the pixels they come from, and are read three times below.
    r = checkpoint(runs.withColumn("id", run_id(F.col(key), F.col("v"), F.col("u0"))))
    above = r.select(key, (F.col("v") + 1).alias("v"), F.col("u0").alias("a0"),
                     F.col("u1").alias("a1"), F.col("id").alias("a"))
    touch = r.join(above, [key, "v"]).filter(
        (F.col("a0") <= F.col("u1") + reach) & (F.col("u0") <= F.col("a1") + reach))
    # Bands of image rows have a bounded number of runs; an edge on a band's first row leaves it.
    band = F.when(F.col("v") % BAND != 0, F.floor(F.col("v") / BAND))
    found = components(touch.select("a", F.col("id").alias("b"), band.alias("band"),
                                    F.col(key).alias("image")), ["band", "image"])
    return r.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "label", F.coalesce("component", "id")).drop("component", "id")


def connected_regions(pixels: DataFrame, height: int, gradient: float = GRADIENT) -> DataFrame:
    """8-connected regions of valid pixels between the depth edges, as labelled runs."""
    return label_runs(_runs(_edge_rows(pixels, height, gradient, False)), "frame_key")


def run_pixels(labelled: DataFrame, name: str = "mask_id") -> DataFrame:
    return labelled.select("frame_key", F.col("label").alias(name), "v",
                           F.explode(F.sequence("u0", "u1")).alias("u"))


def extract_masks(label_pixels: DataFrame, pixels: DataFrame, min_area: int = MIN_AREA,
                  max_area: int = MAX_AREA, confidence: float = 0.8) -> DataFrame:
    """Masks from labelled pixels: area band, inclusive box and median valid depth in metres."""
    d = pixels.select("frame_key", "v", "u", "depth_raw")
    valid = F.when(F.col("depth_raw") > 0, F.col("depth_raw"))
    g = label_pixels.join(d, ["frame_key", "v", "u"]).groupBy("frame_key", "mask_id").agg(
        F.count(F.lit(1)).alias("area"), F.min("u").alias("bx1"), F.min("v").alias("by1"),
        F.max("u").alias("bx2"), F.max("v").alias("by2"),
        F.coalesce(F.median(valid) / 1000, F.lit(0.0)).alias("depth_median"))
    return g.filter(F.col("area").between(min_area, max_area)).withColumn(
        "confidence", F.lit(confidence))


def _lloyd(part: np.ndarray, values: np.ndarray, weights: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Weighted one-dimensional k-means of each part's values, from ``k`` evenly spaced starts; label per value."""
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    centers = np.full((len(k), int(k.max())), np.inf)
    for n in np.unique(k):
        centers[k == n, :n] = np.linspace(low[k == n], high[k == n], n, axis=1)

    def nearest(at: np.ndarray) -> np.ndarray:
        return np.abs(values[at, None] - centers[part[at]]).argmin(1)

    live = np.ones(len(k), bool)
    for _ in range(10):
        at = np.flatnonzero(live[part])
        if not len(at):
            break
        cell = part[at] * centers.shape[1] + nearest(at)
        count = lambda w: np.bincount(cell, w, minlength=centers.size).reshape(centers.shape)
        total = count(weights[at])
        moved = np.where(total > 0, count(values[at] * weights[at]) / np.where(total > 0, total, 1), centers)
        away = np.abs(np.subtract(moved, centers, out=np.zeros_like(moved), where=np.isfinite(centers))).max(1)
        live &= away >= 0.5
        centers[live] = moved[live]
    return nearest(np.arange(len(values)))


def depth_clusters(counts: DataFrame) -> DataFrame:
    """Cluster of every (mask, depth value): ``counts(frame_key, mask_id, k, depth_raw, n)``.

    The input holds one row per distinct millimetre of a mask, so a group has at most 65,536 rows
    whatever the size of the mask.
    """
    ids = ["frame_key", "mask_id"]
    rows = counts.groupBy(*ids).agg(*[F.collect_list(c).alias(c) for c in ("depth_raw", "n", "k")])

    def run(batches):
        for b in slices(batches, "depth_raw"):
            part = np.repeat(np.arange(b.num_rows), np.diff(b.column("n").offsets.to_numpy()))
            depth, n, k = (b.column(c).flatten() for c in ("depth_raw", "n", "k"))
            label = _lloyd(part, depth.to_numpy().astype(np.float64), n.to_numpy().astype(np.float64),
                           k.to_numpy()[np.flatnonzero(np.diff(part, prepend=-1))])
            same = pa.array(part)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(same) for c in ids], depth.cast("int32"), pa.array(label.astype("int32"))],
                names=[*ids, "depth_raw", "part"])

    return rows.mapInArrow(run, "frame_key long, mask_id long, depth_raw int, part int")


def split_by_depth(label_pixels: DataFrame, pixels: DataFrame, k: Column, spread: float,
                   min_valid: int) -> DataFrame:
    """Parts of masks whose depth varies more than ``spread``: adds ``part`` (null where whole)."""
    d = pixels.filter("depth_raw > 0").select("frame_key", "v", "u", "depth_raw")
    j = label_pixels.join(d, ["frame_key", "v", "u"], "left")
    ids = ["frame_key", "mask_id"]
    stats = j.groupBy(*ids).agg((F.stddev_pop("depth_raw") / 1000).alias("std_m"),
                                F.count("depth_raw").alias("valid_px"))
    wide = stats.filter((F.col("std_m") >= spread) & (F.col("valid_px") >= min_valid)).select(
        *ids, k.cast("int").alias("k"))
    counts = (j.filter(F.col("depth_raw").isNotNull()).groupBy(*ids, "depth_raw")
              .agg(F.count(F.lit(1)).alias("n")).join(wide, ids))
    parts = depth_clusters(counts)
    return j.join(parts, [*ids, "depth_raw"], "left").join(
        wide.select(*ids, F.lit(True).alias("split")), ids, "left").select(
        *ids, "v", "u", "depth_raw", F.coalesce("split", F.lit(False)).alias("split"), "part")


def refine_labels(label_pixels: DataFrame, pixels: DataFrame, spread: float = SPREAD) -> DataFrame:
    """Regions whose depth varies too much fall into a near and a far part, each its own label."""
    s = split_by_depth(label_pixels, pixels, F.lit(2), spread, 10)
    far = F.coalesce(F.col("part") == 1, F.lit(False))
    return s.select("frame_key", F.when(far, -F.col("mask_id") - 1).otherwise(F.col("mask_id"))
                    .alias("mask_id"), "v", "u")


def segment(pixels: DataFrame, height: int, min_area: int = MIN_AREA,
            max_area: int = MAX_AREA) -> DataFrame:
    """Edges, regions, depth split and masks in one go."""
    labels = run_pixels(connected_regions(pixels, height))
    return extract_masks(refine_labels(labels, pixels), pixels, min_area, max_area)


# --- morphology on pixel sets -----------------------------------------------------------------

def _spread(m: np.ndarray, reach: int, both: np.ufunc) -> np.ndarray:
    """``both`` over the square around each pixel of stacked images, cut at the border."""
    for axis in (1, 2):
        x = np.moveaxis(m, axis, 0)
        out = x.copy()
        for step in range(1, min(reach, len(x) - 1) + 1):
            both(out[step:], x[:-step], out=out[step:])
            both(out[:-step], x[step:], out=out[:-step])
        m = np.moveaxis(out, 0, axis)
    return m


def _flood(free: np.ndarray) -> np.ndarray:
    """Free pixels that the border reaches over free pixels (4-connected)."""
    seen = np.zeros_like(free)
    seen[[0, -1], :], seen[:, [0, -1]] = free[[0, -1], :], free[:, [0, -1]]
    while True:
        before = seen.sum()
        for view, open_ in ((seen, free), (seen.T, free.T)):
            for step in (1, -1):
                s, o = view[::step], open_[::step]
                for i in range(1, len(s)):
                    s[i] |= s[i - 1] & o[i]
        if seen.sum() == before:
            return seen


def morphology(px: DataFrame, ids: list[str], steps: list[tuple[str, int]], width: int,
               height: int) -> DataFrame:
    """Dilations, erosions and hole filling of pixel sets, with square neighbourhoods.

    ``steps`` is a list like ``[("dilate", 2), ("erode", 2), ("fill", 0)]``.  The pixels of a mask
    are distinct places of one image, so a group is never larger than an image.  Beyond the border
    there is nothing to erode from.
    """
    margin = sum(r for what, r in steps if what == "dilate") + 1

    def work(m, inside, rows, cols):
        for what, reach in steps:
            if what == "dilate":
                m = _spread(m, reach, np.logical_or) & inside
            elif what == "erode":
                # A cut window is inside the image as well, because the margin covers every step.
                m = _spread(m | ~inside, reach, np.logical_and) & inside
            else:
                for one, r, c in zip(m, rows, cols):
                    ring = np.pad(one[:r, :c], 1)
                    one[:r, :c] = ~_flood(~ring)[1:-1, 1:-1]
        return m

    def batch(batches):
        for b in slices(batches, "v"):
            vs, us = b.column("v"), b.column("u")
            n = np.diff(vs.offsets.to_numpy())
            first = np.cumsum(n) - n
            v, u = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (vs, us))
            low = lambda x: np.maximum(0, np.minimum.reduceat(x, first) - margin)
            high = lambda x, size: np.minimum(size, np.maximum.reduceat(x, first) + margin + 1)
            top, left = low(v), low(u)
            rows, cols = high(v, height) - top, high(u, width) - left
            # Windows of about the same size are worked on together, a bounded number of cells at once.
            kind = (rows + 7) // 8 * (1 << 32) + (cols + 7) // 8
            order = np.argsort(kind, kind="stable")
            cuts = np.flatnonzero(np.diff(kind[order], prepend=-1))
            for group in np.split(order, cuts[1:]):
                size = (rows[group].max(), cols[group].max())
                most = max(1, STACK // int(size[0] * size[1]))
                for at in (group[i:i + most] for i in range(0, len(group), most)):
                    m = np.zeros((len(at), *size), bool)
                    k = np.repeat(np.arange(len(at)), n[at])
                    px = np.arange(len(k)) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + np.repeat(first[at], n[at])
                    m[k, v[px] - top[at][k], u[px] - left[at][k]] = True
                    inside = ((np.arange(size[0]) < rows[at][:, None])[:, :, None]
                              & (np.arange(size[1]) < cols[at][:, None])[:, None, :])
                    k, y, x = np.nonzero(work(m, inside, rows[at], cols[at]))
                    same = pa.array(at[k])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(c).take(same) for c in ids]
                        + [pa.array((y + top[at][k]).astype("int32")), pa.array((x + left[at][k]).astype("int32"))],
                        names=[*ids, "v", "u"])

    kinds = {f.name: f.dataType.simpleString() for f in px.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ids) + ", v int, u int"
    return px.groupBy(*ids).agg(F.collect_list("v").alias("v"), F.collect_list("u").alias("u")).mapInArrow(batch, schema)


CLOSE = [("dilate", 2), ("erode", 2)]
OPEN = [("erode", 2), ("dilate", 2)]


def consistent_pixels(mask_pixels: DataFrame, pixels: DataFrame, spread: float = SPREAD) -> DataFrame:
    """Pixels near the median depth, for the masks whose depth varies (others are left out)."""
    ids = ["frame_key", "mask_id"]
    stats = depth_stats(mask_pixels, pixels).filter(
        (F.col("valid_px") >= 10) & (F.col("std_m") >= spread)).select(*ids, "median_m")
    d = pixels.filter("depth_raw > 0").select("frame_key", "v", "u", "depth_raw")
    j = mask_pixels.join(stats, ids).join(d, ["frame_key", "v", "u"])
    near = F.abs(F.col("depth_raw") - F.col("median_m") * 1000) < 2000 * spread
    return j.filter(near).select(*ids, "v", "u")


def refined_pixels(mask_pixels: DataFrame, pixels: DataFrame, width: int, height: int,
                   spread: float = SPREAD, least: int = 100) -> DataFrame:
    """What fits the depth of the masks whose depth varies, where that is large enough."""
    ids = ["frame_key", "mask_id"]
    cleaned = checkpoint(morphology(consistent_pixels(mask_pixels, pixels, spread), ids, CLOSE + OPEN, width,
                                    height))
    big = shape(cleaned).filter(F.col("area") >= least).select(*ids)
    return cleaned.join(big, ids, "left_semi")


def refine_masks(mask_pixels: DataFrame, pixels: DataFrame, width: int, height: int,
                 spread: float = SPREAD, least: int = 100) -> DataFrame:
    """Masks without the pixels that do not fit their depth; too small a rest keeps the mask."""
    ids = ["frame_key", "mask_id"]
    kept = refined_pixels(mask_pixels, pixels, width, height, spread, least)
    return kept.unionByName(mask_pixels.join(kept.select(*ids).distinct(), ids, "left_anti").select(*ids, "v", "u"))


def fuse_refined(masks: DataFrame, mask_pixels: DataFrame, pixels: DataFrame, width: int, height: int,
                 spread: float = SPREAD, least: int = 100, min_area: int = MIN_AREA,
                 max_area: int = MAX_AREA) -> DataFrame:
    """Fused masks without the pixels that do not fit their depth.  A mask that was refined takes its
    depth from what is left of it; the others keep that of their parts."""
    ids = ["frame_key", "group_id"]
    props, px = fused(masks, mask_pixels)
    px = checkpoint(px.withColumnRenamed("group_id", "mask_id"))
    kept = refined_pixels(px, pixels, width, height, spread, least)
    rest = px.join(kept.select("frame_key", "mask_id").distinct(), ["frame_key", "mask_id"], "left_anti")
    size = shape(kept.unionByName(rest.select(*kept.columns))).withColumnRenamed("mask_id", "group_id")
    depth = depth_stats(kept, pixels).select("frame_key", F.col("mask_id").alias("group_id"), F.col("median_m").alias("_left_m"))
    return (size.filter(F.col("area").between(min_area, max_area)).join(props, ids).join(depth, ids, "left")
            .withColumn("depth_median", F.coalesce("_left_m", "depth_median")).drop("_left_m"))


def split_masks(mask_pixels: DataFrame, pixels: DataFrame, width: int, height: int,
                spread: float = SPREAD, least: int = 100, most: int = 3) -> DataFrame:
    """Masks over several depths fall into parts; a mask without a large enough part stays whole."""
    ids = ["frame_key", "mask_id"]
    k = F.least(F.lit(most), F.greatest(F.lit(2), F.floor(F.round(F.col("std_m") / spread, 9))))
    s = checkpoint(split_by_depth(mask_pixels, pixels, k, 2 * spread, least))
    sized = s.filter(F.col("part").isNotNull()).groupBy(*ids, "part").agg(
        F.count(F.lit(1)).alias("n"), (F.median("depth_raw") / 1000).alias("depth_median")).filter(
        F.col("n") >= least).drop("n")
    pid = [*ids, "part"]
    parts = s.join(sized.select(*pid), pid, "left_semi").select(*pid, "v", "u")
    closed = morphology(parts, pid, CLOSE, width, height)
    whole = s.join(sized.select(*ids).distinct(), ids, "left_anti").select(
        *ids, F.lit(-1).alias("part"), "v", "u")
    return shape(closed.unionByName(whole), tuple(pid)).join(sized, pid, "left")

