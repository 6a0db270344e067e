"""Attributes of persons, vehicles and other objects from their pixels and key points.

Crops are long tables ``(mask_id, v, u, h, w, ...)`` with ``v`` and ``u`` counted from the corner of the crop,
so thousands of crops are measured by one aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetsight.functions import color
from fleetsight.functions.scalar import clamp
from fleetsight.functions.vectors import bind, l2_normalize, softmax_weights, total
from fleetsight.functions.windows import latest
from fleetsight.operators.blocks import slices
from fleetsight.operators.depth import image_rows, neighbour_rows, sobel

# Key points in order of the pose vector.
KEYPOINTS = ("nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder",
             "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip",
             "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle")
# Vehicle type of a class name, and expected width / height of each type.
TYPE_OF_CLASS = {"car": "sedan", "sedan": "sedan", "suv": "suv", "truck": "truck", "pickup": "pickup",
                 "van": "van", "bus": "bus", "motorcycle": "motorcycle", "motorbike": "motorcycle",
                 "bicycle": "bicycle", "bike": "bicycle"}
EXPECTED_RATIO = {"sedan": 1.5, "suv": 1.2, "truck": 2.0, "van": 1.0, "bus": 3.0, "pickup": 2.2,
                  "motorcycle": 0.5, "bicycle": 0.6}
# Clothing regions as fractions of the crop (x1, y1, x2, y2).
UPPER, LOWER = (0.1, 0.2, 0.9, 0.5), (0.1, 0.5, 0.9, 0.95)
# Fixed value: how far an outline may lie from its corners' polygon, as a share of its length.
CORNER_TOLERANCE = 0.02
#: Pixels of image rows whose bins are counted at once.
PIXELS = 500_000


def crops(boxes: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of every box, clamped to the image; boxes without pixels disappear."""
    b = boxes.select("frame_key", "mask_id", *[clamp(F.col(c), 0, n).alias(c) for c, n in (
        ("x1", width), ("y1", height), ("x2", width), ("y2", height))]).filter("x2 > x1 AND y2 > y1")
    at = b.withColumn("_v", F.explode(F.expr("sequence(y1, y2 - 1)"))).withColumn(
        "_u", F.explode(F.expr("sequence(x1, x2 - 1)")))
    j = at.join(pixels.withColumnsRenamed({"v": "_v", "u": "_u"}), ["frame_key", "_v", "_u"])
    return j.select("frame_key", "mask_id", (F.col("_v") - F.col("y1")).alias("v"),
                    (F.col("_u") - F.col("x1")).alias("u"), (F.col("y2") - F.col("y1")).alias("h"),
                    (F.col("x2") - F.col("x1")).alias("w"), "b", "g", "r", "depth_raw")


def with_hsv(crop: DataFrame) -> DataFrame:
    h, s, v = color.hsv(F.col("b"), F.col("g"), F.col("r"))
    return crop.select("*", h.alias("hue"), s.alias("sat"), v.alias("val"))


# --- color ------------------------------------------------------------------------------------

def dominant_colors(crop: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most common color names of each crop with their share."""
    c = with_hsv(crop).groupBy("mask_id", color.pixel_color(F.col("hue"), F.col("sat"), F.col("val")).alias(
        "color")).agg(F.count(F.lit(1)).alias("n"))
    sums = c.groupBy("mask_id").agg(F.sum("n").alias("_total"))
    top = latest(c.join(sums, "mask_id"), ["mask_id"], [F.desc("n"), F.asc("color")], n, "position")
    top = top.withColumn("share", F.col("n") / F.col("_total"))
    lots = top.groupBy("mask_id").agg(
        ((F.count(F.lit(1)) > 2) | (F.coalesce(F.max(F.when(F.col("position") == 2, F.col("share"))),
                                               F.lit(0.0)) > 0.3)).alias("multicolored"))
    return top.join(lots, "mask_id").select("mask_id", "color", "share", "position", "multicolored")


def paint(crop: DataFrame) -> DataFrame:
    """Vehicle color from the body part of the crop, with a second color for two-tone paint.

    Means and spreads come from sums of whole numbers, so that they do not depend on the order of rows.
    """
    c = with_hsv(crop)
    u, v, w, h = (F.col(n) for n in ("u", "v", "w", "h"))
    part = lambda size, f: F.floor(F.round(size * f, 9))
    inside = (v >= part(h, 0.3)) & (v < part(h, 0.8)) & (u >= part(w, 0.1)) & (u < part(w, 0.9))
    top, bottom = v < part(h, 0.3), v >= part(h, 0.7)
    whole = lambda cond, name: F.when(cond, F.col(name).cast("long"))
    mean = lambda cond, name: F.sum(whole(cond, name)) / F.count(whole(cond, name))

    def spread(cond, name):
        x = whole(cond, name)
        n, total = F.count(x), F.sum(x)
        return (n * F.sum(x * x) - total * total) / (n * n)

    every = F.lit(True)
    g = c.groupBy("mask_id").agg(
        *[F.coalesce(mean(inside, n), mean(every, n)).alias(n) for n in ("hue", "sat", "val")],
        F.coalesce(spread(inside, "val"), spread(every, "val")).alias("_var"),
        F.sqrt(F.coalesce(spread(inside, "sat"), spread(every, "sat"))).alias("_sd"),
        *[mean(top, n).alias(f"_t_{n}") for n in ("hue", "sat", "val")], mean(bottom, "hue").alias("_b_hue"))
    first = color.vehicle_color(F.col("hue"), F.col("sat"), F.col("val"))
    second = color.vehicle_color(F.col("_t_hue"), F.col("_t_sat"), F.col("_t_val"))
    g = g.withColumn("color", first).withColumn("_second", second)
    two = (F.abs(F.col("_t_hue") - F.col("_b_hue")) > 30) & (F.col("_second") != F.col("color"))
    return g.select("mask_id", "color", F.when(two, F.col("_second")).alias("second_color"),
                    (F.col("_var") > 1000).alias("metallic"),
                    F.greatest(F.lit(0.5), 1.0 - F.col("_sd") / 128).alias("color_confidence"))


def default_regions(boxes: DataFrame) -> DataFrame:
    """Upper and lower clothing region of each crop, as fractions of its size."""
    part = lambda size, f: F.floor(F.round(F.col(size) * f, 9)).cast("int")
    region = lambda name, r: F.struct(F.lit(name).alias("region"), part("w", r[0]).alias("rx1"),
                                      part("h", r[1]).alias("ry1"), part("w", r[2]).alias("rx2"),
                                      part("h", r[3]).alias("ry2"))
    both = F.explode(F.array(region("upper", UPPER), region("lower", LOWER)))
    return boxes.select("mask_id", both.alias("x")).select("mask_id", "x.*")


def cloth_colors(crop: DataFrame, regions: DataFrame) -> DataFrame:
    """Color of each clothing region: mean saturation and value, most frequent hue (lowest on ties)."""
    j = with_hsv(crop).join(regions, "mask_id").filter(
        (F.col("u") >= F.col("rx1")) & (F.col("u") < F.col("rx2"))
        & (F.col("v") >= F.col("ry1")) & (F.col("v") < F.col("ry2")))
    hist = j.groupBy("mask_id", "region", "hue").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sat").alias("_s"), F.sum("val").alias("_v"))
    g = hist.groupBy("mask_id", "region").agg(
        F.max_by("hue", F.struct(F.col("n"), -F.col("hue"))).alias("hue"),
        (F.sum("_s") / F.sum("n")).alias("sat"), (F.sum("_v") / F.sum("n")).alias("val"))
    return g.select("mask_id", "region",
                    color.clothing_color(F.col("hue"), F.col("sat"), F.col("val")).alias("color"))


def cloth_type(region: Column, w: Column, h: Column) -> Column:
    upper = (F.when(w / F.greatest(h, F.lit(1)) > 1.5, "jacket")
             .when(w / F.greatest(h, F.lit(1)) < 0.6, "vest").otherwise("shirt"))
    lower = F.when(h / F.greatest(w, F.lit(1)) > 2.0, "pants").otherwise("shorts")
    kind = F.when(region == "upper", upper).otherwise(lower)
    return F.when((w <= 0) | (h <= 0), "unknown").otherwise(kind)


# --- vehicles ---------------------------------------------------------------------------------

def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def type_from_class(name: Column) -> Column:
    return F.coalesce(_map(TYPE_OF_CLASS)[F.lower(name)], F.lit("unknown"))


def type_from_shape(w: Column, h: Column, wheels: Column) -> Column:
    """Vehicle type from crop size and wheel count."""
    r = w / F.greatest(h, F.lit(1))
    narrow = (r < 0.8) & (wheels <= 2)
    return (F.when(narrow & (h > w * 1.5), "motorcycle").when(narrow, "bicycle")
            .when((r > 2.5) & (h > 200), "bus").when(r > 2.5, "truck")
            .when((r < 1.3) & (h * w > 50000), "van").when(r < 1.3, "suv")
            .when(r <= 2.0, "sedan").when(r <= 2.5, "pickup").otherwise("unknown"))


def type_confidence(kind: Column, ratio: Column) -> Column:
    expected = F.coalesce(_map(EXPECTED_RATIO)[kind], F.lit(1.5))
    return F.greatest(F.lit(0.3), 1.0 - F.abs(ratio - expected) / expected)


def vehicle_type(df: DataFrame, class_col: str, w: str, h: str, wheels: str) -> DataFrame:
    """Type with confidence: the class name decides where it names a type, else the shape."""
    ratio = F.col(w) / F.greatest(F.col(h), F.lit(1))
    hint = type_from_class(F.col(class_col))
    shape = type_from_shape(F.col(w), F.col(h), F.col(wheels))
    d = df.withColumn("_known", hint != "unknown").withColumn(
        "vehicle_type", F.when(F.col("_known"), hint).otherwise(shape)).withColumn("aspect_ratio", ratio)
    sure = type_confidence(F.col("vehicle_type"), F.col("aspect_ratio"))
    return d.withColumn("type_confidence", F.when(F.col("_known"), 0.8).otherwise(sure)).drop("_known")


def orientation(crop: DataFrame) -> DataFrame:
    """Front, rear or side from left/right symmetry and brightness; one pass, no self-join."""
    y = color.gray(F.col("b"), F.col("g"), F.col("r"))
    u, v, w, h = (F.col(n) for n in ("u", "v", "w", "h"))
    half = F.floor(w / 2)
    third = lambda n, k: F.floor(n * k / 3)
    c = crop.select("mask_id", "v", "u", "w", "h", y.alias("y"))
    # Mirrored columns fall into one group; the middle column of an odd width has no partner.
    pairs = c.groupBy("mask_id", "v", F.least(u, w - 1 - u).alias("_p")).agg(
        F.abs(F.sum(F.when(u < half, F.col("y")).when(u >= w - half, -F.col("y")).otherwise(0))).alias("_d"),
        F.max(F.when((u < half) | (u >= w - half), 1).otherwise(0)).alias("_both"),
        *[F.sum(F.when(cond, F.col("y"))).alias(f"s_{n}") for n, cond in _zones(u, v, w, h, third)],
        *[F.count_if(cond).alias(f"n_{n}") for n, cond in _zones(u, v, w, h, third)])
    g = pairs.groupBy("mask_id").agg(
        F.avg(F.when(F.col("_both") == 1, F.col("_d"))).alias("asymmetry"),
        *[(F.sum(f"s_{n}") / F.sum(f"n_{n}")).alias(n) for n in ("top", "bottom", "left", "right")])
    side = (F.when(F.col("left") > F.col("right") + 10, "side_left")
            .when(F.col("right") > F.col("left") + 10, "side_right").otherwise("unknown"))
    return g.select("mask_id", "asymmetry", F.when(
        F.col("asymmetry") < 30, F.when(F.col("top") > F.col("bottom") + 20, "front").otherwise("rear"))
        .otherwise(side).alias("orientation"))


def _zones(u, v, w, h, third):
    return (("top", v < third(h, 1)), ("bottom", v >= third(h, 2)),
            ("left", u < third(w, 1)), ("right", u >= third(w, 2)))


# --- persons ----------------------------------------------------------------------------------

def parse_pose(vec: Column, in_w: float, in_h: float, pad_w: float, pad_h: float, scale: float,
               image_w: int, image_h: int) -> tuple[Column, Column]:
    """Pose vector (box, confidence, 17 key points) to an image box and a key-point array."""
    at = lambda i: F.get(vec, F.lit(i) if isinstance(i, int) else i)
    back_x = lambda x: (x * in_w - pad_w) / scale
    back_y = lambda y: (y * in_h - pad_h) / scale
    edge = lambda c, size, back, sign, n: clamp(back(at(c) + sign * at(size) / 2), 0.0, float(n)).cast("int")
    box = F.struct(edge(0, 2, back_x, -1, image_w).alias("x1"), edge(1, 3, back_y, -1, image_h).alias("y1"),
                   edge(0, 2, back_x, 1, image_w).alias("x2"), edge(1, 3, back_y, 1, image_h).alias("y2"))
    names = F.array(*[F.lit(n) for n in KEYPOINTS])
    points = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct(
        F.get(names, i).alias("name"), back_x(at(5 + i * 3)).alias("x"),
        back_y(at(6 + i * 3)).alias("y"), at(7 + i * 3).alias("confidence")))
    return box, points


def keypoint_map(points: Column, above: float = 0.1) -> Column:
    seen = F.filter(points, lambda p: p["confidence"] > above)
    return F.map_from_entries(F.transform(seen, lambda p: F.struct(p["name"], F.struct(
        p["x"].alias("x"), p["y"].alias("y"), p["confidence"].alias("confidence")))))


def _point(points: Column, name: str, at_least: float) -> Column:
    p = F.get(points, KEYPOINTS.index(name))
    return F.when(p["confidence"] >= at_least, p)


def posture(points: Column, at_least: float = 0.3) -> Column:
    p = {n: _point(points, n, at_least) for n in KEYPOINTS}
    hip = F.coalesce(p["left_hip"], p["right_hip"])
    shoulder = F.coalesce(p["left_shoulder"], p["right_shoulder"])
    tall, wide = F.abs(hip["y"] - shoulder["y"]), F.abs(hip["x"] - shoulder["x"])

    def bent(side: str) -> Column:
        h, k, a = p[f"{side}_hip"], p[f"{side}_knee"], p[f"{side}_ankle"]
        seen = h.isNotNull() & k.isNotNull() & a.isNotNull()
        return seen & (F.abs(h["y"] - k["y"]) < F.abs(k["y"] - a["y"]) * 0.5)

    return (F.when(hip.isNull() | shoulder.isNull(), "unknown").when(wide > tall * 1.5, "lying")
            .when(bent("left") | bent("right"), "sitting").otherwise("standing"))


def pose_regions(points: Column, w: Column, h: Column) -> Column:
    """Clothing regions from shoulders, hips and knees, with the default region where they are not
    seen; an array of (region, rx1, ry1, rx2, ry2)."""
    p = {n: F.when(F.get(points, KEYPOINTS.index(n))["confidence"] > 0.3,
                   F.get(points, KEYPOINTS.index(n)))
         for n in KEYPOINTS if n.split("_")[-1] in ("shoulder", "hip", "knee")}
    low = lambda part, c: F.least(p[f"left_{part}"][c], p[f"right_{part}"][c])
    high = lambda part, c: F.greatest(p[f"left_{part}"][c], p[f"right_{part}"][c])
    seen = lambda part: p[f"left_{part}"].isNotNull() & p[f"right_{part}"].isNotNull()
    whole = lambda c: c.cast("int")
    cut = lambda size, f: F.floor(F.round(size * f, 9)).cast("int")

    def region(name, ok, x1, y1, x2, y2, default):
        cols = [F.when(ok, c).otherwise(cut(n, f)).alias(a) for c, n, f, a in zip(
            (x1, y1, x2, y2), (w, h, w, h), default, ("rx1", "ry1", "rx2", "ry2"))]
        return F.struct(F.lit(name).alias("region"), *cols)

    zero = F.lit(0)
    up = region("upper", seen("shoulder") & seen("hip"),
                F.greatest(zero, whole(low("shoulder", "x") - w * 0.1)),
                F.greatest(zero, whole(low("shoulder", "y"))),
                F.least(w, whole(high("shoulder", "x") + w * 0.1)), F.least(h, whole(high("hip", "y"))), UPPER)
    foot = F.when(seen("knee"), F.least(h, whole(high("knee", "y") + h * 0.1))).otherwise(cut(h, 0.95))
    down = region("lower", seen("hip"), F.greatest(zero, whole(low("hip", "x") - w * 0.1)),
                  F.greatest(zero, whole(low("hip", "y"))), F.least(w, whole(high("hip", "x") + w * 0.1)),
                  foot, LOWER)
    return F.array(up, down)


# --- other objects ------------------------------------------------------------------------------

def top_classes(rows: DataFrame, key: str, scores: str, k: int = 5) -> DataFrame:
    """The ``k`` most likely classes; scores become probabilities unless they already are."""
    s = F.col(scores)
    raw = (F.array_max(s) > 1.0) | (F.array_min(s) < 0.0)
    soft = bind(softmax_weights(s), lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t)))
    p = F.when(raw, soft).otherwise(s)
    # k of a vector of fixed length: sort inside the row, nothing is shuffled.
    ranked = F.slice(F.array_sort(F.transform(p, lambda x, i: F.struct(
        (-x).alias("m"), i.alias("i")))), 1, k)
    out = rows.select(key, F.posexplode(ranked).alias("position", "e"))
    return out.select(key, (F.col("position") + 1).alias("position"), F.col("e.i").alias("class_id"),
                      (-F.col("e.m")).alias("probability"))


def shape_type(aspect: Column, circularity: Column, vertices: Column, solidity: Column) -> Column:
    squarish = (aspect > 0.8) & (aspect < 1.2)
    return (F.when((circularity > 0.8) & squarish, "circular").when(circularity > 0.8, "oval")
            .when((vertices == 4) & (solidity > 0.9) & squarish, "square")
            .when((vertices == 4) & (solidity > 0.9), "rectangular").when(vertices == 3, "triangular")
            .when(solidity < 0.7, "irregular").otherwise("polygon"))


def outline(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Closed outline through the centres of the first (a) and last (b) pixel of every row: down the left
    side and up the right one."""
    order = np.argsort(v, kind="stable")
    v, a, b = v[order], a[order], b[order]
    points = np.stack([np.concatenate([a, b[::-1]]), np.concatenate([v, v[::-1]])], 1).astype(float)
    return points[np.concatenate([[True], (points[1:] != points[:-1]).any(1)])]


def outline_circularity(points: np.ndarray) -> float:
    """4 pi area / perimeter^2 of a closed outline: 1 for a circle, 0 for a line or a point."""
    step = np.roll(points, -1, 0) - points
    length = np.hypot(*step.T).sum()
    area = abs((points[:, 0] * np.roll(points[:, 1], -1) - points[:, 1] * np.roll(points[:, 0], -1)).sum()) / 2
    return float(4 * np.pi * area / max(length * length, 1.0))


def corner_count(points: np.ndarray, tolerance: float = CORNER_TOLERANCE) -> int:
    """Corners of a closed outline that are left when points nearer than ``tolerance`` times its length to the
    line between their neighbouring corners are dropped, from the two points farthest apart along the way."""
    far = lambda p: int(np.argmax(((points - p) ** 2).sum(1)))
    least = tolerance * np.hypot(*(np.roll(points, -1, 0) - points).T).sum()
    i = far(points[0])
    points = np.roll(points, -i, 0)
    ring, j = np.concatenate([points, points[:1]]), far(points[0])
    if j == 0:
        return 1
    kept, todo = {0, j}, [(0, j), (j, len(ring) - 1)]
    while todo:
        s, e = todo.pop()
        if e - s < 2:
            continue
        (x, y), (dx, dy) = (ring[s + 1:e] - ring[s]).T, ring[e] - ring[s]
        off = np.abs(x * dy - y * dx) / np.hypot(dx, dy) if dx or dy else np.hypot(x, y)
        k = int(np.argmax(off))
        if off[k] > least:
            kept.add(s + 1 + k)
            todo += [(s, s + 1 + k), (s + 1 + k, e)]
    return len(kept)


def _first_max(x: np.ndarray, starts: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Index of the first maximum of each part of ``x``."""
    at = np.flatnonzero(x == np.maximum.reduceat(x, starts)[part])
    return at[np.unique(part[at], return_index=True)[1]]


def _starts(part: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(part, prepend=-1))


def _below_hull(part: np.ndarray, y: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Twice the area between the axis and the lower hull of each part's points, the lowest of each ``y``."""
    order = np.lexsort((x, y, part))
    part, y, x = part[order], y[order], x[order]
    keep = np.ones(len(y), bool)
    keep[1:] = (part[1:] != part[:-1]) | (y[1:] != y[:-1])
    while not keep.all():
        part, y, x = part[keep], y[keep], x[keep]
        keep = np.ones(len(y), bool)
        # A point on or above the line between its neighbours is no corner of the hull.
        turn = (y[1:-1] - y[:-2]) * (x[2:] - x[:-2]) - (x[1:-1] - x[:-2]) * (y[2:] - y[:-2])
        keep[1:-1] = (turn > 0) | (part[1:-1] != part[:-2]) | (part[1:-1] != part[2:])
    same = part[1:] == part[:-1]
    twice = np.zeros(n, np.int64)
    np.add.at(twice, part[1:][same], ((x[1:] + x[:-1]) * (y[1:] - y[:-1]))[same])
    return twice


def _corner_counts(points: np.ndarray, part: np.ndarray, starts: np.ndarray, n: np.ndarray, length: np.ndarray,
                   tolerance: float = CORNER_TOLERANCE) -> np.ndarray:
    """``corner_count`` of many outlines: point lists one behind the other."""
    far = lambda p, s, k: _first_max(((p - p[s][k]) ** 2).sum(1), s, k) - s
    turn = far(points, starts, part)
    # Each ring begins at its first corner and ends there again.
    size = n + 1
    begin = np.cumsum(size) - size
    own = np.repeat(np.arange(len(n)), size)
    place = np.arange(len(own)) - begin[own]
    ring = points[starts[own] + (turn[own] + place) % n[own]]
    kept = place == n[own]
    kept[begin] = kept[begin + far(ring, begin, own)] = True
    least = tolerance * length
    left = np.flatnonzero(~kept)
    while len(left):
        corners = np.flatnonzero(kept)
        piece = np.searchsorted(corners, left) - 1
        s, e = corners[piece], corners[piece + 1]
        (x, y), (dx, dy) = (ring[left] - ring[s]).T, (ring[e] - ring[s]).T
        line = np.hypot(dx, dy)
        off = np.where(line > 0, np.abs(x * dy - y * dx) / np.where(line > 0, line, 1), np.hypot(x, y))
        piece = np.cumsum(np.diff(piece, prepend=-1) != 0) - 1
        best = _first_max(off, _starts(piece), piece)
        split = off[best] > least[own[left[best]]]
        kept[left[best[split]]] = True
        left = left[split[piece]]
        left = left[~kept[left]]
    # An outline of one place has no second corner.
    return np.add.reduceat(kept.astype(np.int64), begin) - 1


def _row_shapes(part: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, masks: int) -> dict[str, np.ndarray]:
    """Hull area, circularity and corners of masks 0, 1, ... from the ends of their pixel rows."""
    order = np.lexsort((v, part))
    part, v, a, b = part[order], v[order], a[order], b[order]
    twice = lambda x: _below_hull(np.tile(part, 2), np.concatenate([v, v + 1]), np.tile(x, 2), masks)
    hull = (-twice(-b) - twice(a)) / 2
    # The outlines of ``outline``, one behind the other.
    rows = np.bincount(part, minlength=masks)
    at = np.arange(len(part)) + (np.cumsum(rows) - rows)[part]
    back = 2 * (np.cumsum(rows) - rows)[part] + 2 * (np.cumsum(rows))[part] - 1 - at
    points, owner = np.empty((2 * len(part), 2)), np.empty(2 * len(part), np.int64)
    points[at], points[back] = np.stack([a, v], 1), np.stack([b - 1, v], 1)
    owner[at] = owner[back] = part
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (points[1:] != points[:-1]).any(1)
    points, owner = points[keep], owner[keep]
    starts, n = _starts(owner), np.bincount(owner, minlength=masks)
    after = np.arange(1, len(owner) + 1)
    after[starts + n - 1] = starts
    length = np.add.reduceat(np.hypot(*(points[after] - points).T), starts)
    area = np.abs(np.add.reduceat(points[:, 0] * points[after, 1] - points[after, 0] * points[:, 1], starts)) / 2
    return {"hull": hull, "circularity": 4 * np.pi * area / np.maximum(length * length, 1.0),
            "vertices": _corner_counts(points, owner, starts, n, length)}


def shape_features(mask_pixels: DataFrame, ids: tuple[str, ...] = ("frame_key", "mask_id")) -> DataFrame:
    """Aspect ratio, extent, solidity, circularity and number of corners.  Hull and outline see only the ends
    of every pixel row, at most two points per image row whatever the size of the mask."""
    rows = mask_pixels.groupBy(*ids, "v").agg(F.min("u").alias("a"), (F.max("u") + 1).alias("b"),
                                              F.count(F.lit(1)).alias("n"))

    def shapes(batches):
        for b in slices(batches, "v"):
            part = np.repeat(np.arange(b.num_rows), np.diff(b.column("v").offsets.to_numpy()))
            ends = [b.column(c).flatten().to_numpy().astype(np.int64) for c in ("v", "a", "b")]
            x = _row_shapes(part, *ends, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in [*ids, "area", "w", "h"]], pa.array(x["hull"]), pa.array(x["circularity"]),
                 pa.array(x["vertices"].astype("int32"))], names=[*ids, "area", "w", "h", "hull", "circularity", "vertices"])

    kinds = ", ".join(f"{c} long" for c in ids)
    g = rows.groupBy(*[F.col(c).cast("long").alias(c) for c in ids]).agg(
        F.sum("n").alias("area"), (F.max("b") - F.min("a")).alias("w"),
        (F.max("v") - F.min("v") + 1).alias("h"), *[F.collect_list(F.col(c).cast("int")).alias(c) for c in ("v", "a", "b")])
    g = g.mapInArrow(shapes, f"{kinds}, area long, w int, h int, hull double, circularity double, vertices int")
    return g.select(
        *ids, "area", (F.col("w") / F.greatest(F.col("h"), F.lit(1))).alias("aspect_ratio"),
        (F.col("area") / F.greatest(F.col("w") * F.col("h"), F.lit(1))).alias("extent"),
        (F.col("area") / F.greatest(F.col("hull"), F.lit(1.0))).alias("solidity"), "circularity", "vertices")


def physical_size(boxes: DataFrame, crop: DataFrame, focal: float = 600.0) -> DataFrame:
    """Width and height in metres from the median valid depth in the box."""
    m = crop.filter("depth_raw > 0").groupBy("mask_id").agg((F.median("depth_raw") / 1000).alias("depth_m"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.join(m, "mask_id", "left").select(
        "mask_id", w.alias("pixel_width"), h.alias("pixel_height"), (w * h).alias("pixel_area"),
        (w * F.col("depth_m") / focal).alias("real_width_m"), (h * F.col("depth_m") / focal).alias(
            "real_height_m"), "depth_m")


# --- embeddings -----------------------------------------------------------------------------------

def _bin_counts(crop: DataFrame, bins: int) -> DataFrame:
    """``(mask_id, slot, n)``: pixels of every crop in each bin of hue, saturation, value, gradient size and direction, as
    partial counts of a batch of image rows."""
    c = with_hsv(crop)
    ids = [*[k for k in ("frame_key",) if k in crop.columns], "mask_id", "h"]
    color_bin = lambda n, top: F.least(F.lit(bins - 1), F.floor(F.col(n) * bins / top).cast("int"))
    y = color.gray(F.col("b"), F.col("g"), F.col("r"))
    packed = (color_bin("hue", 180) * bins + color_bin("sat", 256)) * bins + color_bin("val", 256)
    # A gray value has 8 bits; the bins of the color lie above them and follow a pixel into its row.
    rows = image_rows(c, y + packed * 256, ids)
    rows3 = neighbour_rows(rows, ids, F.col("h"))

    def run(batches):
        for b in batches:
            masks, row_mask = np.unique(b["mask_id"].to_numpy(), return_inverse=True)
            n = np.zeros(len(masks) * 5 * bins, np.int64)
            for width, at in pd.Series(np.arange(len(b))).groupby(b["x"].map(len).to_numpy()):
                most = max(1, PIXELS // width)
                for rows in (at.to_numpy()[i:i + most] for i in range(0, len(at), most)):
                    part = b.iloc[rows]
                    up, mid, down = (np.stack(part[c].to_numpy()).astype(np.int64) for c in ("up", "x", "down"))
                    gx, gy = sobel(up & 255, mid & 255, down & 255)
                    size = np.sqrt((gx * gx + gy * gy).astype(np.float64))
                    turn = (np.arctan2(gy, gx) + math.pi) / (2 * math.pi) * bins
                    # Sizes beyond 255 fall outside the histogram.
                    a = np.minimum(bins - 1, size / 255 * bins).astype(np.int64)
                    d = np.minimum(bins - 1, np.floor(np.round(turn, 9))).astype(np.int64)
                    colors = mid >> 8
                    slots = [colors // (bins * bins), colors // bins % bins, colors % bins, a, d]
                    base = row_mask[rows][:, None] * (5 * bins)
                    for k, x in enumerate(slots):
                        x = base + k * bins + x
                        n += np.bincount(x[size <= 255] if k == 3 else x.ravel(), minlength=len(n))
            at = np.flatnonzero(n)
            yield pd.DataFrame({"mask_id": masks[at // (5 * bins)], "slot": (at % (5 * bins)).astype("int32"), "n": n[at]})

    return rows3.select("mask_id", "up", "x", "down").mapInPandas(run, "mask_id long, slot int, n long")


def histogram_embeddings(crop: DataFrame, bins: int = 32, dim: int = 512) -> DataFrame:
    """Unit vector per crop: hue, saturation and value histograms plus gradient size and direction.

    Pixels are counted beside their image rows; only the five short histograms of a crop are gathered.
    """
    n = _bin_counts(crop, bins).groupBy("mask_id", "slot").agg(F.sum("n").alias("n"))
    gathered = n.groupBy("mask_id").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns"))

    def fill(batches):
        for g in batches:
            if not len(g):
                continue
            row = np.repeat(np.arange(len(g)), [len(x) for x in g["slots"]])
            counts = np.zeros((len(g), max(dim, 5 * bins)))
            counts[row, np.concatenate(g["slots"].to_numpy())] = np.concatenate(g["ns"].to_numpy())
            five = counts[:, :5 * bins].reshape(len(g), 5, bins)
            five /= np.maximum(five.sum(2, keepdims=True), 1)
            out = counts[:, :dim]
            out /= np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.DataFrame({"mask_id": g["mask_id"], "embedding": list(out)})

    return gathered.mapInPandas(fill, "mask_id long, embedding array<double>")


def object_embeddings(boxes: DataFrame, crop: DataFrame, deep: DataFrame, dim: int = 512) -> DataFrame:
    """Embedding per detection: the model's vector for persons that have one, else the histogram;
    a box without pixels gets zeros."""
    h = histogram_embeddings(crop, dim=dim).withColumnRenamed("embedding", "_h")
    j = boxes.select("mask_id", "class_name").join(h, "mask_id", "left").join(
        deep.select("mask_id", F.col("embedding").alias("_d")), "mask_id", "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    use = F.when((F.col("class_name") == "person") & F.col("_d").isNotNull(),
                 l2_normalize(F.col("_d"))).otherwise(F.coalesce("_h", zero))
    return j.select("mask_id", "class_name", use.alias("embedding"))


# --- mask head ------------------------------------------------------------------------------------

def decode_boxes(rows: DataFrame, dist: str, bins: int = 16) -> DataFrame:
    """Boxes from four distance distributions per anchor (columns ``stride``, ``gx``, ``gy``)."""
    def expected(side: int) -> Column:
        part = F.slice(dist, side * bins + 1, bins)
        mean = bind(softmax_weights(part), lambda e: total(F.transform(e, lambda x, i: x * i)) / total(e))
        return mean * F.col("stride")

    cx, cy = (F.col("gx") + 0.5) * F.col("stride"), (F.col("gy") + 0.5) * F.col("stride")
    return rows.withColumns({"x1": cx - expected(0), "y1": cy - expected(1),
                             "x2": cx + expected(2), "y2": cy + expected(3)})


def prototype_masks(det: DataFrame, protos: DataFrame, above: float = 0.5) -> DataFrame:
    """Pixels where the weighted sum of the prototype channels passes, inside the box.

    ``det(frame_key, mask_id, coeffs, x1, y1, x2, y2)``, ``protos(frame_key, v, u, channels)``.
    """
    at = det.withColumn("v", F.explode(F.expr("sequence(y1, y2 - 1)"))).withColumn(
        "u", F.explode(F.expr("sequence(x1, x2 - 1)"))).select("frame_key", "mask_id", "coeffs", "v", "u")
    j = at.join(protos, ["frame_key", "v", "u"])
    z = F.aggregate(F.zip_with("coeffs", "channels", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp(z, -50.0, 50.0)))
    return j.withColumn("score", score).filter(F.col("score") > above).select(
        "frame_key", "mask_id", "v", "u", "score")
