"""Queries over image values and object attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.functions import color
from fleetsight.functions.scalar import sigmoid
from fleetsight.operators import attributes as at, identity as idn, imaging as im, masks as mk, routing
from fleetsight.operators.tracking import keep_best_boxes
from fleetsight.plans.registry import query
from fleetsight.sources import derive as src

W, H = src.GRID_W, src.GRID_H


def _cast(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- conversions ------------------------------------------------------------------------------

@query("F13_gray", """
SELECT frame_key, v, sum((b * 1868 + g * 9617 + r * 4899 + 8192) // 16384)::BIGINT AS gray FROM pixels GROUP BY 1, 2""")
def f13(spark, d):
    p = im.convert_color(src.pixels(spark, d), "BGR", "GRAY")
    return p.groupBy("frame_key", "v").agg(F.sum("gray").alias("gray"))


@query("F13_lab", """
WITH c AS (SELECT frame_key, b / 255.0::DOUBLE AS b, g / 255.0::DOUBLE AS g, r / 255.0::DOUBLE AS r FROM pixels),
l AS (SELECT frame_key, CASE WHEN b <= 0.04045::DOUBLE THEN b / 12.92::DOUBLE ELSE pow((b + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS b,
 CASE WHEN g <= 0.04045::DOUBLE THEN g / 12.92::DOUBLE ELSE pow((g + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS g,
 CASE WHEN r <= 0.04045::DOUBLE THEN r / 12.92::DOUBLE ELSE pow((r + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS r FROM c),
t AS (SELECT frame_key, (r * 0.412453::DOUBLE + g * 0.357580::DOUBLE + b * 0.180423::DOUBLE) / 0.950456::DOUBLE AS x,
 r * 0.212671::DOUBLE + g * 0.715160::DOUBLE + b * 0.072169::DOUBLE AS y,
 (r * 0.019334::DOUBLE + g * 0.119193::DOUBLE + b * 0.950227::DOUBLE) / 1.088754::DOUBLE AS z FROM l),
f AS (SELECT frame_key, y, CASE WHEN x > 0.008856::DOUBLE THEN cbrt(x) ELSE x * 7.787::DOUBLE + 16.0::DOUBLE / 116 END AS fx,
 CASE WHEN y > 0.008856::DOUBLE THEN cbrt(y) ELSE y * 7.787::DOUBLE + 16.0::DOUBLE / 116 END AS fy,
 CASE WHEN z > 0.008856::DOUBLE THEN cbrt(z) ELSE z * 7.787::DOUBLE + 16.0::DOUBLE / 116 END AS fz FROM t),
o AS (SELECT frame_key, (CASE WHEN y > 0.008856::DOUBLE THEN cbrt(y) * 116 - 16 ELSE y * 903.3::DOUBLE END) * 255 / 100 AS l,
 (fx - fy) * 500 + 128 AS a, (fy - fz) * 200 + 128 AS b FROM f)
SELECT frame_key, sum(floor(greatest(0, least(255, l)) + 0.5))::BIGINT AS lab_l, sum(floor(greatest(0, least(255, a)) + 0.5))::BIGINT AS lab_a,
 sum(floor(greatest(0, least(255, b)) + 0.5))::BIGINT AS lab_b FROM o GROUP BY 1""")
def f13lab(spark, d):
    p = im.convert_color(src.pixels(spark, d), "BGR", "LAB")
    return p.groupBy("frame_key").agg(*[F.sum(c).alias(c) for c in ("lab_l", "lab_a", "lab_b")])


@query("F14_F15_value_scaling", """
SELECT frame_key, v, round(sum(b / 255.0::DOUBLE), 6) AS unit, sum(trunc(least(255, greatest(0, (value / 100) * 255))))::BIGINT AS bytes,
 round(sum(b / 255.0::DOUBLE * 2 - 1), 6) AS mapped FROM (SELECT *, b * 0.7::DOUBLE + 0.3 AS value FROM pixels) GROUP BY 1, 2""")
def f14(spark, d):
    p = src.pixels(spark, d)
    b = F.col("b")
    return p.groupBy("frame_key", "v").agg(
        F.round(F.sum(im.to_float(b)), 6).alias("unit"),
        F.sum(im.to_byte((b * 0.7 + 0.3) / 100)).alias("bytes"),
        F.round(F.sum(im.map_range(b, (0, 255), (-1, 1))), 6).alias("mapped"))


@query("F17_mask_image", """
SELECT m.mask_id, count(*) AS px, (255 * count(*) FILTER ((u + v) % 5 <> 0))::BIGINT AS total FROM masks m JOIN mask_pixels USING (frame_key, mask_id) GROUP BY 1""")
def f17(spark, d):
    holey = src.mask_pixels(spark, d).filter((F.col("u") + F.col("v")) % 5 != 0)
    img = im.mask_image(holey, src.masks(spark, d))
    return img.groupBy("mask_id").agg(F.count(F.lit(1)).alias("px"), F.sum("value").alias("total"))


@query("F16_resize", """
WITH tu AS (SELECT range AS tu, greatest(0::DOUBLE, least(63::DOUBLE, (range + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE)) AS x FROM range(40)),
tv AS (SELECT range AS tv, greatest(0::DOUBLE, least(47::DOUBLE, (range + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE)) AS y FROM range(30)),
g AS (SELECT tu, tv, x - floor(x) AS wx, y - floor(y) AS wy, floor(x)::INTEGER AS u0, floor(y)::INTEGER AS v0,
 least(63, floor(x) + 1)::INTEGER AS u1, least(47, floor(y) + 1)::INTEGER AS v1 FROM tu, tv),
s AS (SELECT tv, tu, unnest([v0, v0, v1, v1]) AS v, unnest([u0, u1, u0, u1]) AS u,
 unnest([(1 - wy) * (1 - wx), (1 - wy) * wx, wy * (1 - wx), wy * wx]) AS w FROM g),
p AS (SELECT frame_key, tv, tu, sum(w * g) AS g FROM s JOIN pixels USING (v, u) GROUP BY ALL)
SELECT frame_key, tv::INTEGER AS v, round(sum(g), 4) AS g, count(*) AS n FROM p GROUP BY ALL""")
def f16(spark, d):
    r = im.resize(src.pixels(spark, d), (W, H), (40, 30))
    return r.groupBy("frame_key", "v").agg(F.round(F.sum("g"), 4).alias("g"), F.count(F.lit(1)).alias("n"))


@query("F20_F21_box_conversions", """
SELECT det_id, round(greatest(0, least(640, (x1 - 20) / 0.8)), 6) AS ux1, round(greatest(0, least(480, (y2 - 60) / 0.8)), 6) AS uy2,
 (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, (y1 + y2) / 2 - (y2 - y1) / 2 AS back_y1 FROM base_detections""")
def f20(spark, d):
    b = src.base_detections(spark, d)
    cx, cy, w, h = im.center_size(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return b.select("det_id", F.round(im.unletterbox(F.col("x1"), 20, 0.8, 640), 6).alias("ux1"),
                    F.round(im.unletterbox(F.col("y2"), 60, 0.8, 480), 6).alias("uy2"),
                    cx.alias("cx"), cy.alias("cy"), w.alias("w"), im.corners(cx, cy, w, h)[1].alias("back_y1"))


@query("F38_depth_at_pixel", """
SELECT m.mask_id, round(coalesce(median(CASE WHEN depth_raw > 0 THEN depth_raw END) / 1000, 0), 6) AS depth_m FROM masks m
JOIN pixels p ON p.frame_key = m.frame_key AND abs(p.v - (m.y1 + m.y2) // 2) <= 1 AND abs(p.u - (m.x1 + m.x2) // 2) <= 1 GROUP BY 1""")
def f38(spark, d):
    m = src.masks(spark, d).select(
        "frame_key", "mask_id", F.floor((F.col("y1") + F.col("y2")) / 2).cast("int").alias("v"),
        F.floor((F.col("x1") + F.col("x2")) / 2).cast("int").alias("u"))
    return _cast(im.window_median(m, src.pixels(spark, d)).select("mask_id", "depth_m"), "depth_m")


@query("F39_depth_bytes", """
SELECT frame_key, v, sum(CASE WHEN depth_raw < 100 THEN 0 ELSE trunc(round((least(4.0, greatest(0.3, depth_raw / 1000)) - 0.3) / 3.7 * 255, 6)) END)::BIGINT AS total
FROM pixels GROUP BY 1, 2""")
def f39(spark, d):
    p = src.pixels(spark, d).withColumn("byte", im.depth_byte(F.col("depth_raw") / 1000, 0.3, 4.0))
    return p.groupBy("frame_key", "v").agg(F.sum("byte").alias("total"))


# --- colors -----------------------------------------------------------------------------------
CROP = """crop AS (SELECT m.mask_id, p.v - m.y1 AS v, p.u - m.x1 AS u, m.y2 - m.y1 AS h, m.x2 - m.x1 AS w, b, g, r, depth_raw FROM masks m
 JOIN pixels p ON p.frame_key = m.frame_key AND p.v >= m.y1 AND p.v < m.y2 AND p.u >= m.x1 AND p.u < m.x2),
c0 AS (SELECT *, greatest(b, g, r) AS val, greatest(b, g, r) - least(b, g, r) AS dd FROM crop),
c1 AS (SELECT *, CASE WHEN dd = 0 THEN 0.0::DOUBLE WHEN val = r THEN (g - b) * 60.0::DOUBLE / dd WHEN val = g THEN (b - r) * 60.0::DOUBLE / dd + 120
 ELSE (r - g) * 60.0::DOUBLE / dd + 240 END AS deg FROM c0),
c AS MATERIALIZED (SELECT *, (floor(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END / 2 + 0.5)::INTEGER % 180) AS hue,
 CASE WHEN val = 0 THEN 0 ELSE floor(dd * 255.0::DOUBLE / val + 0.5)::INTEGER END AS sat FROM c1)
"""


def _hues(bands, h):
    cases = " ".join(f"WHEN {h} BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in bands)
    return f"CASE {cases} ELSE 'unknown' END"


def _crops(spark, d, boxes=None):
    return at.crops(src.masks(spark, d) if boxes is None else boxes, src.pixels(spark, d), W, H)


@query("X21_hsv_means", f"""
WITH {CROP} SELECT mask_id, round(avg(hue), 4) AS hue, round(avg(sat), 4) AS sat, round(avg(val), 4) AS val FROM c GROUP BY 1""")
def x21(spark, d):
    c = at.with_hsv(_crops(spark, d))
    return c.groupBy("mask_id").agg(*[F.round(F.avg(n), 4).alias(n) for n in ("hue", "sat", "val")])


@query("V25_dominant_colors", f"""
WITH {CROP}, n AS (SELECT mask_id, CASE WHEN sat < 30 AND val < 50 THEN 'black' WHEN sat < 30 AND val > 200 THEN 'white' WHEN sat < 30 THEN 'gray'
 ELSE {_hues(color.OBJECT_HUES, 'hue')} END AS color, count(*) AS n FROM c GROUP BY 1, 2),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY mask_id) AS share, row_number() OVER (PARTITION BY mask_id ORDER BY n DESC, color) AS position FROM n)
SELECT mask_id, color, round(share, 6) AS share, position::INTEGER AS position, max(position) OVER (PARTITION BY mask_id) > 2
 OR coalesce(max(share) FILTER (position = 2) OVER (PARTITION BY mask_id), 0) > 0.3 AS multicolored FROM t WHERE position <= 3""")
def v25(spark, d):
    return _cast(at.dominant_colors(_crops(spark, d)), "share")


@query("V26_vehicle_paint", f"""
WITH {CROP}, k AS (SELECT *, v >= floor(round(h * 0.3::DOUBLE, 9)) AND v < floor(round(h * 0.8::DOUBLE, 9)) AND u >= floor(round(w * 0.1::DOUBLE, 9))
 AND u < floor(round(w * 0.9::DOUBLE, 9)) AS inside, v < floor(round(h * 0.3::DOUBLE, 9)) AS top, v >= floor(round(h * 0.7::DOUBLE, 9)) AS bottom FROM c),
g AS (SELECT mask_id, avg(hue) FILTER (inside) AS ph, avg(sat) FILTER (inside) AS ps, avg(val) FILTER (inside) AS pv,
 (count(*) FILTER (inside) * sum(val * val) FILTER (inside) - sum(val) FILTER (inside) * sum(val) FILTER (inside)) / (count(*) FILTER (inside) * count(*) FILTER (inside)) AS var,
 sqrt((count(*) FILTER (inside) * sum(sat * sat) FILTER (inside) - sum(sat) FILTER (inside) * sum(sat) FILTER (inside)) / (count(*) FILTER (inside) * count(*) FILTER (inside))) AS sd, avg(hue) FILTER (top) AS th, avg(sat) FILTER (top) AS ts,
 avg(val) FILTER (top) AS tv, avg(hue) FILTER (bottom) AS bh FROM k GROUP BY 1),
n AS (SELECT *, CASE WHEN ps < 30 AND pv < 50 THEN 'black' WHEN ps < 30 AND pv > 200 THEN 'white' WHEN ps < 30 AND pv > 150 THEN 'silver'
 WHEN ps < 30 THEN 'gray' ELSE {_hues(color.VEHICLE_HUES, 'ph')} END AS color,
 CASE WHEN ts < 30 AND tv < 50 THEN 'black' WHEN ts < 30 AND tv > 200 THEN 'white' WHEN ts < 30 AND tv > 150 THEN 'silver'
 WHEN ts < 30 THEN 'gray' ELSE {_hues(color.VEHICLE_HUES, 'th')} END AS second FROM g)
SELECT mask_id, color, CASE WHEN abs(th - bh) > 30 AND second <> color THEN second END AS second_color, var > 1000 AS metallic,
 round(greatest(0.5, 1 - sd / 128), 6) AS color_confidence FROM n""")
def v26(spark, d):
    return _cast(at.paint(_crops(spark, d)), "color_confidence")


@query("V27_X23_clothing", f"""
WITH {CROP}, reg(region, a, b_, c_, d_) AS (VALUES ('upper', 0.1::DOUBLE, 0.2::DOUBLE, 0.9::DOUBLE, 0.5::DOUBLE), ('lower', 0.1, 0.5, 0.9, 0.95)),
j AS (SELECT mask_id, region, hue, sat, val, w, h, a, b_, c_, d_ FROM c, reg WHERE u >= floor(round(w * a, 9)) AND u < floor(round(w * c_, 9))
 AND v >= floor(round(h * b_, 9)) AND v < floor(round(h * d_, 9))),
n AS (SELECT mask_id, region, hue, count(*) AS n, sum(sat) AS s, sum(val) AS v FROM j GROUP BY ALL),
g AS (SELECT mask_id, region, arg_max(hue, (n, -hue)) AS hue, sum(s) / sum(n) AS sat, sum(v) / sum(n) AS val FROM n GROUP BY ALL),
sz AS (SELECT mask_id, region, floor(round(w * c_, 9)) - floor(round(w * a, 9)) AS rw, floor(round(h * d_, 9)) - floor(round(h * b_, 9)) AS rh FROM j GROUP BY ALL)
SELECT mask_id, region, CASE WHEN sat < 30 AND val < 60 THEN 'black' WHEN sat < 30 AND val > 200 THEN 'white' WHEN sat < 30 THEN 'gray'
 ELSE {_hues(color.CLOTHING_HUES, 'hue')} END AS color,
 CASE WHEN region = 'upper' THEN CASE WHEN rw / greatest(rh, 1) > 1.5 THEN 'jacket' WHEN rw / greatest(rh, 1) < 0.6 THEN 'vest' ELSE 'shirt' END
 WHEN rh / greatest(rw, 1) > 2 THEN 'pants' ELSE 'shorts' END AS cloth FROM g JOIN sz USING (mask_id, region)""")
def v27(spark, d):
    m = src.masks(spark, d)
    size = m.select("mask_id", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    reg = at.default_regions(size)
    kind = at.cloth_type(F.col("region"), F.col("rx2") - F.col("rx1"), F.col("ry2") - F.col("ry1"))
    c = at.cloth_colors(_crops(spark, d), reg)
    return c.join(reg.select("mask_id", "region", kind.alias("cloth")), ["mask_id", "region"])


@query("V28_orientation", f"""
WITH {CROP}, y AS (SELECT mask_id, v, u, w, h, (b * 1868 + g * 9617 + r * 4899 + 8192) // 16384 AS y FROM c),
a AS (SELECT l.mask_id, avg(abs(l.y - q.y)) AS asymmetry FROM y l JOIN y q ON q.mask_id = l.mask_id AND q.v = l.v AND q.u = l.w - 1 - l.u
 WHERE l.u < l.w // 2 GROUP BY 1),
z AS (SELECT mask_id, avg(y) FILTER (v < h // 3) AS t, avg(y) FILTER (v >= 2 * h // 3) AS b, avg(y) FILTER (u < w // 3) AS l,
 avg(y) FILTER (u >= 2 * w // 3) AS r FROM y GROUP BY 1)
SELECT mask_id, round(asymmetry, 6) AS asymmetry, CASE WHEN asymmetry < 30 THEN CASE WHEN t > b + 20 THEN 'front' ELSE 'rear' END
 WHEN l > r + 10 THEN 'side_left' WHEN r > l + 10 THEN 'side_right' ELSE 'unknown' END AS orientation FROM a JOIN z USING (mask_id)""")
def v28(spark, d):
    return _cast(at.orientation(_crops(spark, d)), "asymmetry")


# --- types and shapes ---------------------------------------------------------------------------
TYPES = ", ".join(f"('{k}', '{v}')" for k, v in at.TYPE_OF_CLASS.items())
RATIOS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in at.EXPECTED_RATIO.items())
SHAPE = """CASE WHEN w / h < 0.8 AND wheels <= 2 AND h > w * 1.5 THEN 'motorcycle' WHEN w / h < 0.8 AND wheels <= 2 THEN 'bicycle'
 WHEN w / h > 2.5 AND h > 200 THEN 'bus' WHEN w / h > 2.5 THEN 'truck' WHEN w / h < 1.3 AND w * h > 50000 THEN 'van' WHEN w / h < 1.3 THEN 'suv'
 WHEN w / h <= 2 THEN 'sedan' WHEN w / h <= 2.5 THEN 'pickup' ELSE 'unknown' END"""


@query("X03_X08_X24_X25_vehicle_type", f"""
WITH b AS (SELECT det_id, class_name, x2 - x1 AS w, y2 - y1 AS h, det_id % 5 AS wheels FROM base_detections),
t AS (SELECT b.*, m.kind AS hint, coalesce(m.kind, {SHAPE}) AS vehicle_type FROM b LEFT JOIN (VALUES {TYPES}) m(name, kind) ON m.name = class_name)
SELECT det_id, vehicle_type, round(w / h, 6) AS aspect_ratio, round(CASE WHEN hint IS NOT NULL THEN 0.8::DOUBLE
 ELSE greatest(0.3, 1 - abs(w / h - coalesce(r, 1.5)) / coalesce(r, 1.5)) END, 6) AS type_confidence
FROM t LEFT JOIN (VALUES {RATIOS}) e(kind, r) ON e.kind = vehicle_type""")
def x24(spark, d):
    b = src.base_detections(spark, d).select(
        "det_id", "class_name", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"),
        (F.col("det_id") % 5).alias("wheels"))
    t = at.vehicle_type(b, "class_name", "w", "h", "wheels")
    return _cast(t.select("det_id", "vehicle_type", "aspect_ratio", "type_confidence"),
                 "aspect_ratio", "type_confidence")


@query("X26_shape_type", """
WITH s AS (SELECT det_id, (x2 - x1) / (y2 - y1) AS a, (det_id % 11) / 10 AS c, 3 + det_id % 4 AS n, 0.5::DOUBLE + (det_id % 7) / 12 AS s FROM base_detections)
SELECT det_id, CASE WHEN c > 0.8 AND a > 0.8 AND a < 1.2 THEN 'circular' WHEN c > 0.8 THEN 'oval' WHEN n = 4 AND s > 0.9 AND a > 0.8 AND a < 1.2 THEN 'square'
 WHEN n = 4 AND s > 0.9 THEN 'rectangular' WHEN n = 3 THEN 'triangular' WHEN s < 0.7 THEN 'irregular' ELSE 'polygon' END AS shape FROM s""")
def x26(spark, d):
    i = F.col("det_id")
    a = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return src.base_detections(spark, d).select("det_id", at.shape_type(
        a, (i % 11) / 10, 3 + i % 4, F.lit(0.5) + (i % 7) / 12).alias("shape"))


@query("V32_shape_features", """
SELECT mask_id, count(*) AS area, round((max(u) - min(u) + 1) / (max(v) - min(v) + 1), 6) AS aspect_ratio,
 round(count(*) / ((max(u) - min(u) + 1) * (max(v) - min(v) + 1)), 6) AS extent FROM mask_pixels WHERE (u + v) % 5 <> 0 GROUP BY 1""")
def v32(spark, d):
    holey = src.mask_pixels(spark, d).filter((F.col("u") + F.col("v")) % 5 != 0)
    s = at.shape_features(holey)
    return _cast(s.select("mask_id", "area", "aspect_ratio", "extent"), "aspect_ratio", "extent")


@query("X11_physical_size", f"""
WITH {CROP}, m AS (SELECT mask_id, median(depth_raw) FILTER (depth_raw > 0) / 1000 AS m FROM crop GROUP BY 1)
SELECT mask_id, (x2 - x1) * (y2 - y1) AS pixel_area, round((x2 - x1) * m / 600, 6) AS real_width_m, round((y2 - y1) * m / 600, 6) AS real_height_m
FROM masks LEFT JOIN m USING (mask_id)""")
def x11(spark, d):
    s = at.physical_size(src.masks(spark, d), _crops(spark, d))
    return _cast(s.select("mask_id", "pixel_area", "real_width_m", "real_height_m"),
                 "real_width_m", "real_height_m")


# --- model outputs as vectors ---------------------------------------------------------------------

def _vec(spark, d):
    return src.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


@query("L09_top_classes", """
WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS s, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT vec_id, i, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS position FROM p)
SELECT vec_id, position::INTEGER AS position, i::INTEGER AS class_id, round(p, 6) AS probability FROM r WHERE position <= 5""")
def l09(spark, d):
    return _cast(at.top_classes(_vec(spark, d), "vec_id", "e"), "probability")


@query("X07_sigmoid", """
SELECT vec_id, round(1 / (1 + exp(-least(50, greatest(-50, embedding[1]::DOUBLE * 100)))), 6) AS s FROM embeddings""")
def x07(spark, d):
    return _vec(spark, d).select("vec_id", F.round(sigmoid(F.get("e", 0) * 100), 6).alias("s"))


def _side(k):
    return f"""(SELECT sum(exp(x * 10) * i) / sum(exp(x * 10)) FROM (SELECT unnest(e[{k * 16 + 1}:{k * 16 + 16}]) AS x, generate_subscripts(e[{k * 16 + 1}:{k * 16 + 16}], 1) - 1 AS i))"""


@query("X16_box_decode", f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, (8 * 2 ** (vec_id % 3))::DOUBLE AS s, vec_id % 20 AS gx, vec_id // 20 AS gy FROM embeddings)
SELECT vec_id, round((gx + 0.5::DOUBLE) * s - {_side(0)} * s, 4) AS x1, round((gy + 0.5::DOUBLE) * s - {_side(1)} * s, 4) AS y1,
 round((gx + 0.5::DOUBLE) * s + {_side(2)} * s, 4) AS x2, round((gy + 0.5::DOUBLE) * s + {_side(3)} * s, 4) AS y2 FROM v""")
def x16(spark, d):
    return _cast(_anchors(spark, d).select("vec_id", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", digits=4)


def _anchors(spark, d):
    v = _vec(spark, d).select(
        "vec_id", F.transform("e", lambda x: x * 10).alias("e"),
        F.pow(F.lit(2.0), F.col("vec_id") % 3 + 3).alias("stride"), (F.col("vec_id") % 20).alias("gx"),
        F.floor(F.col("vec_id") / 20).alias("gy"))
    return at.decode_boxes(v, F.col("e"))


def _poses(spark, d):
    v = _vec(spark, d).select("vec_id", F.transform("e", lambda x: x + 0.35).alias("p"))
    box, points = at.parse_pose(F.col("p"), 640, 640, 0, 80, 1.0, 640, 480)
    return v.select("vec_id", box.alias("box"), points.alias("points"))


KP = "640 * (e[{i} * 3 + 6] + 0.35::DOUBLE)"


@query("X17_X19_pose_parse", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, trunc(greatest(0, least(640, 640 * ((e[1] + 0.35::DOUBLE) - (e[3] + 0.35::DOUBLE) / 2))))::INTEGER AS x1,
 trunc(greatest(0, least(480, 640 * ((e[2] + 0.35::DOUBLE) + (e[4] + 0.35::DOUBLE) / 2) - 80)))::INTEGER AS y2,
 round(640 * (e[6] + 0.35::DOUBLE), 4) AS nose_x, round(640 * (e[40] + 0.35::DOUBLE) - 80, 4) AS left_hip_y,
 len(list_filter(range(0, 17), lambda i: e[i * 3 + 8] + 0.35::DOUBLE > 0.1))::INTEGER AS visible FROM v""")
def x17(spark, d):
    p = F.col("points")
    return _poses(spark, d).select(
        "vec_id", "box.x1", "box.y2", F.round(F.get(p, 0)["x"], 4).alias("nose_x"),
        F.round(F.get(p, 11)["y"], 4).alias("left_hip_y"), F.size(at.keypoint_map(p)).alias("visible"))


def _kp(name, field):
    i = at.KEYPOINTS.index(name) * 3 + 6 + {"x": 0, "y": 1, "c": 2}[field]
    raw = f"(e[{i}] + 0.35::DOUBLE)"
    return raw if field == "c" else f"(640 * {raw}" + (" - 80)" if field == "y" else ")")


def _seen(name):
    return f"({_kp(name, 'c')} >= 0.3)"


def _either(part, f):
    return f"CASE WHEN {_seen('left_' + part)} THEN {_kp('left_' + part, f)} ELSE {_kp('right_' + part, f)} END"


def _bent(s):
    return (f"({_seen(s + '_hip')} AND {_seen(s + '_knee')} AND {_seen(s + '_ankle')} AND abs({_kp(s + '_hip', 'y')} - {_kp(s + '_knee', 'y')})"
            f" < 0.5 * abs({_kp(s + '_knee', 'y')} - {_kp(s + '_ankle', 'y')}))")


@query("X22_posture", f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, CASE WHEN NOT ({_seen('left_hip')} OR {_seen('right_hip')}) OR NOT ({_seen('left_shoulder')} OR {_seen('right_shoulder')}) THEN 'unknown'
 WHEN abs({_either('hip', 'x')} - {_either('shoulder', 'x')}) > 1.5 * abs({_either('hip', 'y')} - {_either('shoulder', 'y')}) THEN 'lying'
 WHEN {_bent('left')} OR {_bent('right')} THEN 'sitting' ELSE 'standing' END AS posture FROM v""")
def x22(spark, d):
    return _poses(spark, d).select("vec_id", at.posture(F.col("points")).alias("posture"))


def _proto_inputs(spark, d):
    i = F.col("mask_id")
    det = src.masks(spark, d).withColumn("coeffs", F.array(
        ((i % 7) - 3).cast("double"), ((i % 5) - 2).cast("double"), (i % 3).cast("double") - 0.7))
    protos = src.pixels(spark, d).select("frame_key", "v", "u", F.array(
        (F.col("b") / 128.0 - 1), (F.col("g") / 128.0 - 1), (F.col("r") / 128.0 - 1)).alias("channels"))
    return det, protos


@query("V22_prototype_masks", """
WITH z AS (SELECT m.mask_id, p.u, p.v, (mask_id % 7 - 3) * (b / 128.0::DOUBLE - 1) + (mask_id % 5 - 2) * (g / 128.0::DOUBLE - 1)
 + (mask_id % 3 - 0.7::DOUBLE) * (r / 128.0::DOUBLE - 1) AS z FROM masks m JOIN pixels p ON p.frame_key = m.frame_key
 AND p.v >= m.y1 AND p.v < m.y2 AND p.u >= m.x1 AND p.u < m.x2)
SELECT mask_id, count(*) AS area, sum(u)::BIGINT AS sum_u, sum(v)::BIGINT AS sum_v FROM z WHERE 1 / (1 + exp(-z)) > 0.5003 GROUP BY 1""")
def v22(spark, d):
    p = at.prototype_masks(*_proto_inputs(spark, d), above=0.5003)
    return p.groupBy("mask_id").agg(F.count(F.lit(1)).alias("area"), F.sum("u").alias("sum_u"),
                                    F.sum("v").alias("sum_v"))


@query("V35_mask_postprocess")
def v35(spark, d):
    """Suppress boxes, build masks, filter by area and add the depth.  Frames are small here, so the lower area limit
    is lower than usual."""
    det, protos = _proto_inputs(spark, d)
    kept = keep_best_boxes(det.filter("confidence > 0.25"), ["frame_key"], "mask_id", 0.5)
    px = at.prototype_masks(kept, protos).select("frame_key", "mask_id", "v", "u")
    size = mk.shape(px).filter(F.col("area").between(20, mk.MAX_AREA))
    depth = mk.depth_stats(px, src.pixels(spark, d)).select("mask_id", "median_m")
    return size.join(depth, "mask_id", "left").join(kept.select("mask_id", "confidence"), "mask_id")


# --- embeddings and identities --------------------------------------------------------------------

SHOWN = (0, 40, 70, 96, 97, 100, 130, 144)


HISTOGRAMS = f"""
WITH {CROP}, y AS (SELECT mask_id, v, u, hue, sat, val, (b * 1868 + g * 9617 + r * 4899 + 8192) // 16384 AS y FROM c),
a AS (SELECT *, coalesce(lag(y) OVER k, lead(y) OVER k) AS l, coalesce(lead(y) OVER k, lag(y) OVER k) AS q FROM y WINDOW k AS (PARTITION BY mask_id, v ORDER BY u)),
s AS (SELECT *, q - l AS dx, l + 2 * y + q AS sm FROM a),
g AS (SELECT *, coalesce(lag(dx) OVER k, lead(dx) OVER k) + 2 * dx + coalesce(lead(dx) OVER k, lag(dx) OVER k) AS gx,
 coalesce(lead(sm) OVER k, lag(sm) OVER k) - coalesce(lag(sm) OVER k, lead(sm) OVER k) AS gy FROM s WINDOW k AS (PARTITION BY mask_id, u ORDER BY v)),
e AS (SELECT *, sqrt((gx * gx + gy * gy)::DOUBLE) AS size, (atan2(gy, gx) + pi()) / (2 * pi()) * 32 AS turn FROM g),
t AS (SELECT mask_id, unnest([least(31, hue * 32 // 180), 32 + sat * 32 // 256, 64 + val * 32 // 256,
 CASE WHEN size <= 255 THEN 96 + least(31, floor(size / 255 * 32))::INTEGER END, 128 + least(31, floor(round(turn, 9)))::INTEGER]) AS slot FROM e),
n AS (SELECT mask_id, slot, count(*) AS n FROM t WHERE slot IS NOT NULL GROUP BY 1, 2),
x AS (SELECT mask_id, slot, n / sum(n) OVER (PARTITION BY mask_id, slot // 32) AS x FROM n)"""


@query("V23_histogram_embeddings", HISTOGRAMS + f"""
SELECT mask_id, 512 AS dim, {', '.join(f"round(coalesce(max(x) FILTER (slot = {i}), 0) / sqrt(sum(x * x)), 6) AS e{i}" for i in SHOWN)} FROM x GROUP BY 1""")
def v23(spark, d):
    e = at.histogram_embeddings(_crops(spark, d))
    return e.select("mask_id", F.size("embedding").alias("dim"), *[
        F.round(F.get("embedding", i), 6).alias(f"e{i}") for i in SHOWN])


def _boxes(spark, d):
    name = F.when(F.col("mask_id") % 4 == 0, "person").when(F.col("mask_id") % 4 == 1, "car").otherwise("chair")
    return src.masks(spark, d).withColumn("class_name", name)


@query("V24_object_embeddings", HISTOGRAMS + f""",
o AS (SELECT mask_id, {', '.join(f"coalesce(max(x) FILTER (slot = {i}), 0) / sqrt(sum(x * x)) AS e{i}" for i in SHOWN)} FROM x GROUP BY 1),
d AS (SELECT vec_id * 4 AS mask_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: z * z))) AS norm FROM embeddings),
m AS (SELECT mask_id, CASE mask_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'chair' END AS class_name FROM masks)
SELECT m.mask_id, class_name, CASE WHEN class_name = 'person' AND d.e IS NOT NULL THEN len(d.e) ELSE 512 END::INTEGER AS dim,
 {', '.join(f"round(CASE WHEN class_name = 'person' AND d.e IS NOT NULL THEN d.e[{i + 1}] / norm ELSE coalesce(o.e{i}, 0) END, 6) AS e{i}" for i in SHOWN)}
FROM m LEFT JOIN o USING (mask_id) LEFT JOIN d USING (mask_id)""")
def v24(spark, d):
    b = _boxes(spark, d)
    deep = _vec(spark, d).select((F.col("vec_id") * 4).alias("mask_id"), F.col("e").alias("embedding"))
    e = at.object_embeddings(b, _crops(spark, d, b), deep)
    return e.select("mask_id", "class_name", F.size("embedding").alias("dim"), *[
        F.round(F.get("embedding", i), 6).alias(f"e{i}") for i in SHOWN])


@query("V33_identity_stage")
def v33(spark, d):
    q = src.jittered_queries(spark, d)
    out = idn.assign_identities(q, src.gallery(spark, d), 0.3, 0.25)
    return _cast(out, "similarity", digits=4)


# --- attribute jobs -------------------------------------------------------------------------------

def _typed(spark, d, name):
    b = routing.with_area(_boxes(spark, d))
    # Crops are small here, so the size limits shrink with them.
    r = routing.route(b, routing.class_routes(spark), min_person=100, min_vehicle=150)
    return r if name is None else r.filter(F.col("branch") == name)


def _vehicles(spark, d):
    # The wheel count is a column of the detector; the test tables have none, so the id stands for it.
    b = _typed(spark, d, "vehicle")
    c = _crops(spark, d, b)
    t = at.vehicle_type(b.select("mask_id", "class_name", (F.col("x2") - F.col("x1")).alias("w"),
                                 (F.col("y2") - F.col("y1")).alias("h"), (F.col("mask_id") % 5).alias("wheels")),
                        "class_name", "w", "h", "wheels")
    j = t.join(at.paint(c), "mask_id", "left").join(at.orientation(c), "mask_id", "left")
    name = F.when(F.col("type_confidence") > 0.7, F.col("vehicle_type")).otherwise(F.col("class_name"))
    attrs = F.to_json(F.struct(
        F.struct("color", "second_color", "metallic", F.round("color_confidence", 4).alias("confidence")).alias("color"),
        F.struct("vehicle_type", F.round("type_confidence", 4).alias("confidence")).alias("vehicle_type"),
        F.struct(F.round("aspect_ratio", 4).alias("aspect_ratio"), "orientation").alias("shape")))
    return j.select("mask_id", name.alias("primary_class"), attrs.alias("attributes"))


def _persons(spark, d):
    b = _typed(spark, d, "person")
    pose = _poses(spark, d).select((F.col("vec_id") * 4).alias("mask_id"), "points")
    size = b.select("mask_id", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    j = size.join(pose, "mask_id", "left")
    posed = F.explode(at.pose_regions(F.col("points"), F.col("w"), F.col("h")))
    reg = j.filter("points IS NOT NULL").select("mask_id", posed.alias("x")).select("mask_id", "x.*").unionByName(
        at.default_regions(j.filter("points IS NULL")))
    kind = at.cloth_type(F.col("region"), F.col("rx2") - F.col("rx1"), F.col("ry2") - F.col("ry1"))
    cloth = reg.withColumn("kind", kind).join(at.cloth_colors(_crops(spark, d, b), reg), ["mask_id", "region"], "left")
    wide = cloth.groupBy("mask_id").agg(*[
        F.max(F.when(F.col("region") == r, F.coalesce(c, F.lit("unknown")))).alias(f"{r}_{n}")
        for r in ("upper", "lower") for n, c in (("color", "color"), ("type", "kind"))])
    o = j.withColumn("posture", F.when(F.col("points").isNull(), "unknown").otherwise(
        at.posture(F.col("points")))).join(wide, "mask_id", "left")
    attrs = F.to_json(F.struct("posture", F.struct("upper_color", "upper_type", "lower_color", "lower_type",
                                                   F.lit(0.7).alias("confidence")).alias("clothing")))
    return o.select("mask_id", F.lit("person").alias("primary_class"), attrs.alias("attributes"))


def _generic(spark, d):
    b = _typed(spark, d, "generic")
    c = _crops(spark, d, b)
    scores = _vec(spark, d).select(F.col("vec_id").alias("mask_id"), F.transform("e", lambda x: x * 20).alias("e"))
    best = at.top_classes(scores, "mask_id", "e", 1).select("mask_id", "class_id", "probability")
    colors = at.dominant_colors(c).groupBy("mask_id").agg(
        F.max(F.when(F.col("position") == 1, F.col("color"))).alias("color"),
        F.max("multicolored").alias("multicolored"))
    px = src.mask_pixels(spark, d).join(b.select("mask_id"), "mask_id", "left_semi")
    shape = at.shape_features(px).select("mask_id", "aspect_ratio", "extent", "solidity", "circularity", "vertices")
    size = at.physical_size(b, c)
    j = b.select("mask_id", "class_name").join(best, "mask_id", "left").join(colors, "mask_id", "left").join(
        shape, "mask_id", "left").join(size, "mask_id", "left")
    kind = at.shape_type(F.col("aspect_ratio"), F.col("circularity"), F.col("vertices"), F.col("solidity"))
    name = F.when(F.col("probability") > 0.3, F.concat(F.lit("class_"), F.col("class_id").cast("string"))).otherwise(
        F.col("class_name"))
    attrs = F.to_json(F.struct(
        F.struct("color", "multicolored").alias("color"),
        F.struct(F.round("aspect_ratio", 4).alias("aspect_ratio"), F.round("extent", 4).alias("extent"),
                 F.round("circularity", 4).alias("circularity"), "vertices", kind.alias("type")).alias("shape"),
        F.struct("pixel_area", F.round("real_width_m", 4).alias("real_width_m")).alias("size")))
    return j.select("mask_id", name.alias("primary_class"), attrs.alias("attributes"))


@query("V29_vehicle_attributes")
def v29(spark, d):
    return _vehicles(spark, d)


@query("V30_person_attributes")
def v30(spark, d):
    return _persons(spark, d)


@query("V31_generic_attributes")
def v31(spark, d):
    return _generic(spark, d)


@query("V36_route_and_attribute")
def v36(spark, d):
    routed = _typed(spark, d, None).select("mask_id", "branch", "route_reason", "confidence")
    # A branch without a registered job only leaves its routing note.
    done = _vehicles(spark, d).unionByName(_persons(spark, d)).unionByName(_generic(spark, d))
    note = F.to_json(F.struct("branch", "confidence", "route_reason"))
    return routed.join(done, "mask_id", "left").select(
        "mask_id", "branch", "primary_class", "attributes", note.alias("routing"))


