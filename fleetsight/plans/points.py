"""Queries over 3-D points and depth images."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fleetsight.functions.geometry import deproject, project
from fleetsight.operators import depth as dp, masks as mk, points as pt
from fleetsight.plans.fixture_sql import refined_sql
from fleetsight.plans.registry import query
from fleetsight.sources import derive as src

W, H = src.GRID_W, src.GRID_H


def _intrinsics(spark):
    return spark.createDataFrame([(0, src.FOCAL, src.FOCAL, src.CENTER_X, src.CENTER_Y)],
                                 "camera_id int, fx double, fy double, ppx double, ppy double")


VALID = "depth_raw > 200 AND depth_raw < 5000"


@query("F18_valid_depth", f"SELECT frame_key, count(*) AS n FROM pixels WHERE {VALID} GROUP BY 1")
def f18(spark, d):
    p = src.pixels(spark, d).filter(dp.valid_depth(F.col("depth_raw")))
    return p.groupBy("frame_key").agg(F.count(F.lit(1)).alias("n"))


SOBEL = """WITH d AS (SELECT frame_key, v, u, CASE WHEN depth_raw > 200 AND depth_raw < 5000 THEN depth_raw ELSE 0 END AS x FROM pixels),
h AS (SELECT frame_key, v, u, x,
 coalesce(lag(x) OVER w, nth_value(x, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS l,
 coalesce(lead(x) OVER w, lag(x) OVER w) AS r FROM d WINDOW w AS (PARTITION BY frame_key, v ORDER BY u)),
s AS (SELECT frame_key, v, u, x, r - l AS dx, l + 2 * x + r AS sx FROM h),
g AS (SELECT frame_key, v, u, x,
 coalesce(lag(dx) OVER w, lead(dx) OVER w) + 2 * dx + coalesce(lead(dx) OVER w, lag(dx) OVER w) AS gx,
 coalesce(lead(sx) OVER w, lag(sx) OVER w) - coalesce(lag(sx) OVER w, lead(sx) OVER w) AS gy
 FROM s WINDOW w AS (PARTITION BY frame_key, u ORDER BY v)),
e AS (SELECT *, sqrt((gx * gx + gy * gy)::DOUBLE) AS mag FROM g)
"""


@query("V01_depth_edges", SOBEL + """
SELECT frame_key, v, count(*) AS n, sum(u)::BIGINT AS sum_u FROM e WHERE x > 0 AND mag > 100 GROUP BY 1, 2""")
def v01(spark, d):
    e = dp.edges(src.pixels(spark, d), H)
    return e.groupBy("frame_key", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_u"))


@query("V02_relative_edges", SOBEL + """
SELECT frame_key, v, count(*) AS n, sum(u)::BIGINT AS sum_u FROM e WHERE x > 0 AND mag > x * 0.6::DOUBLE GROUP BY 1, 2""")
def v02(spark, d):
    e = dp.edges(src.pixels(spark, d), H, 0.6, relative=True)
    return e.groupBy("frame_key", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_u"))


REGIONS = SOBEL.replace("WITH d AS", "WITH RECURSIVE d AS") + """
, f AS (SELECT frame_key, v, u, u - row_number() OVER (PARTITION BY frame_key, v ORDER BY u) AS island FROM e
 WHERE x > 0 AND NOT mag > 100),
runs AS MATERIALIZED (SELECT frame_key, v, min(u) AS u0, max(u) AS u1, frame_key * 4294967296 + v * 65536 + min(u) AS id
 FROM f GROUP BY frame_key, v, island),
touch AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.frame_key = b.frame_key AND b.v = a.v + 1
 AND a.u0 <= b.u1 + 1 AND b.u0 <= a.u1 + 1),
links AS MATERIALIZED (SELECT a, b FROM touch UNION ALL SELECT b, a FROM touch),
cc(id, label) USING KEY (id) AS (SELECT id, id FROM runs UNION
 (SELECT DISTINCT ON (p.id) p.id, n.label FROM recurring.cc AS p, links l, cc AS n
  WHERE p.id = l.a AND l.b = n.id AND n.label < p.label ORDER BY p.id, n.label))
"""


@query("V03_connected_regions", REGIONS + """
SELECT runs.frame_key, label, count(*) AS runs, sum(u1 - u0 + 1)::BIGINT AS area FROM runs JOIN cc USING (id) GROUP BY ALL""")
def v03(spark, d):
    r = dp.connected_regions(src.pixels(spark, d), H)
    return r.groupBy("frame_key", "label").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.col("u1") - F.col("u0") + 1).alias("area"))


@query("A33_frame_components", REGIONS + """
, px AS (SELECT runs.frame_key, label, runs.v, unnest(range(u0, u1 + 1)) AS u FROM runs JOIN cc USING (id)),
k AS (SELECT frame_key, label, count(*) AS area, avg(u) AS cx, avg(v) AS cy, median(depth_raw) / 1000 AS m
 FROM px JOIN pixels USING (frame_key, v, u) GROUP BY ALL)
SELECT frame_key, label, area, round(cx, 4) AS cx, round(cy, 4) AS cy, round(m, 4) AS depth_median,
 (SELECT count(*) FROM e WHERE e.frame_key = k.frame_key AND x > 0 AND mag > 100) AS edge_pixels FROM k""")
def a33(spark, d):
    px = src.pixels(spark, d)
    label = dp.run_pixels(dp.connected_regions(px, H), "label")
    j = label.join(px.select("frame_key", "v", "u", "depth_raw"), ["frame_key", "v", "u"])
    k = j.groupBy("frame_key", "label").agg(
        F.count(F.lit(1)).alias("area"), F.round(F.avg("u"), 4).alias("cx"),
        F.round(F.avg("v"), 4).alias("cy"),
        F.round(F.median("depth_raw") / 1000, 4).alias("depth_median"))
    e = dp.edges(px, H).groupBy("frame_key").agg(F.count(F.lit(1)).alias("edge_pixels"))
    return k.join(e, "frame_key", "left").withColumn(
        "edge_pixels", F.coalesce("edge_pixels", F.lit(0)))


@query("V04_split_regions")
def v04(spark, d):
    px = src.pixels(spark, d)
    labels = dp.run_pixels(dp.connected_regions(px, H, gradient=2.5))
    return mk.shape(dp.refine_labels(labels, px))


@query("V34_segment_depth")
def v34(spark, d):
    return dp.segment(src.pixels(spark, d), H, min_area=20)


@query("V06_depth_to_points", f"""
SELECT frame_key, count(*) AS n, round(sum((u - 32.0::DOUBLE) * (depth_raw / 1000) / 60), 4) AS sx,
 round(sum((v - 24.0::DOUBLE) * (depth_raw / 1000) / 60), 4) AS sy, round(sum(depth_raw / 1000), 4) AS sz,
 sum(v * 64 + u)::BIGINT AS pixel_sum, sum(r)::BIGINT AS red FROM pixels WHERE {VALID} GROUP BY 1""")
def v06(spark, d):
    p = src.pixels(spark, d).withColumn("camera_id", F.lit(0))
    c = pt.from_depth(p, _intrinsics(spark), width=W)
    return c.groupBy("frame_key").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(a), 4).alias(f"s{a}") for a in "xyz"],
        F.sum("pixel_index").alias("pixel_sum"), F.sum("r").alias("red"))


@query("L07_point_cap", """
SELECT frame_key, count(*) AS n, sum(point_id)::BIGINT AS id_sum FROM (SELECT *, row_number() OVER (PARTITION BY frame_key
 ORDER BY md5('0|' || frame_key || '|' || point_id), point_id) AS k FROM points) WHERE k <= 500 GROUP BY 1""")
def l07(spark, d):
    c = pt.cap(src.points(spark, d), 500, tag="point_id")
    return c.groupBy("frame_key").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("id_sum"))


@query("V07_voxel_downsample", """
SELECT frame_key, floor(x / 0.5)::BIGINT AS vx, floor(y / 0.5)::BIGINT AS vy, floor(z / 0.5)::BIGINT AS vz, count(*) AS n,
 round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM points GROUP BY ALL""")
def v07(spark, d):
    v = pt.voxels(src.points(spark, d), 0.5)
    return v.withColumns({c: F.round(c, 9) for c in "xyz"})


@query("X09_project", f"""
SELECT point_id, (x * 60 / z + 32)::DOUBLE AS uu, trunc(x * 60 / z + 32)::INTEGER AS u, trunc(y * 60 / z + 24)::INTEGER AS v,
 round((trunc(x * 60 / z + 32) - 32) * z / 60, 6) AS back_x FROM points""")
def x09(spark, d):
    x, y, z = (F.col(c) for c in "xyz")
    u, v = project(x, y, z, 60, 60, 32, 24)
    back = deproject(u, v, z, 60, 60, 32, 24)[0]
    return src.points(spark, d).select("point_id", (x * 60 / z + 32).alias("uu"), u.alias("u"), v.alias("v"),
                                       F.round(back, 6).alias("back_x"))


@query("F41_box_center_position", """
SELECT mask_id, round(((x1 + x2) / 2 - 32) * depth_median / 60, 6) AS x, round(((y1 + y2) / 2 - 24) * depth_median / 60, 6) AS y,
 round(depth_median, 6) AS z FROM masks""")
def f41(spark, d):
    m = src.masks(spark, d)
    u, v = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    p = deproject(u, v, F.col("depth_median"), 60, 60, 32, 24)
    return m.select("mask_id", *[F.round(c, 6).alias(n) for c, n in zip(p, "xyz")])


NEAR = """SELECT p.frame_key, p.point_id, q.point_id AS other, sqrt((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2) AS dist
 FROM points p JOIN points q ON p.frame_key = q.frame_key AND p.point_id <> q.point_id"""
NEAREST = f"""WITH points AS MATERIALIZED (SELECT * FROM points), m AS MATERIALIZED (
 SELECT frame_key, point_id, list_avg(ds) AS mean_d, len(ds) AS k, ds[1] AS d1, ds[-1] AS dk FROM (
 SELECT frame_key, point_id, min(dist, 20) AS ds FROM ({NEAR}) GROUP BY 1, 2))
"""


@query("J24_nearest_points", NEAREST.replace("WITH points AS MATERIALIZED (SELECT * FROM points), ", "WITH ") + """
SELECT point_id, k::INTEGER AS k, round(d1, 6) AS d1, round(dk, 6) AS dk, round(mean_d, 6) AS mean_d FROM m""")
def j24(spark, d):
    n = pt.nearest_distances(src.points(spark, d))
    mean = F.aggregate("ds", F.lit(0.0), lambda s, x: s + x) / F.size("ds")
    return n.select("point_id", F.size("ds").alias("k"), F.round(F.get("ds", 0), 6).alias("d1"),
                    F.round(F.element_at("ds", -1), 6).alias("dk"), F.round(mean, 6).alias("mean_d"))


@query("V08_outlier_removal", NEAREST.replace("WITH points AS MATERIALIZED (SELECT * FROM points), ", "WITH ") + """
, l AS (SELECT frame_key, avg(mean_d) + 2 * stddev_pop(mean_d) AS lim, count(*) AS n FROM m GROUP BY 1)
SELECT point_id, round(mean_d, 6) AS mean_d FROM m JOIN l USING (frame_key) WHERE n < 20 OR mean_d < lim""")
def v08(spark, d):
    return pt.without_outliers(src.points(spark, d)).select(
        "point_id", F.round("mean_d", 6).alias("mean_d"))


@query("J25_radius_neighbours", f"""
SELECT point_id, coalesce(n, 0) AS neighbours FROM points LEFT JOIN (
 SELECT point_id, count(*) AS n FROM ({NEAR}) WHERE dist <= 0.11 GROUP BY 1) USING (point_id)""")
def j25(spark, d):
    return pt.radius_counts(src.points(spark, d), 0.11).select("point_id", "neighbours")


@query("V09_L05_clusters", f"""
WITH RECURSIVE links AS MATERIALIZED (SELECT point_id AS a, other AS b FROM ({NEAR}) WHERE dist <= 0.2),
cc(id, label) USING KEY (id) AS (SELECT point_id, point_id FROM points UNION
 (SELECT DISTINCT ON (p.id) p.id, n.label FROM recurring.cc AS p, links l, cc AS n
  WHERE p.id = l.a AND l.b = n.id AND n.label < p.label ORDER BY p.id, n.label))
SELECT p.frame_key, label AS cluster, count(*) AS size, sum(p.point_id)::BIGINT AS id_sum FROM cc JOIN points p ON p.point_id = cc.id
GROUP BY ALL HAVING count(*) >= 3""")
def v09(spark, d):
    c = pt.clusters(src.points(spark, d), 0.2, 3, 100)
    return c.groupBy("frame_key", "cluster").agg(F.count(F.lit(1)).alias("size"),
                                                 F.sum("point_id").alias("id_sum"))


PLANES = """WITH s AS (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY md5('0|' || point_id), point_id) - 1 AS i FROM points),
t AS (SELECT frame_key, i // 3 AS candidate, max(x) FILTER (i % 3 = 0) AS px, max(y) FILTER (i % 3 = 0) AS py, max(z) FILTER (i % 3 = 0) AS pz,
 max(x) FILTER (i % 3 = 1) - max(x) FILTER (i % 3 = 0) AS ax, max(y) FILTER (i % 3 = 1) - max(y) FILTER (i % 3 = 0) AS ay,
 max(z) FILTER (i % 3 = 1) - max(z) FILTER (i % 3 = 0) AS az, max(x) FILTER (i % 3 = 2) - max(x) FILTER (i % 3 = 0) AS bx,
 max(y) FILTER (i % 3 = 2) - max(y) FILTER (i % 3 = 0) AS by_, max(z) FILTER (i % 3 = 2) - max(z) FILTER (i % 3 = 0) AS bz, count(*) AS c
 FROM s WHERE i < 3 * 1000 GROUP BY 1, 2),
n AS (SELECT *, ay * bz - az * by_ AS cx, az * bx - ax * bz AS cy, ax * by_ - ay * bx AS cz FROM t WHERE c = 3),
l AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS len FROM n),
f AS MATERIALIZED (SELECT *, CASE WHEN cz > 0 THEN -1.0::DOUBLE ELSE 1.0 END / len AS k FROM l WHERE len >= 1e-6),
planes AS MATERIALIZED (SELECT frame_key, candidate, cx * k AS nx, cy * k AS ny, cz * k AS nz, px, py, pz FROM f),
score AS MATERIALIZED (SELECT p.frame_key, candidate, count(*) FILTER (abs((x - px) * nx + (y - py) * ny + (z - pz) * nz) < 0.05) AS inliers, count(*) AS n_points
 FROM points p JOIN planes q ON p.frame_key = q.frame_key GROUP BY 1, 2)
"""


@query("J23_plane_inliers", PLANES + "SELECT frame_key, candidate, inliers FROM score")
def j23(spark, d):
    p = src.points(spark, d)
    return pt.inlier_counts(p, pt.candidate_planes(p), 0.05)


DOMINANT = PLANES + """, best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY inliers DESC, candidate) AS k FROM score)
 JOIN planes USING (frame_key, candidate) WHERE k = 1 AND n_points >= 10 AND inliers / n_points >= 0.05)
"""


@query("V12_dominant_plane", DOMINANT + """
SELECT frame_key, candidate, inliers, round(inliers / n_points, 6) AS inlier_ratio, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM best""")
def v12(spark, d):
    b = pt.dominant_plane(src.points(spark, d), distance=0.05, min_ratio=0.05)
    return b.select("frame_key", "candidate", "inliers", *[
        F.round(c, 6).alias(c) for c in ("inlier_ratio", "nx", "ny", "nz")])


@query("V14_X10_remove_plane", DOMINANT + """
SELECT point_id, round(o, 6) AS plane_offset FROM (SELECT point_id, (x - px) * nx + (y - py) * ny + (z - pz) * nz AS o
 FROM points LEFT JOIN best USING (frame_key)) WHERE o IS NULL OR (o > 0.02 AND o < 0.5)""")
def v14(spark, d):
    p = src.points(spark, d)
    plane = pt.dominant_plane(p, distance=0.05, min_ratio=0.05)
    kept = pt.remove_plane(p, plane)
    return pt.plane_offset(kept, plane).select("point_id", F.round("offset", 6).alias("plane_offset"))


def _turn(k: int, points: str) -> str:
    """One round of the search for several planes: the best plane of what is left of each frame."""
    names = ("s", "t", "n", "l", "f", "planes", "score")
    body = PLANES.removeprefix("WITH ").rstrip()
    for name in names:
        body = re.sub(rf"\b{name} AS( MATERIALIZED)? \(SELECT", rf"{name}{k} AS\1 (SELECT", body)
        body = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{k}", body)
    body = re.sub(r"\bFROM points\b", f"FROM r{k}", body)
    return f"""r{k} AS MATERIALIZED (SELECT * FROM {points} WHERE frame_key IN (SELECT frame_key FROM {points} GROUP BY 1 HAVING count(*) >= 100)),
{body},
best{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY inliers DESC, candidate) AS k FROM score{k})
 JOIN planes{k} USING (frame_key, candidate) WHERE k = 1 AND n_points >= 10 AND inliers / n_points >= 0.05),
left{k} AS MATERIALIZED (SELECT p.* FROM r{k} p JOIN best{k} q USING (frame_key)
 WHERE abs((p.x - q.px) * q.nx + (p.y - q.py) * q.ny + (p.z - q.pz) * q.nz) >= 0.05)"""


@query("V13_several_planes", "WITH " + ",\n".join(_turn(k, "points" if k == 0 else f"left{k - 1}") for k in range(3)) + "\n" + " UNION ALL ".join(
    f"SELECT frame_key, {k}::INTEGER AS turn, inliers, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM best{k}" for k in range(3)))
def v13(spark, d):
    pl = pt.several_planes(src.points(spark, d), distance=0.05, min_ratio=0.05)
    return pl.select("frame_key", "turn", "inliers", *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")])


@query("V10_cluster_masks")
def v10(spark, d):
    p = src.points(spark, d)
    c = pt.clusters(p, 0.2, 3, 100)
    m = pt.cluster_masks(p, c, 640, 480, 200.0, 200.0, 100.0, 100.0)
    return m.groupBy("frame_key", "cluster").agg(
        F.count(F.lit(1)).alias("area"), F.min("u").alias("bx1"), F.max("u").alias("bx2"),
        F.min("v").alias("by1"), F.max("v").alias("by2"))


@query("V11_segment_cloud")
def v11(spark, d):
    s = pt.segment_cloud(src.points(spark, d), tolerance=0.2, min_size=3, max_size=100)
    return s.groupBy("frame_key", "cluster").agg(F.count(F.lit(1)).alias("size"))


CONSISTENT = """WITH s AS (SELECT mask_id, median(depth_raw) / 1000 AS m, stddev_pop(depth_raw) / 1000 AS sd, count(*) AS n
 FROM mask_pixels JOIN pixels USING (frame_key, v, u) WHERE depth_raw > 0 GROUP BY 1)
"""


@query("V17_consistent_pixels", CONSISTENT + """
SELECT mask_id, count(*) AS n, sum(u)::BIGINT AS sum_u FROM mask_pixels JOIN pixels USING (frame_key, v, u) JOIN s USING (mask_id)
WHERE s.n >= 10 AND sd >= 0.1 AND depth_raw > 0 AND abs(depth_raw - m * 1000) < 200 GROUP BY mask_id""")
def v17a(spark, d):
    c = dp.consistent_pixels(src.mask_pixels(spark, d), src.pixels(spark, d))
    return c.groupBy("mask_id").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_u"))


@query("V17_refine_masks", f"""WITH {refined_sql("mask_pixels", 30)}
SELECT frame_key, mask_id, count(*) AS area, min(u) AS bx1, min(v) AS by1, max(u) AS bx2, max(v) AS by2 FROM (SELECT * FROM kept
 UNION ALL SELECT frame_key, mask_id, v, u FROM mask_pixels WHERE mask_id NOT IN (SELECT mask_id FROM kept)) GROUP BY ALL""")
def v17(spark, d):
    r = dp.refine_masks(src.mask_pixels(spark, d), src.pixels(spark, d), W, H, least=30)
    return mk.shape(r)


@query("V18_split_masks")
def v18(spark, d):
    return dp.split_masks(src.mask_pixels(spark, d), src.pixels(spark, d), W, H, least=30)
