"""Queries over segmentation masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.functions.scalar import instant, micros
from fleetsight.operators import depth as dp, masks as mk
from fleetsight.plans.fixture_sql import refined_sql
from fleetsight.plans.registry import query
from fleetsight.sources import derive as src

AREA_SQL = "SELECT frame_key, mask_id, (x2 - x1) * (y2 - y1) AS area FROM masks"
# Masks are rectangles here, so SQL can intersect boxes where Spark intersects pixels.
PAIRS = """WITH m AS (SELECT *, ((x2 - x1) * (y2 - y1))::BIGINT AS area FROM masks),
p AS (SELECT a.frame_key, a.mask_id AS a, b.mask_id AS b, a.area AS area_a, b.area AS area_b,
 greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i
 FROM m a JOIN m b ON a.frame_key = b.frame_key AND a.mask_id < b.mask_id),
o AS (SELECT *, i / (area_a + area_b - i) AS iou, i / least(area_a, area_b) AS overlap FROM p WHERE i > 0)
"""


@query("A18_mask_shape", """
SELECT frame_key, mask_id, count(*) AS area, min(u) AS bx1, min(v) AS by1, max(u) AS bx2, max(v) AS by2
FROM mask_pixels GROUP BY ALL""")
def a18(spark, d):
    return mk.shape(src.mask_pixels(spark, d))


def _pairs(spark, d):
    w = mk.words(src.mask_pixels(spark, d))
    return mk.overlaps(w, mk.areas(w))


@query("J12_mask_overlaps", PAIRS + """
SELECT frame_key, a, b, i::BIGINT AS intersection, round(iou, 6) AS iou, round(overlap, 6) AS overlap FROM o""")
def j12(spark, d):
    return _pairs(spark, d).select("frame_key", "a", "b", "intersection", F.round("iou", 6).alias("iou"),
                                   F.round("overlap", 6).alias("overlap"))


@query("J13_matching_masks", PAIRS + """
SELECT mask_id, match_id, round(iou, 6) AS iou FROM (
 SELECT a AS mask_id, b AS match_id, iou FROM o UNION ALL SELECT b, a, iou FROM o) WHERE iou >= 0.5""")
def j13(spark, d):
    return mk.matching(_pairs(spark, d), 0.5).select(
        "mask_id", "match_id", F.round("iou", 6).alias("iou"))


@query("J18_A19_mask_depth", """
SELECT mask_id, round(median(depth_raw) / 1000, 6) AS median_m, round(stddev_pop(depth_raw) / 1000, 6) AS std_m, count(*) AS valid_px
FROM mask_pixels JOIN pixels USING (frame_key, v, u) WHERE depth_raw > 0 GROUP BY mask_id""")
def j18(spark, d):
    s = mk.depth_stats(src.mask_pixels(spark, d), src.pixels(spark, d))
    return s.select("mask_id", F.round("median_m", 6).alias("median_m"),
                    F.round("std_m", 6).alias("std_m"), "valid_px")


@query("V05_extract_masks", """
SELECT frame_key, mask_id, area, bx1, by1, bx2, by2, coalesce(depth_median, 0) AS depth_median, 0.8::DOUBLE AS confidence FROM (
 SELECT frame_key, mask_id, count(*) AS area, min(u) AS bx1, min(v) AS by1, max(u) AS bx2, max(v) AS by2,
 round(median(CASE WHEN depth_raw > 0 THEN depth_raw END) / 1000, 6) AS depth_median
 FROM mask_pixels JOIN pixels USING (frame_key, v, u) GROUP BY ALL) WHERE area BETWEEN 100 AND 500000""")
def v05(spark, d):
    from fleetsight.operators.depth import extract_masks
    m = extract_masks(src.mask_pixels(spark, d), src.pixels(spark, d), min_area=100)
    return m.withColumn("depth_median", F.round("depth_median", 6))


@query("F19_L04_area_band", f"""
SELECT mask_id, area::BIGINT AS area FROM ({AREA_SQL}) WHERE area BETWEEN 100 AND 500000""")
def f19(spark, d):
    a = mk.areas(mk.words(src.mask_pixels(spark, d))).filter(F.col("area").between(100, mk.MAX_AREA))
    return a.orderBy(F.desc("area"), "mask_id").select("mask_id", "area")


@query("U01_mask_sources", "SELECT source, count(*) AS n, round(avg(confidence), 6) AS confidence FROM masks GROUP BY 1")
def u01(spark, d):
    m = src.masks(spark, d)
    parts = [m.filter(F.col("source") == s).drop("source") for s in mk.SOURCES]
    tagged = [p.withColumn("source", F.lit(s)) for p, s in zip(parts, mk.SOURCES)]
    both = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"),
                                      F.round(F.avg("confidence"), 6).alias("confidence"))


@query("J22_detections_with_masks", """
SELECT i.det_id, frame_key, det_idx, m.mask_id, m.source FROM (
 SELECT event_id AS det_id, event_id // 24 AS frame_key, event_id % 24 AS det_idx FROM events) i
FULL JOIN (SELECT frame_key, mask_id % 24 + frame_key % 4 AS det_idx, mask_id, source FROM masks) m USING (frame_key, det_idx)""")
def j22(spark, d):
    i = F.col("event_id")
    det = src.table(spark, d, "events").select(
        i.alias("det_id"), F.floor(i / 24).alias("frame_key"), (i % 24).alias("det_idx"))
    m = src.masks(spark, d).withColumn("det_idx", F.col("mask_id") % 24 + F.col("frame_key") % 4)
    return det.join(m.select("frame_key", "det_idx", "mask_id", "source"),
                    ["frame_key", "det_idx"], "full")


@query("J17_mask_crop", """
WITH h AS (SELECT * FROM mask_pixels WHERE (u + v) % 5 <> 0),
b AS (SELECT frame_key, mask_id, min(u) AS x1, min(v) AS y1, max(u) AS x2, max(v) AS y2 FROM h GROUP BY ALL)
SELECT h.mask_id, any_value((x2 - x1 + 1) * (y2 - y1 + 1))::BIGINT AS crop_px,
 any_value((x2 - x1 + 1) * (y2 - y1 + 1)) - count(*) FILTER (g <> 0) AS zero_px, sum(g)::BIGINT AS total
FROM h JOIN pixels USING (frame_key, v, u) JOIN b ON b.mask_id = h.mask_id GROUP BY h.mask_id""")
def j17(spark, d):
    holey = src.mask_pixels(spark, d).filter((F.col("u") + F.col("v")) % 5 != 0)
    c = mk.crop(holey, src.pixels(spark, d))
    return c.groupBy("mask_id").agg(F.count(F.lit(1)).alias("crop_px"),
                                    F.count_if(F.col("g") == 0).alias("zero_px"),
                                    F.sum("g").alias("total"))


# --- claims: fastsam masks are claims, the others new masks; frames are 0.1 s apart and eight of
# them make a scene, so scenes grow in number and not in size ------------------------------------
STALE_US = 500_000
CLAIM_PAIRS = f"""WITH m AS (SELECT *, frame_key // 8 AS scene, frame_key * 100000 AS t, (x2 - x1) * (y2 - y1) AS area FROM masks),
c AS (SELECT * FROM m WHERE source = 'fastsam'), n AS (SELECT * FROM m WHERE source <> 'fastsam'),
p AS (SELECT n.mask_id, n.area, c.mask_id AS claim_id, c.object_id AS claim_object, c.area AS claim_area,
 greatest(0, least(n.x2, c.x2) - greatest(n.x1, c.x1)) * greatest(0, least(n.y2, c.y2) - greatest(n.y1, c.y1)) AS i,
 n.x1, n.y1, n.x2, n.y2, c.x1 AS cx1, c.y1 AS cy1, c.x2 AS cx2, c.y2 AS cy2
 FROM n JOIN c ON n.scene = c.scene AND n.t - c.t BETWEEN 0 AND {STALE_US} AND n.object_id <> c.object_id),
o AS (SELECT *, i / least(area, claim_area) AS overlap FROM p WHERE i > 0 AND i / least(area, claim_area) >= 0.3)
"""


def _claims(spark, d):
    m = src.masks(spark, d).select("mask_id", "frame_key", "object_id", "source",
                                   F.timestamp_micros(F.col("frame_key") * 100_000).alias("ts"),
                                   F.floor(F.col("frame_key") / 8).alias("scene"))
    packed = mk.words(src.mask_pixels(spark, d)).join(m, ["frame_key", "mask_id"])
    return packed.filter("source <> 'fastsam'"), packed.filter("source = 'fastsam'")


@query("J14_claim_overlaps", CLAIM_PAIRS + "SELECT mask_id, claim_id, claim_object, round(overlap, 6) AS overlap FROM o")
def j14(spark, d):
    return mk.claim_overlaps(*_claims(spark, d), STALE_US).select(
        "mask_id", "claim_id", "claim_object", F.round("overlap", 6).alias("overlap"))


@query("J15_unclaimed_masks", CLAIM_PAIRS + """
SELECT mask_id, source FROM n WHERE mask_id NOT IN (SELECT mask_id FROM o WHERE overlap >= 0.5)""")
def j15(spark, d):
    new, claims = _claims(spark, d)
    hits = mk.claim_overlaps(new, claims, STALE_US)
    m = src.masks(spark, d).filter("source <> 'fastsam'").select("mask_id", "source")
    return mk.unclaimed(m, hits)


@query("J16_subtract_claims", CLAIM_PAIRS + """
, gone AS (SELECT DISTINCT p.mask_id, v, u FROM p, range(48) AS a(v), range(64) AS b(u)
 WHERE i > 0 AND v >= greatest(y1, cy1) AND v < least(y2, cy2) AND u >= greatest(x1, cx1) AND u < least(x2, cx2)),
k AS (SELECT mask_id, count(*) AS n FROM gone GROUP BY 1)
SELECT mask_id, (area - coalesce(k.n, 0))::BIGINT AS area FROM n LEFT JOIN k USING (mask_id) WHERE area > coalesce(k.n, 0)""")
def j16(spark, d):
    left = mk.subtract_claims(*_claims(spark, d), STALE_US)
    return mk.areas(left, ("mask_id",))


@query("A20_claimed_area", """
WITH c AS (SELECT *, frame_key // 8 AS scene, max(frame_key) OVER (PARTITION BY frame_key // 8) AS last FROM masks WHERE source = 'fastsam')
SELECT scene, count(*) AS claimed_area FROM (SELECT DISTINCT scene, v, u FROM mask_pixels
 JOIN c USING (frame_key, mask_id) WHERE (last - frame_key) * 100000 <= 500000) GROUP BY 1""")
def a20(spark, d):
    _, claims = _claims(spark, d)
    return mk.composite(mk.live_at_last(claims, STALE_US))


LOG = """SELECT mask_id, object_id, epoch_us(ts) AS t, 'claim' AS action, 0 AS step FROM masks UNION ALL
 SELECT mask_id, object_id, epoch_us(ts) + 600000000, 'update', 1 FROM masks WHERE mask_id % 2 = 0 UNION ALL
 SELECT mask_id, object_id, epoch_us(ts) + 1200000000, 'release', 2 FROM masks WHERE mask_id % 5 = 0"""


def _claim_log(spark, d):
    m = src.masks(spark, d).select("mask_id", "object_id", "ts")
    at = lambda minutes, action, step: m.select(
        "mask_id", "object_id", (F.col("ts") + F.expr(f"interval {minutes} minutes")).alias("ts"),
        F.lit(action).alias("action"), F.lit(step).alias("step"))
    return (at(0, "claim", 0).unionByName(at(10, "update", 1).filter("mask_id % 2 = 0"))
            .unionByName(at(20, "release", 2).filter("mask_id % 5 = 0")))


@query("S19_live_claims", f"""
SELECT mask_id, object_id, max(t) AS ts, arg_max(action, step) AS action FROM ({LOG}) GROUP BY ALL HAVING arg_max(action, step) <> 'release'""")
def s19(spark, d):
    c = mk.live_claims(_claim_log(spark, d))
    return c.select("mask_id", "object_id", micros(F.col("ts")).alias("ts"), "action")


@query("T04_claim_ages", f"""
WITH c AS (SELECT mask_id, max(t) AS t FROM ({LOG}) GROUP BY 1 HAVING arg_max(action, step) <> 'release'),
a AS (SELECT mask_id, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - t) / 1e6 AS age FROM c)
SELECT CASE WHEN age > 1296000 THEN 'expired' WHEN age > 604800 THEN 'stale' ELSE 'live' END AS claim_state, count(*) AS n
FROM a GROUP BY 1""")
def t04(spark, d):
    c = mk.live_claims(_claim_log(spark, d))
    return mk.claim_age(c, instant("2024-01-30 12:00:00"), 604800.0, 1296000.0).groupBy(
        "claim_state").agg(F.count(F.lit(1)).alias("n"))


# --- merging --------------------------------------------------------------------------------
def _members(spark, d):
    return src.masks(spark, d).select("frame_key", F.floor(F.col("mask_id") / 3).alias("group_id"),
                                      "mask_id", "confidence", "source", "depth_median")


def _merge_sql(rule):
    return f"""WITH g AS (SELECT frame_key, mask_id // 3 AS group_id, mask_id, confidence FROM masks),
t AS (SELECT group_id, count(*) AS n, sum(confidence) AS w, min(mask_id) AS first FROM g GROUP BY 1),
x AS (SELECT group_id, v, u, count(*) AS c, sum(confidence) AS s FROM mask_pixels JOIN g USING (frame_key, mask_id) GROUP BY ALL),
m AS (SELECT group_id, v, u FROM x JOIN t USING (group_id) WHERE {rule}),
f AS (SELECT t.group_id, v, u FROM t JOIN mask_pixels p ON p.mask_id = t.first WHERE t.group_id NOT IN (SELECT group_id FROM m))
SELECT group_id, count(*) AS area, min(u) AS bx1, min(v) AS by1, max(u) AS bx2, max(v) AS by2
FROM (SELECT * FROM m UNION ALL SELECT * FROM f) GROUP BY group_id"""


def _merged(spark, d, mode):
    px = mk.merge(src.mask_pixels(spark, d),
                  _members(spark, d).select("frame_key", "group_id", "mask_id", "confidence"), mode)
    return mk.shape(px, ("group_id",))


@query("V15_merge_union", _merge_sql("true"))
def v15u(spark, d):
    return _merged(spark, d, "union")


@query("V15_merge_intersection", _merge_sql("c = n"))
def v15i(spark, d):
    return _merged(spark, d, "intersection")


@query("V15_merge_weighted", _merge_sql("round(s / w, 9) > 0.5"))
def v15w(spark, d):
    return _merged(spark, d, "weighted")


@query("U05_group_sources", """
SELECT mask_id // 3 AS group_id, count(DISTINCT source) AS n_sources, round(avg(confidence), 6) AS confidence,
 round(coalesce(avg(depth_median) FILTER (depth_median > 0), 0), 6) AS depth_median FROM masks GROUP BY 1""")
def u05(spark, d):
    p = mk.merged_properties(_members(spark, d))
    return p.select("group_id", "n_sources", F.round("confidence", 6).alias("confidence"),
                    F.round("depth_median", 6).alias("depth_median"))


# Walks every frame in order, one mask per step, and keeps the seeds found so far in a list.
WALK = PAIRS.replace("WITH m AS", "WITH RECURSIVE m AS") + """
, r AS (SELECT frame_key, mask_id, row_number() OVER (PARTITION BY frame_key ORDER BY
 CASE source WHEN 'fastsam' THEN 1 WHEN 'depth' THEN 2 ELSE 3 END, mask_id) AS k FROM m),
e AS MATERIALIZED (SELECT frame_key, a, b FROM o WHERE iou >= 0.3 UNION ALL SELECT frame_key, b, a FROM o WHERE iou >= 0.3),
nb AS MATERIALIZED (SELECT r.frame_key, r.k, r.mask_id, coalesce(list(e.b ORDER BY r2.k) FILTER (e.b IS NOT NULL), []) AS before
 FROM r LEFT JOIN (e JOIN r r2 ON r2.frame_key = e.frame_key AND r2.mask_id = e.b)
 ON e.frame_key = r.frame_key AND e.a = r.mask_id AND r2.k < r.k GROUP BY ALL),
walk(frame_key, k, seeds, mask_id, group_id) AS (
 SELECT frame_key, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT frame_key FROM m) UNION ALL
 SELECT w.frame_key, nb.k, CASE WHEN len(list_intersect(nb.before, w.seeds)) = 0 THEN list_append(w.seeds, nb.mask_id) ELSE w.seeds END,
 nb.mask_id, coalesce(list_filter(nb.before, lambda x: list_contains(w.seeds, x))[1], nb.mask_id)
 FROM walk w JOIN nb ON nb.frame_key = w.frame_key AND nb.k = w.k + 1)
"""


@query("V16_fusion_groups", WALK + "SELECT frame_key, mask_id, group_id FROM walk WHERE mask_id IS NOT NULL")
def v16g(spark, d):
    return mk.seed_groups(src.masks(spark, d), mk.words(src.mask_pixels(spark, d)))


FUSED = WALK + """, g AS (SELECT frame_key, mask_id, group_id, confidence, source, depth_median FROM walk JOIN masks USING (frame_key, mask_id)),
t AS (SELECT group_id, any_value(frame_key) AS frame_key, count(*) AS n, sum(confidence) AS w, min(mask_id) AS first, count(DISTINCT source) AS ns,
 avg(confidence) AS c, coalesce(avg(depth_median) FILTER (depth_median > 0), 0) AS depth FROM g GROUP BY 1),
x AS (SELECT group_id, v, u, sum(confidence) AS s FROM mask_pixels JOIN g USING (frame_key, mask_id) GROUP BY ALL),
mm AS (SELECT group_id, v, u FROM x JOIN t USING (group_id) WHERE round(s / w, 9) > 0.5),
ff AS (SELECT t.group_id, v, u FROM t JOIN mask_pixels px ON px.mask_id = t.first WHERE t.group_id NOT IN (SELECT group_id FROM mm))
"""
_PROPS = """ns AS n_sources, round(CASE WHEN n = 1 THEN greatest(0.1, c - 0.05) ELSE least(1.0, c + 0.1 * ns / 3) END, 6) AS confidence"""


def _fusion_rows(f):
    return f.select("group_id", "area", "bx1", "by1", "bx2", "by2", "n_sources", F.round("confidence", 6).alias("confidence"),
                    F.round("depth_median", 6).alias("depth_median"))


@query("V16_fusion", FUSED + f"""SELECT group_id, area, bx1, by1, bx2, by2, {_PROPS}, round(depth, 6) AS depth_median
FROM (SELECT group_id, count(*) AS area, min(u) AS bx1, min(v) AS by1, max(u) AS bx2, max(v) AS by2
 FROM (SELECT * FROM mm UNION ALL SELECT * FROM ff) GROUP BY 1) JOIN t USING (group_id) WHERE area BETWEEN 100 AND 500000""")
def v16(spark, d):
    return _fusion_rows(mk.fuse(src.masks(spark, d), src.mask_pixels(spark, d), min_area=100))


@query("V16_V17_fusion_refined", FUSED + f""", whole AS MATERIALIZED (SELECT frame_key, group_id AS mask_id, v, u FROM (SELECT * FROM mm UNION ALL SELECT * FROM ff) JOIN t USING (group_id)),
{refined_sql("whole", 30)},
left_m AS (SELECT mask_id AS group_id, median(depth_raw) / 1000 AS m FROM kept JOIN pixels USING (frame_key, v, u) WHERE depth_raw > 0 GROUP BY 1)
SELECT group_id, area, bx1, by1, bx2, by2, {_PROPS}, round(coalesce(left_m.m, depth), 6) AS depth_median
FROM (SELECT mask_id AS group_id, count(*) AS area, min(u) AS bx1, min(v) AS by1, max(u) AS bx2, max(v) AS by2
 FROM (SELECT * FROM kept UNION ALL SELECT * FROM whole WHERE mask_id NOT IN (SELECT mask_id FROM kept)) GROUP BY 1)
JOIN t USING (group_id) LEFT JOIN left_m USING (group_id) WHERE area BETWEEN 50 AND 500000""")
def v16r(spark, d):
    return _fusion_rows(dp.fuse_refined(src.masks(spark, d), src.mask_pixels(spark, d), src.pixels(spark, d), src.GRID_W, src.GRID_H,
                                        least=30, min_area=50))


# Walks every frame in order of priority with the list of pixels that are taken.
def _resolve_sql(chosen):
    return f"""{chosen}
px AS MATERIALIZED (SELECT frame_key, mask_id, any_value(confidence) AS confidence, list(v * 64 + u) AS pix, count(*) AS area, mask_id % 3 AS priority
 FROM mask_pixels JOIN chosen USING (frame_key, mask_id) GROUP BY ALL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY priority DESC, area DESC, mask_id) AS k FROM px),
walk(frame_key, k, taken, mask_id, outcome, kept_area, confidence) AS (
 SELECT frame_key, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::DOUBLE FROM (SELECT DISTINCT frame_key FROM o)
 UNION ALL SELECT frame_key, k, CASE WHEN outcome = 'dropped' THEN taken ELSE list_distinct(list_concat(taken, pix)) END, mask_id, outcome,
 CASE outcome WHEN 'whole' THEN area ELSE area - used END, CASE outcome WHEN 'cut' THEN confidence * 0.9::DOUBLE ELSE confidence END
 FROM (SELECT *, CASE WHEN used / area >= 0.5 AND area - used < 40 THEN 'dropped' WHEN used / area >= 0.5 THEN 'cut' ELSE 'whole' END AS outcome
  FROM (SELECT w.frame_key, o.k, o.mask_id, o.pix, o.area, o.confidence, w.taken, len(list_intersect(o.pix, w.taken)) AS used
   FROM walk w JOIN o ON o.frame_key = w.frame_key AND o.k = w.k + 1)))
SELECT frame_key, mask_id, outcome, kept_area, round(confidence, 6) AS confidence FROM walk WHERE outcome <> 'dropped'"""


@query("V19_resolve_conflicts", _resolve_sql("WITH RECURSIVE chosen AS (SELECT frame_key, mask_id, confidence FROM masks),"))
def v19(spark, d):
    m = src.masks(spark, d).select("frame_key", "mask_id", (F.col("mask_id") % 3).alias("priority"),
                                   "confidence")
    return mk.resolve(m, src.mask_pixels(spark, d), min_area=40).select(
        "frame_key", "mask_id", "outcome", "kept_area", F.round("confidence", 6).alias("confidence"))


@query("V20_managed_masks", _resolve_sql("""WITH RECURSIVE t AS (SELECT frame_key // 8 AS scene, frame_key, object_id, max(mask_id) AS mask_id FROM masks
 WHERE source = 'fastsam' GROUP BY ALL),
c AS (SELECT t.scene, t.frame_key, m.x1, m.y1, m.x2, m.y2, lead(t.frame_key) OVER (PARTITION BY t.scene, t.object_id ORDER BY t.frame_key) AS until
 FROM t JOIN masks m USING (mask_id)),
chosen AS (SELECT frame_key, mask_id, confidence FROM masks n WHERE source <> 'fastsam' AND NOT EXISTS (SELECT 1 FROM c
 WHERE c.scene = n.frame_key // 8 AND c.frame_key <= n.frame_key AND n.frame_key - c.frame_key <= 5 AND (c.until IS NULL OR n.frame_key < c.until)
 AND greatest(0, least(n.x2, c.x2) - greatest(n.x1, c.x1)) * greatest(0, least(n.y2, c.y2) - greatest(n.y1, c.y1))
 / least((n.x2 - n.x1) * (n.y2 - n.y1), (c.x2 - c.x1) * (c.y2 - c.y1)) >= 0.5)),"""))
def v20(spark, d):
    m = src.masks(spark, d).select(
        "frame_key", "mask_id", "source", "object_id", "confidence", (F.col("mask_id") % 3).alias("priority"),
        F.timestamp_micros(F.col("frame_key") * 100_000).alias("ts"), F.floor(F.col("frame_key") / 8).alias("scene"))
    px = src.mask_pixels(spark, d)
    kept = mk.manage(m.filter("source <> 'fastsam'"), mk.words(px), px,
                     m.filter("source = 'fastsam'").select("scene", "object_id", "mask_id", "ts"), STALE_US, min_area=40)
    return kept.select("frame_key", "mask_id", "outcome", "kept_area", F.round("confidence", 6).alias("confidence"))
