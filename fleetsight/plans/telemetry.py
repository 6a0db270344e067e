"""Queries over timing, metric and memory logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.functions.scalar import instant, micros
from fleetsight.operators import telemetry as tm
from fleetsight.plans.core import AS_OF
from fleetsight.plans.registry import query
from fleetsight.sources import derive as src


def _r(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("A21_stage_stats", """
WITH s AS (SELECT stage, duration_ms AS d, row_number() OVER (PARTITION BY stage ORDER BY duration_ms) - 1 AS k,
 count(*) OVER (PARTITION BY stage) AS n FROM stage_timings)
SELECT stage, count(*) AS count, round(sum(d), 4) AS total_ms, min(d) AS min_ms, max(d) AS max_ms,
 round(avg(d), 4) AS mean_ms, round(stddev_pop(d), 4) AS std_ms,
 max(d) FILTER (k = least(n * 50 // 100, n - 1)) AS p50_ms, max(d) FILTER (k = least(n * 95 // 100, n - 1)) AS p95_ms,
 max(d) FILTER (k = least(n * 99 // 100, n - 1)) AS p99_ms FROM s GROUP BY stage""")
def a21(spark, d):
    return _r(tm.stage_stats(src.stage_timings(spark, d)), "total_ms", "mean_ms", "std_ms")


LAST = """SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, event_id DESC) AS rn FROM {table}"""


@query("A22_latency_stats", f"""
WITH r AS (SELECT * FROM ({LAST.format(key='stage', table='stage_timings')}) WHERE rn <= 100)
SELECT stage, count(*) AS samples, round(avg(duration_ms), 4) AS mean, min(duration_ms) AS min, max(duration_ms) AS max,
 round(coalesce(stddev_samp(duration_ms), 0), 4) AS std, round(median(duration_ms), 4) AS p50,
 CASE WHEN count(*) >= 20 THEN list_sort(list(duration_ms))[(count(*) * 95) // 100 + 1] ELSE max(duration_ms) END AS p95,
 CASE WHEN count(*) >= 100 THEN list_sort(list(duration_ms))[(count(*) * 99) // 100 + 1] ELSE max(duration_ms) END AS p99
FROM r GROUP BY stage""")
def a22(spark, d):
    return _r(tm.latency_stats(src.stage_timings(spark, d)), "mean", "std", "p50")


@query("A23_metric_stats", f"""
WITH r AS (SELECT * FROM ({LAST.format(key='name', table="(SELECT * FROM metric_samples WHERE ts <= TIMESTAMP '" + AS_OF + "')")})
 WHERE rn <= 100 AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) < 86400000000)
SELECT name, arg_max(value, (ts, event_id)) AS current, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max,
 round(coalesce(stddev_samp(value), 0), 4) AS std, count(*) AS samples, any_value(unit) AS unit FROM r GROUP BY name""")
def a23(spark, d):
    s = tm.metric_stats(src.metric_samples(spark, d), instant(AS_OF), 100, 86400.0)
    return _r(s, "mean", "std")


FRAMES = """SELECT frame_id, sum(duration_ms) AS total_ms, max(ts) AS ts, bool_or(skipped) AS skipped, count(*) AS stages
 FROM stage_timings GROUP BY frame_id"""


@query("A24_mean_times", f"""
WITH f AS (SELECT * FROM (SELECT * FROM ({FRAMES}) ORDER BY frame_id DESC LIMIT 100) WHERE NOT skipped),
s AS (SELECT stage, sum(duration_ms) AS ms FROM stage_timings WHERE frame_id IN (SELECT frame_id FROM f) GROUP BY frame_id, stage)
SELECT stage, round(avg(ms), 4) AS mean_ms FROM (SELECT * FROM s UNION ALL SELECT '_frame', total_ms FROM f) GROUP BY stage""")
def a24(spark, d):
    return _r(tm.mean_times(src.stage_timings(spark, d)), "mean_ms")


@query("A25_frame_breakdown", """
WITH s AS (SELECT frame_id, stage, sum(duration_ms) AS ms FROM stage_timings GROUP BY ALL)
SELECT frame_id, stage, round(ms, 4) AS ms, round(CASE WHEN t > 0 THEN ms / t * 100 ELSE 0 END, 4) AS percent,
 round(t, 4) AS total_ms FROM (SELECT *, sum(ms) OVER (PARTITION BY frame_id) AS t FROM s)""")
def a25(spark, d):
    return _r(tm.frame_breakdown(src.stage_timings(spark, d)), "ms", "percent", "total_ms")


@query("A26_fps_variants", """
WITH r AS (SELECT camera_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM (
 SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY ts DESC, det_id DESC) AS k FROM base_detections) WHERE k <= 30
 GROUP BY 1), t AS (SELECT camera_id, count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS u FROM base_detections GROUP BY 1)
SELECT camera_id, n, round((n - 1) / span, 9) AS fps_intervals, round(n / span, 9) AS fps_frames,
 round(1 / (span / (n - 1)), 9) AS fps_mean_gap, round(u, 9) AS fps_uptime FROM r JOIN t USING (camera_id)""")
def a26(spark, d):
    v = tm.fps_variants(src.base_detections(spark, d), ["camera_id"])
    return _r(v, "fps_intervals", "fps_frames", "fps_mean_gap", "fps_uptime", digits=9)


@query("A27_peak_memory", """
SELECT epoch_us(ts) AS ts, rss_mb, vms_mb, percent, available_mb FROM memory_samples ORDER BY rss_mb DESC, event_id LIMIT 1""")
def a27(spark, d):
    return tm.peak_memory(src.memory_samples(spark, d)).withColumn("ts", micros(F.col("ts")))


@query("A28_profile_report", f"""
WITH f AS (SELECT * FROM ({FRAMES}) ORDER BY frame_id DESC LIMIT 100)
SELECT (SELECT count(*) FROM ({FRAMES})) AS frames, (SELECT round(avg(total_ms), 4) FROM f WHERE NOT skipped) AS mean_frame_ms,
 (SELECT max(rss_mb) FROM memory_samples) AS peak_rss_mb,
 (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT stage || ':' || event_id AS x FROM stage_timings WHERE duration_ms > 100
 ORDER BY duration_ms DESC, event_id LIMIT 5)) AS slowest,
 (SELECT stage FROM stage_timings GROUP BY stage ORDER BY sum(duration_ms) DESC, stage LIMIT 1) AS heaviest_stage""")
def a28(spark, d):
    t = src.stage_timings(spark, d)
    frames = tm.frame_profiles(t)
    recent = tm.recent_frames(frames).filter(~F.col("skipped"))
    slow = tm.slow_operations(t).orderBy(F.desc("duration_ms"), "event_id").limit(5)
    names = slow.agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(":", "stage", "event_id"))), ","))
    heavy = tm.stage_stats(t).orderBy(F.desc("total_ms"), "stage").limit(1).select("stage")
    return frames.agg(F.count(F.lit(1)).alias("frames")).select(
        "frames", recent.agg(F.round(F.avg("total_ms"), 4)).scalar().alias("mean_frame_ms"),
        tm.peak_memory(src.memory_samples(spark, d)).select("rss_mb").scalar().alias("peak_rss_mb"),
        names.scalar().alias("slowest"), heavy.scalar().alias("heaviest_stage"))


@query("A31_dashboard_counts", """
SELECT count(*) AS total_objects, count(*) FILTER (classification_status = 'needs_review') AS needs_review,
 count(DISTINCT camera_id) AS cameras, (SELECT count(*) FROM review_queue WHERE status = 'pending') AS pending_reviews,
 (SELECT epoch_us(max(ts)) FROM events) AS newest_frame FROM objects""")
def a31(spark, d):
    pend = src.review_queue(spark, d).filter(F.col("status") == "pending").agg(F.count(F.lit(1)))
    newest = src.table(spark, d, "events").agg(micros(F.max("ts")))
    return src.objects(spark, d).agg(
        F.count(F.lit(1)).alias("total_objects"),
        F.count_if(F.col("classification_status") == "needs_review").alias("needs_review"),
        F.count_distinct("camera_id").alias("cameras")).select(
        "*", pend.scalar().alias("pending_reviews"), newest.scalar().alias("newest_frame"))


@query("A32_dashboard_metrics", f"""
WITH r AS (SELECT * FROM ({LAST.format(key='stage', table='stage_timings')}))
SELECT stage, epoch_us(ts) AS ts, duration_ms AS value, round(m, 4) AS mean_ms, n AS frame_count FROM r
JOIN (SELECT stage, avg(duration_ms) AS m FROM r WHERE rn <= 100 GROUP BY 1) USING (stage)
JOIN (SELECT stage, count(*) AS n FROM stage_timings GROUP BY 1) USING (stage) WHERE rn <= 60""")
def a32(spark, d):
    t = src.stage_timings(spark, d)
    recent = tm.last_per_key(t, ["stage"], 100)
    mean = recent.groupBy("stage").agg(F.round(F.avg("duration_ms"), 4).alias("mean_ms"))
    n = t.groupBy("stage").agg(F.count(F.lit(1)).alias("frame_count"))
    hist = recent.filter(F.col("rn") <= 60)
    return hist.join(mean, "stage").join(n, "stage").select(
        "stage", micros(F.col("ts")).alias("ts"), F.col("duration_ms").alias("value"), "mean_ms",
        "frame_count")


@query("F31_slow_operations", """
SELECT event_id, stage, duration_ms FROM stage_timings WHERE duration_ms > 100""")
def f31(spark, d):
    return tm.slow_operations(src.stage_timings(spark, d)).select("event_id", "stage", "duration_ms")


@query("F32_memory_warnings", """
SELECT event_id, 'Memory usage (' || printf('%.1f', rss_mb) || 'MB) exceeds threshold (500.0MB)' AS message
FROM (SELECT event_id, rss_mb + 0.0031::DOUBLE AS rss_mb FROM memory_samples) WHERE rss_mb > 500""")
def f32(spark, d):
    m = src.memory_samples(spark, d).withColumn("rss_mb", F.col("rss_mb") + 0.0031)
    return tm.memory_warnings(m, 500.0).select("event_id", "message")


PER_FRAME = """SELECT camera_id, epoch_us(ts) // 3600000000 AS frame_hour, count(*) AS objects,
 avg(confidence) AS motion FROM base_detections GROUP BY ALL"""
LEVEL = """CASE WHEN lv = 0 THEN 'low' WHEN lv = 1 THEN 'medium' WHEN lv = 2 THEN 'high' ELSE 'extreme' END"""
COMPLEX = f"""SELECT *, {LEVEL} AS complexity FROM (SELECT *, least(3, CASE WHEN objects <= 3 THEN 0 WHEN objects <= 10 THEN 1
 WHEN objects <= 25 THEN 2 ELSE 3 END + CASE WHEN motion > 0.5 THEN 1 ELSE 0 END) AS lv FROM ({PER_FRAME}))"""


def _scenes(spark, d):
    b = src.base_detections(spark, d)
    per = b.groupBy("camera_id", src.hour_of(F.col("ts")).alias("frame_hour")).agg(
        F.count(F.lit(1)).alias("objects"), F.avg("confidence").alias("motion"))
    return per.withColumn("complexity", tm.complexity(F.col("objects"), F.col("motion")))


@query("F34_scene_complexity", f"SELECT camera_id, frame_hour, objects, complexity FROM ({COMPLEX})")
def f34(spark, d):
    return _scenes(spark, d).select("camera_id", "frame_hour", "objects", "complexity")


@query("F35_processing_cost", f"""
SELECT complexity, mode, count(*) AS frames, round(sum(base * factor), 2) AS cost_ms FROM ({COMPLEX})
JOIN (VALUES ('low', 30.0::DOUBLE), ('medium', 50), ('high', 80), ('extreme', 120)) b(complexity, base) USING (complexity),
 (VALUES ('full', 1.0::DOUBLE), ('balanced', 0.7), ('fast', 0.4), ('minimal', 0.25)) m(mode, factor) GROUP BY ALL""")
def f35(spark, d):
    j = _scenes(spark, d).join(F.broadcast(tm.mode_costs(spark)), "complexity")
    return j.groupBy("complexity", "mode").agg(F.count(F.lit(1)).alias("frames"),
                                               F.round(F.sum("cost_ms"), 2).alias("cost_ms"))


RECOMMENDED = """CASE WHEN fps <= 0 THEN 'balanced' WHEN fps >= 18 THEN 'full' WHEN fps >= 15 THEN 'balanced'
 WHEN fps >= 12 THEN 'fast' ELSE 'minimal' END"""


@query("F36_mode_features", f"""
SELECT mode, feature, count(*) AS events, bool_and(enabled) AS enabled FROM (
 SELECT {RECOMMENDED} AS mode FROM (SELECT value / 10 AS fps FROM events)) JOIN (
 SELECT mode, feature, list_contains(enabled, feature) AS enabled FROM (VALUES
 ('full', ['fastsam','depth_segmentation','pointcloud','pose_estimation','face_detection','plate_detection','imagenet_classification','reid_matching']),
 ('balanced', ['fastsam','depth_segmentation','pose_estimation','plate_detection','reid_matching']),
 ('fast', ['fastsam','reid_matching']), ('minimal', ['fastsam'])) m(mode, enabled),
 (SELECT unnest(['fastsam','depth_segmentation','pointcloud','pose_estimation','face_detection','plate_detection',
 'imagenet_classification','reid_matching']) AS feature)) USING (mode) GROUP BY ALL""")
def f36(spark, d):
    v = src.table(spark, d, "events").select(
        tm.recommended_mode(F.col("value") / 10).alias("mode")).groupBy("mode").agg(
        F.count(F.lit(1)).alias("events"))
    return v.join(F.broadcast(tm.mode_features(spark)), "mode").select(
        "mode", "feature", "events", "enabled")


@query("F37_recommended_mode", f"""
SELECT event_id, {RECOMMENDED} AS mode FROM (SELECT event_id, value / 10 AS fps FROM events)""")
def f37(spark, d):
    return src.table(spark, d, "events").select(
        "event_id", tm.recommended_mode(F.col("value") / 10).alias("mode"))


@query("F40_health_alerts", """
SELECT event_id, name, value, limit_value FROM metric_samples JOIN (VALUES ('view', 5.0::DOUBLE, 'below'), ('click', 90.0, 'above'),
 ('error', 75.0, 'above')) l(name, limit_value, direction) USING (name)
WHERE CASE WHEN direction = 'below' THEN value < limit_value ELSE value > limit_value END""")
def f40(spark, d):
    limits = spark.createDataFrame([("view", 5.0, "below"), ("click", 90.0, "above"),
                                    ("error", 75.0, "above")],
                                   "name string, limit_value double, direction string")
    return tm.health_alerts(src.metric_samples(spark, d), limits).select(
        "event_id", "name", "value", "limit_value")


@query("W08_bounded_history", f"""
SELECT stage, event_id, rn::INTEGER AS rn FROM ({LAST.format(key='stage', table='stage_timings')}) WHERE rn <= 1000""")
def w08(spark, d):
    return tm.last_per_key(src.stage_timings(spark, d), ["stage"], 1000).select(
        "stage", "event_id", "rn")


GAPS = """SELECT camera_id, frame_no, det_id, avg(gap) OVER b AS mean_gap, count(gap) OVER b AS gaps, avg(ms) OVER b AS mean_ms FROM (
 SELECT camera_id, frame_no, det_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY camera_id ORDER BY frame_no)) / 1e6 AS gap,
 confidence * 100 AS ms FROM detections) WINDOW b AS (PARTITION BY camera_id ORDER BY frame_no ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""
FPS = f"""SELECT *, CASE WHEN gaps >= 2 AND mean_gap > 0 THEN 1 / mean_gap ELSE 0 END AS fps FROM ({GAPS})"""


def _rolling(spark, d):
    det = src.detections(spark, d).withColumn("processing_ms", F.col("confidence") * 100)
    return tm.rolling_fps(det)


@query("W09_rolling_fps", f"""
SELECT det_id, round(mean_gap, 3) AS mean_gap, gaps, round(mean_ms, 4) AS mean_ms FROM ({FPS})""")
def w09(spark, d):
    return _rolling(spark, d).select("det_id", F.round("mean_gap", 3).alias("mean_gap"), "gaps",
                                     F.round("mean_ms", 4).alias("mean_ms"))


# The data has one frame every few minutes, so rates are scaled up to reach all modes.
SCALE = 1200.0


MODES = f"""
WITH f AS (SELECT camera_id, frame_no, det_id, {RECOMMENDED} AS m FROM (SELECT * REPLACE (round(fps * {SCALE}, 6) * (1 + det_id % 3) AS fps) FROM ({FPS}))),
w AS (SELECT *, list(m) OVER (PARTITION BY camera_id ORDER BY frame_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM f),
v AS (SELECT *, list_sort(list_transform(list_distinct(s), lambda x: {{'votes': -len(list_filter(s, lambda y: y = x)), 'p': list_position(s, x), 'm': x}}))[1] AS b FROM w),
e AS (SELECT *, CASE WHEN len(s) >= 5 AND b.votes <= -3 THEN b.m END AS elected FROM v)
SELECT det_id, coalesce(last_value(elected IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY frame_no
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'balanced') AS mode FROM e"""


def recommendations(spark, d):
    """What the frame rate of each frame recommends."""
    fps = F.round(F.col("fps") * SCALE, 6) * (1 + F.col("det_id") % 3)
    return _rolling(spark, d).withColumn("recommended", tm.recommended_mode(fps))


@query("A29_T10_mode_votes", MODES)
def a29(spark, d):
    return tm.mode_votes(recommendations(spark, d)).select("det_id", "mode")


@query("W15_skip_flags", f"""
WITH f AS (SELECT camera_id, frame_no, det_id, mean_ms > 55 OR (fps > 0 AND round(fps * {SCALE}, 6) < 12) AS wants FROM ({FPS})),
g AS (SELECT *, coalesce(max(CASE WHEN NOT wants THEN frame_no END) OVER (PARTITION BY camera_id ORDER BY frame_no), 0) AS start FROM f)
SELECT det_id, wants AS wants_skip, wants AND (frame_no - start) % 3 <> 0 AS skipped FROM g""")
def w15(spark, d):
    f = _rolling(spark, d).withColumn("fps", F.round(F.col("fps") * SCALE, 6)).withColumn(
        "age_ms", F.col("mean_ms"))
    return tm.skip_flags(f, stale_ms=55.0).select("det_id", "wants_skip", "skipped")


@query("W11_latest_stage_output", f"""
SELECT stage, arg_max(frame_id, (ts, event_id)) AS frame_id,
 round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 1000, 3) AS age_ms FROM stage_timings GROUP BY stage""")
def w11(spark, d):
    t = src.stage_timings(spark, d).groupBy("stage").agg(
        F.max_by("frame_id", F.struct("ts", "event_id")).alias("frame_id"), F.max("ts").alias("ts"))
    age = (micros(instant("2024-02-01 00:00:00")) - micros(F.col("ts"))) / 1000
    return t.select("stage", "frame_id", F.round(age, 3).alias("age_ms"))


@query("W12_latest_camera_frame", """
SELECT camera_id, arg_max(frame_no, frame_no) AS frame_no, arg_max(det_id, frame_no) AS det_id FROM detections GROUP BY 1""")
def w12(spark, d):
    return src.detections(spark, d).groupBy("camera_id").agg(
        F.max("frame_no").alias("frame_no"), F.max_by("det_id", "frame_no").alias("det_id"))


@query("S15_frame_ingest", """
SELECT frame_key, count(*) AS pixels, count(*) FILTER (depth_raw > 0) AS valid, round(sum(depth_raw * 0.001::DOUBLE), 3) AS depth_m
FROM pixels GROUP BY frame_key""")
def s15(spark, d):
    p = src.pixels(spark, d).withColumn("depth", F.col("depth_raw") * 0.001)
    return p.groupBy("frame_key").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("depth_raw") > 0).alias("valid"),
        F.round(F.sum("depth"), 3).alias("depth_m"))


@query("S16_all_cameras", """
SELECT camera_id, det_id, epoch_us(ts) AS ts FROM (SELECT unnest(['cam_0','cam_1','cam_2','cam_3','cam_9']) AS camera_id)
LEFT JOIN (SELECT camera_id, arg_max(det_id, (ts, det_id)) AS det_id, max(ts) AS ts FROM base_detections GROUP BY 1) USING (camera_id)""")
def s16(spark, d):
    cams = spark.createDataFrame([(f"cam_{i}",) for i in (0, 1, 2, 3, 9)], "camera_id string")
    last = src.base_detections(spark, d).groupBy("camera_id").agg(
        F.max_by("det_id", F.struct("ts", "det_id")).alias("det_id"), F.max("ts").alias("ts"))
    return cams.join(last, "camera_id", "left").withColumn("ts", micros(F.col("ts")))
