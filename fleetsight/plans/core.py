"""Queries over detections and the object store."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from fleetsight.functions.scalar import (csv_longs, csv_text, from_iso, human_bytes, human_latency,
                                         human_percent, instant, iso_text, micros, age_seconds)
from fleetsight.functions.windows import row_numbers
from fleetsight.operators import objects as store, routing
from fleetsight.operators.ranks import rank_slice
from fleetsight.plans.registry import query
from fleetsight.session import scratch
from fleetsight.sources import buckets, derive as src

AS_OF = "2024-01-30 12:00:00"
AREA = "(x2 - x1) * (y2 - y1)"
PERSONS = ", ".join(f"'{c}'" for c in routing.PERSON_CLASSES)
VEHICLES = ", ".join(f"'{c}'" for c in routing.VEHICLE_CLASSES)
BRANCH = f"""CASE WHEN confidence < 0.3 THEN 'generic' WHEN class_name IN ({PERSONS}) AND {AREA} >= 1000 THEN 'person'
 WHEN class_name IN ({VEHICLES}) AND {AREA} >= 2000 THEN 'vehicle' ELSE 'generic' END"""
REASON = f"""CASE WHEN confidence < 0.3 THEN 'confidence_below_threshold'
 WHEN {BRANCH} <> 'generic' THEN 'class_match' ELSE 'default_fallback' END"""
STATUS = """CASE WHEN confidence >= 0.85 THEN 'confirmed' WHEN confidence >= 0.5 THEN 'provisional'
 ELSE 'needs_review' END"""


def _us(name: str):
    return micros(F.col(name)).alias(name)


def _routed(spark, d):
    det = routing.with_area(src.base_detections(spark, d))
    return routing.route(det, routing.class_routes(spark))


@query("flagship_route_status", f"""
SELECT camera_id, branch, status, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM (
 SELECT camera_id, {BRANCH} AS branch, {STATUS} AS status, confidence FROM base_detections)
GROUP BY ALL""")
def flagship(spark, d):
    r = routing.review_route(_routed(spark, d))
    return r.groupBy("camera_id", "branch", "status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("F07_box_area_center", f"""
SELECT det_id, ({AREA})::INTEGER AS area, ((x1 + x2) // 2)::INTEGER AS cx, ((y1 + y2) // 2)::INTEGER AS cy
FROM base_detections""")
def f07(spark, d):
    return routing.with_area(src.base_detections(spark, d)).select("det_id", "area", "cx", "cy")


@query("F08_status_counts", f"SELECT class_name, {STATUS} AS status, count(*) AS n FROM base_detections GROUP BY ALL")
def f08(spark, d):
    b = src.base_detections(spark, d)
    return b.groupBy("class_name", routing.status_of(F.col("confidence")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


@query("F09_object_ages", f"""
SELECT id, classification_status = 'needs_review' AS needs_review, classification_status = 'confirmed' AS is_confirmed,
 round((epoch_us(last_seen) - epoch_us(first_seen)) / 1e6, 3) AS age_s,
 round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_seen)) / 1e6, 3) AS unseen_s FROM objects""")
def f09(spark, d):
    s = F.col("classification_status")
    return src.objects(spark, d).select(
        "id", (s == "needs_review").alias("needs_review"), (s == "confirmed").alias("is_confirmed"),
        F.round(age_seconds(F.col("first_seen"), F.col("last_seen")), 3).alias("age_s"),
        F.round(age_seconds(F.col("last_seen"), instant(AS_OF)), 3).alias("unseen_s"))


@query("F22_route", f"""
SELECT det_id, {BRANCH} AS branch, {REASON} AS route_reason,
 CASE WHEN {BRANCH} <> 'generic' THEN class_name END AS matched_class FROM base_detections""")
def f22(spark, d):
    return _routed(spark, d).select("det_id", "branch", "route_reason", "matched_class")


@query("F23_branch_of_class", f"""
SELECT class_name, CASE WHEN class_name IN ({PERSONS}) THEN 'person' WHEN class_name IN ({VEHICLES}) THEN 'vehicle'
 ELSE 'generic' END AS branch, count(*) AS n FROM base_detections GROUP BY ALL""")
def f23(spark, d):
    b = src.base_detections(spark, d).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    return routing.lookup_branch(b, routing.class_routes(spark)).select("class_name", "branch", "n")


@query("U02_custom_classes", f"""
SELECT CASE WHEN class_name IN ({PERSONS}) THEN 'person' WHEN class_name IN ({VEHICLES}, 'chair') THEN 'vehicle'
 ELSE 'generic' END AS branch, count(*) AS n FROM base_detections GROUP BY ALL""")
def u02(spark, d):
    routes = routing.class_routes(spark, [("chair", "vehicle"), ("car", "vehicle")])
    return routing.lookup_branch(src.base_detections(spark, d), routes).groupBy("branch").agg(
        F.count(F.lit(1)).alias("n"))


@query("A04_route_counts", f"""
SELECT branch, count(*) AS n FROM (SELECT {BRANCH} AS branch, {REASON} AS r FROM base_detections)
WHERE r <> 'confidence_below_threshold' GROUP BY branch""")
def a04(spark, d):
    return routing.route_counts(_routed(spark, d))


MARGIN = """SELECT det_id, max(confidence) FILTER (k = 1) - max(confidence) FILTER (k = 2) AS margin FROM (
 SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY confidence DESC, class_name) AS k FROM alternatives)
 GROUP BY det_id"""


@query("F24_review_route", f"""
SELECT det_id, CASE WHEN margin < 0.1 THEN 'needs_review' ELSE {STATUS} END AS status,
 CASE WHEN margin < 0.1 THEN 'ambiguous_class' WHEN confidence < 0.5 THEN 'low_confidence' END AS reason
FROM base_detections JOIN ({MARGIN}) USING (det_id)""")
def f24(spark, d):
    m = routing.top_margin(src.alternatives(spark, d)).select("det_id", "margin")
    return routing.review_route(src.base_detections(spark, d).join(m, "det_id"), "margin").select(
        "det_id", "status", "reason")


@query("W06_top2_margin", f"SELECT det_id, round(margin, 6) AS margin FROM ({MARGIN})")
def w06(spark, d):
    return routing.top_margin(src.alternatives(spark, d)).select(
        "det_id", F.round("margin", 6).alias("margin"))


@query("F25_reprocess", f"""
SELECT id, confidence FROM objects WHERE classification_status = 'provisional'
 AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_seen) >= 60000000""")
def f25(spark, d):
    from fleetsight.operators.review import needs_reprocess
    return needs_reprocess(src.objects(spark, d), instant(AS_OF)).select("id", "confidence")


@query("F26_priority", """
SELECT id, CASE WHEN reason = 'user_flagged' THEN 'urgent' WHEN confidence < 0.2 THEN 'high' ELSE 'low' END AS priority
FROM review_queue""")
def f26(spark, d):
    q = src.review_queue(spark, d)
    return q.select("id", routing.priority_name(
        routing.review_priority(F.col("reason"), F.col("confidence"))).alias("priority"))


@query("F01_newest_of_class", """
SELECT id, camera_id, epoch_us(last_seen) AS last_seen FROM objects WHERE primary_class = 'person'
ORDER BY objects.last_seen DESC, id LIMIT 50""")
def f01(spark, d):
    o = src.objects(spark, d).filter(F.col("primary_class") == "person")
    return store.newest(o, 50).select("id", "camera_id", _us("last_seen"))


@query("F02_newest_of_camera", """
SELECT id, primary_class, epoch_us(last_seen) AS last_seen FROM objects WHERE camera_id = 'cam_1'
ORDER BY objects.last_seen DESC, id LIMIT 50""")
def f02(spark, d):
    o = src.objects(spark, d).filter(F.col("camera_id") == "cam_1")
    return store.newest(o, 50).select("id", "primary_class", _us("last_seen"))


@query("F03_seen_recently", f"""
SELECT id, camera_id FROM objects WHERE camera_id = 'cam_1' AND last_seen <= TIMESTAMP '{AS_OF}'
 AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_seen) < 172800000000""")
def f03(spark, d):
    return store.seen_since(src.objects(spark, d), instant(AS_OF), 172800.0, "cam_1").select(
        "id", "camera_id")


@query("F04_needs_review", """
SELECT id, epoch_us(created_at) AS created_at FROM objects WHERE classification_status = 'needs_review'
ORDER BY objects.created_at DESC, id LIMIT 50""")
def f04(spark, d):
    o = src.objects(spark, d).filter(F.col("classification_status") == "needs_review")
    return store.newest(o, 50, "created_at").select("id", _us("created_at"))


@query("L01_list_offset", """
SELECT id, epoch_us(last_seen) AS last_seen FROM objects ORDER BY objects.last_seen DESC, id LIMIT 20 OFFSET 5""")
def l01(spark, d):
    o = src.objects(spark, d)
    return rank_slice(o, "last_seen", 5, 20, descending=True).select(
        "id", _us("last_seen"))


@query("L02_object_page", """
SELECT id, confidence, (SELECT count(*) FROM objects WHERE confidence >= 0.1) AS total,
 (SELECT ceil(count(*) / 4)::BIGINT FROM objects WHERE confidence >= 0.1) AS pages
FROM objects WHERE confidence >= 0.1 ORDER BY objects.last_seen DESC, id LIMIT 4 OFFSET 4""")
def l02(spark, d):
    return store.page(src.objects(spark, d), 2, 4, min_confidence=0.1).select(
        "id", "confidence", "total", "pages")


@query("S03_object_by_id", "SELECT id, primary_class, confidence, camera_id FROM objects WHERE id = '7'")
def s03(spark, d):
    return src.objects(spark, d).filter(F.col("id") == "7").select(
        "id", "primary_class", "confidence", "camera_id")


def _changes(spark, d):
    """A second save of the objects of one camera with a later version and lower confidence."""
    o = src.objects(spark, d).filter(F.col("camera_id") == "cam_2")
    return o.withColumn("confidence", F.col("confidence") / 2).withColumn(
        "updated_at", F.col("updated_at") + F.expr("interval 1 hour")).withColumn(
        "created_at", F.col("updated_at"))


@query("S01_upsert", """
SELECT id, CASE WHEN camera_id = 'cam_2' THEN round(confidence / 2, 6) ELSE round(confidence, 6) END AS confidence,
 epoch_us(created_at) AS created_at,
 epoch_us(updated_at) + CASE WHEN camera_id = 'cam_2' THEN 3600000000 ELSE 0 END AS updated_at FROM objects""")
def s01(spark, d):
    current = src.objects(spark, d)
    path = scratch(spark, "objects")
    buckets.create(current, path)
    buckets.save(_changes(spark, d), path)
    return buckets.read(spark, path, current).select(
        "id", F.round("confidence", 6).alias("confidence"), _us("created_at"), _us("updated_at"))


@query("S02_append_trajectory", """
SELECT object_id, count(*) AS points, round(sum(x), 4) AS sum_x FROM (
 SELECT DISTINCT object_id, "timestamp", x, y, z FROM trajectory_points) GROUP BY object_id""")
def s02(spark, d):
    t = src.trajectory_points(spark, d)
    again = t.filter(F.col("camera_id") == "cam_0")
    path = scratch(spark, "points")
    buckets.append_points(t, path)
    buckets.append_points(again, path)
    return buckets.read(spark, path, t).groupBy("object_id").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("x"), 4).alias("sum_x"))


@query("S04_delete_cascade", """
SELECT o.id, count(t.event_id) AS points FROM objects o LEFT JOIN trajectory_points t ON t.object_id = o.id
WHERE o.classification_status <> 'needs_review' GROUP BY o.id""")
def s04(spark, d):
    o = src.objects(spark, d)
    gone = o.filter(F.col("classification_status") == "needs_review").select("id")
    kept = store.delete(o, gone).select("id")
    t = store.delete(src.trajectory_points(spark, d), gone, "object_id")
    n = t.groupBy(F.col("object_id").alias("id")).agg(F.count(F.lit(1)).alias("points"))
    return kept.join(n, "id", "left").select("id", F.coalesce("points", F.lit(0)).alias("points"))


@query("S05_embedding_scan", """
SELECT vec_id, len(embedding)::INTEGER AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total
FROM embeddings WHERE embedding IS NOT NULL""")
def s05(spark, d):
    e = src.table(spark, d, "embeddings").select("vec_id", "embedding").filter(
        F.col("embedding").isNotNull())
    return e.select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate(
        F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("S09_sync_embeddings", """
SELECT o.id, v.vec_id AS synced_entry FROM objects o JOIN (
 SELECT vec_id, label, (vec_id // 2)::VARCHAR AS id FROM embeddings WHERE vec_id % 2 = 0) v USING (id)""")
def s09(spark, d):
    e = src.table(spark, d, "embeddings").filter(F.col("vec_id") % 2 == 0)
    waiting = e.select(F.floor(F.col("vec_id") / 2).cast("string").alias("id"),
                       F.col("vec_id").alias("synced_entry"))
    # The same entry may wait twice; only objects that exist are updated.
    waiting = waiting.unionByName(waiting).distinct()
    return src.objects(spark, d).select("id").join(waiting, "id")


@query("U03_pending_ids", "SELECT DISTINCT object_id FROM review_queue WHERE status = 'pending'")
def u03(spark, d):
    return src.review_queue(spark, d).filter(F.col("status") == "pending").select(
        "object_id").distinct()


@query("A01_count_by_class", "SELECT primary_class, count(*) AS n FROM objects GROUP BY 1")
def a01(spark, d):
    return src.objects(spark, d).groupBy("primary_class").agg(F.count(F.lit(1)).alias("n"))


@query("F05_decode_row", """
SELECT id, (attributes_json::JSON->>'k')::BIGINT AS k, 'detect,route,' || primary_class AS stages, 3 AS n_stages,
 last_event_id + 1 AS last_frame, points FROM objects JOIN (
 SELECT object_id AS id, count(*) AS points FROM trajectory_points GROUP BY 1) USING (id)""")
def f05(spark, d):
    o = src.objects(spark, d).withColumn("pipelines_csv", csv_text(
        F.array(F.lit("detect"), F.lit("route"), F.col("primary_class")))).withColumn(
        "frames_csv", F.concat(F.lit(","), F.col("last_event_id").cast("string"), F.lit(", "),
                               (F.col("last_event_id") + 1).cast("string"), F.lit(",")))
    stages = F.split("pipelines_csv", ",")
    n = src.trajectory_points(spark, d).groupBy(F.col("object_id").alias("id")).agg(
        F.count(F.lit(1)).alias("points"))
    return o.join(n, "id", "left").select(
        "id", F.from_json("attributes_json", "k bigint")["k"].alias("k"),
        F.array_join(stages, ",").alias("stages"), F.size(stages).alias("n_stages"),
        F.element_at(csv_longs(F.col("frames_csv")), 2).alias("last_frame"), "points")


@query("F06_update_status", """
SELECT o.id, coalesce(f.c, o.primary_class) AS primary_class, coalesce(f.s, o.classification_status) AS classification_status
FROM objects o LEFT JOIN (SELECT object_id AS id, max_by(corrected_class, feedback_id) AS c, 'confirmed' AS s
 FROM feedback WHERE NOT was_correct GROUP BY 1) f USING (id)""")
def f06(spark, d):
    fb = src.feedback(spark, d).filter(~F.col("was_correct")).groupBy(
        F.col("object_id").alias("id")).agg(
        F.max_by("corrected_class", "feedback_id").alias("primary_class"))
    ch = fb.withColumn("classification_status", F.lit("confirmed"))
    cols = ["primary_class", "classification_status"]
    return store.update_columns(src.objects(spark, d), ch, cols).select("id", *cols)


@query("F10_latest_position", """
SELECT object_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, epoch_us("timestamp") AS last_seen FROM (
 SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY "timestamp" DESC, event_id DESC) AS k
 FROM trajectory_points) WHERE k = 1""")
def f10(spark, d):
    p = store.latest_position(src.trajectory_points(spark, d))
    return p.select("object_id", *[F.round(c, 6).alias(c) for c in "xyz"], _us("last_seen"))


@query("F11_stage_completion", """
SELECT frame_id, count(*) AS stages, string_agg(stage, ',' ORDER BY first_event) AS completed,
 round(sum(ms), 4) AS processing_time_ms
FROM (SELECT frame_id, stage, min(event_id) AS first_event, sum(duration_ms) AS ms FROM stage_timings GROUP BY ALL)
GROUP BY frame_id""")
def f11(spark, d):
    once = src.stage_timings(spark, d).groupBy("frame_id", "stage").agg(
        F.min("event_id").alias("first_event"), F.sum("duration_ms").alias("ms"))
    # At most one entry per stage name, so the list is bounded by the stage names.
    done = F.array_sort(F.collect_list(F.struct("first_event", "stage")))
    return once.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("stages"),
        F.array_join(F.transform(done, lambda x: x["stage"]), ",").alias("completed"),
        F.round(F.sum("ms"), 4).alias("processing_time_ms"))


@query("J19_objects_with_trajectory", """
SELECT o.id, o.primary_class, t.event_id, round(t.x, 6) AS x FROM objects o
LEFT JOIN trajectory_points t ON t.object_id = o.id""")
def j19(spark, d):
    # Long form: one row per point, so a long-lived object is never gathered into one value.
    t = src.trajectory_points(spark, d).select(
        F.col("object_id").alias("id"), "event_id", F.round("x", 6).alias("x"))
    return src.objects(spark, d).select("id", "primary_class").join(t, "id", "left")


@query("W05_trajectory_order", """
SELECT object_id, event_id, row_number() OVER (PARTITION BY object_id ORDER BY "timestamp", event_id) AS seq
FROM trajectory_points""")
def w05(spark, d):
    t = src.trajectory_points(spark, d)
    return row_numbers(t, ["object_id"], ["timestamp", "event_id"],
                       F.floor(src.hour_of(F.col("timestamp")) / 24), "seq").select(
        "object_id", "event_id", "seq")


OBJECT_JSON = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("primary_class", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("first_seen", T.StringType()),
    T.StructField("camera_id", T.StringType())])


@query("S13_json_round_trip", """
SELECT id, primary_class, confidence, epoch_us(first_seen) AS first_seen, camera_id FROM objects""")
def s13(spark, d):
    o = src.objects(spark, d).withColumn("first_seen", iso_text(F.col("first_seen")))
    text = F.to_json(F.struct(*OBJECT_JSON.fieldNames()))
    back = o.select(F.from_json(text, OBJECT_JSON).alias("o")).select("o.*")
    return back.withColumn("first_seen", micros(from_iso(F.col("first_seen"))))


@query("X18_attribute_merge", """
SELECT id, (attributes_json::JSON->>'k') AS k, primary_class AS label, camera_id AS source FROM objects""")
def x18(spark, d):
    old = F.from_json("attributes_json", "map<string,string>")
    old = F.map_concat(old, F.create_map(F.lit("source"), F.lit("old")))
    new = F.create_map(F.lit("label"), F.col("primary_class"), F.lit("source"), F.col("camera_id"))
    # New entries win: old keys that come again are taken out before the maps are joined.
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    merged = F.from_json(F.to_json(F.map_concat(kept, new)), "map<string,string>")
    return src.objects(spark, d).select(
        "id", *[merged[k].alias(k) for k in ("k", "label", "source")])


@query("F33_human_readable", """
SELECT event_id, CASE WHEN value * 1e5 < 1024 THEN printf('%.1f B', value * 1e5)
 WHEN value * 1e5 < 1024 * 1024 THEN printf('%.1f KB', value * 1e5 / 1024)
 ELSE printf('%.1f MB', value * 1e5 / 1024 / 1024) END AS bytes_text,
 CASE WHEN value / 100 < 1 THEN printf('%.1f us', value / 100 * 1000.0::DOUBLE) ELSE printf('%.1f ms', value / 100) END AS latency_text,
 printf('%.1f', least(100.0::DOUBLE, value)) || '%' AS percent_text
 FROM (SELECT event_id, value + 0.0031::DOUBLE AS value FROM events)""")
def f33(spark, d):
    v = F.col("value") + 0.0031
    return src.table(spark, d, "events").select(
        "event_id", human_bytes(v * 1e5).alias("bytes_text"),
        human_latency(v / 100).alias("latency_text"),
        human_percent(F.least(F.lit(100.0), v)).alias("percent_text"))


@query("W13_distance_travelled", """
SELECT object_id, count(*) AS points, round(sum(step), 4) AS distance,
 round(sum(step) / max(epoch_us("timestamp") - t0) * 1e6, 8) AS mean_speed FROM (
 SELECT *, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) AS step,
 min(epoch_us("timestamp")) OVER (PARTITION BY object_id) AS t0 FROM trajectory_points
 WINDOW w AS (PARTITION BY object_id ORDER BY "timestamp", event_id)) GROUP BY object_id""")
def w13(spark, d):
    from fleetsight.operators.tracking import travel
    t = travel(src.trajectory_points(spark, d))
    return t.select("object_id", "points", F.round("distance", 4).alias("distance"),
                    F.round("mean_speed", 8).alias("mean_speed"))
