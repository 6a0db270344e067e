"""Queries that run as streams over the given tables until all their data is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.functions.scalar import micros
from fleetsight.operators import identity as idn, routing
from fleetsight.plans.core import STATUS
from fleetsight.plans.points import SOBEL
from fleetsight.plans.registry import query
from fleetsight.plans.telemetry import MODES, recommendations
from fleetsight.session import prepare, scratch
from fleetsight.sources import derive as src, store as io
from fleetsight.streaming import jobs, ordered

START_MS = 1_700_000_000_000       # time of frame 0 where the data has frame numbers only


@query("T02_windowed_metrics", """
WITH w AS (SELECT event_type, epoch_us(ts) // 86400000000 AS k, value FROM events)
SELECT event_type, k * 86400000000 AS window_start, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high
FROM w GROUP BY 1, 2""")
def t02(spark, d):
    s = jobs.open_stream(prepare(spark), d, "events")
    return jobs.run_closed(s, lambda e: jobs.windowed_metrics(e, "1 day"), "metrics").filter(
        "event_type IS NOT NULL").withColumn("mean", F.round("mean", 6))


def _feedback_stream(spark, d):
    e = jobs.open_stream(prepare(spark), d, "events")
    name = src._class_of(F.col("event_type"))
    fixed = src._corrected(F.col("event_id"), name)
    return e.select("ts", (fixed == name).alias("was_correct"))


@query("T05_rolling_accuracy_stream", """
WITH f AS (SELECT epoch_us("timestamp") AS t, was_correct FROM feedback),
e AS (SELECT t, was_correct, unnest(range(t // 3600000000 + 1, t // 3600000000 + 25)) AS h FROM f)
SELECT h * 3600000000 AS window_end, count(*) AS total_reviewed, count(*) FILTER (was_correct) AS correct,
 count(*) FILTER (was_correct) / count(*) < 0.7 AS alert FROM e GROUP BY 1""")
def t05(spark, d):
    return jobs.run_closed(_feedback_stream(spark, d), lambda f: jobs.rolling_accuracy(f.withColumn("timestamp", F.col("ts"))),
                           "accuracy")


@query("T08_sighting_sessions", """
WITH s AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), g AS (SELECT *, coalesce(t - lag(t) OVER w >= 43200000000, true) AS fresh
 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)), n AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g)
SELECT user_id, min(t) AS first_seen, count(*) AS sightings, max(value) AS best FROM n GROUP BY user_id, k""")
def t08(spark, d):
    return jobs.run_closed(jobs.open_stream(prepare(spark), d, "events"), jobs.sighting_sessions, "sessions").filter(
        "user_id IS NOT NULL")


@query("T06_decision_feedback", """
SELECT r.review_id, q.object_id, q.provisional_class AS original_class, r.human_class, q.provisional_class = r.human_class AS was_correct
FROM review_decisions r JOIN review_queue q ON q.id = r.review_id""")
def t06(spark, d):
    log = scratch(prepare(spark), "decisions")
    src.review_decisions(spark, d).write.parquet(log)
    decisions = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    fb = jobs.feedback_from_decisions(decisions, src.review_queue(spark, d))
    return jobs.run_to_end(fb, "feedback").select(
        "review_id", "object_id", "original_class", "human_class", "was_correct")


@query("T07_reprocess_idle", """
SELECT id, epoch_us(last_seen) AS last_seen FROM objects WHERE classification_status = 'provisional'
 AND epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(last_seen) >= 3600000000""")
def t07(spark, d):
    from fleetsight.functions.scalar import instant
    from fleetsight.operators.review import needs_reprocess
    idle = needs_reprocess(src.objects(spark, d), instant("2024-01-30 12:00:00"), 3600.0)
    return idle.select("id", micros(F.col("last_seen")).alias("last_seen"))


@query("T09_gallery_upkeep", f"""
SELECT classification_status, count(*) AS n, round(avg(confidence), 6) AS confidence FROM (
 SELECT round(confidence, 6) AS confidence, {STATUS} AS classification_status FROM objects) GROUP BY 1""")
def t09(spark, d):
    current = src.objects(spark, d)
    log = scratch(prepare(spark), "changes")
    stale = current.withColumn("confidence", F.lit(0.0)).withColumn(
        "updated_at", F.col("updated_at") - F.expr("interval 1 hour"))
    current.write.parquet(log)
    changes = spark.readStream.schema(current.schema).parquet(log)
    out = jobs.upkeep(changes, stale)
    return out.groupBy("classification_status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.round("confidence", 6)), 6).alias("confidence"))


@query("T01_frame_stream", """
SELECT frame_key, count(*) AS masks, count(*) FILTER (source = 'fastsam') AS fastsam FROM masks GROUP BY 1""")
def t01(spark, d):
    """Events become masks per frame."""
    e = jobs.open_stream(prepare(spark), d, "events")
    return jobs.run_complete(jobs.frame_masks(e, src.EVENTS_PER_FRAME), "frames")


def _as_stream(df, name):
    """A table written to files and opened as a stream of them."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query("T01_edge_stream", SOBEL + """
SELECT frame_key, count(*) AS edge_pixels FROM e WHERE x > 0 AND mag > 100 GROUP BY 1""")
def t01e(spark, d):
    """Depth edges of frames that arrive as files of pixels."""
    px = src.pixels(prepare(spark), d).withColumn("ts", F.timestamp_millis(START_MS + F.col("frame_key") * 67))
    px = px.select("frame_key", "ts", "v", "u", "depth_raw")
    return jobs.frame_edges(_as_stream(px, "pixels"), src.GRID_W, src.GRID_H)


@query("T03_stream_tracker")
def t03(spark, d):
    """Tracks of a stream of frames at 15 a second, camera by camera."""
    det = src.track_detections(prepare(spark), d).withColumn("ts", F.timestamp_micros(START_MS * 1000 + F.col("frame_no") * 66_667))
    return jobs.run_closed(_as_stream(det, "detections"), ordered.stream_tracks, "tracks")


CLAIMS = """SELECT mask_id, object_id, epoch_us(ts) AS t, 'claim' AS action, 0 AS step FROM masks UNION ALL
 SELECT mask_id, object_id, epoch_us(ts) + 100000 * (1 + mask_id % 7), 'update', 1 FROM masks WHERE mask_id % 2 = 0 UNION ALL
 SELECT mask_id, object_id, epoch_us(ts) + 200000 + 300000 * (mask_id % 5), 'release', 2 FROM masks WHERE mask_id % 3 = 0"""


def _quick_claims(spark, d):
    """Claims, renewals after 0.1 to 0.7 s and releases after 0.2 to 1.4 s."""
    m = src.masks(spark, d).select("mask_id", "object_id", "ts")
    at = lambda us, action, step: m.select("mask_id", "object_id", F.timestamp_micros(micros(F.col("ts")) + us).alias("ts"),
                                           F.lit(action).alias("action"), F.lit(step).cast("long").alias("step"))
    return (at(F.lit(0), "claim", 0).unionByName(at((F.col("mask_id") % 7 + 1) * 100_000, "update", 1).filter("mask_id % 2 = 0"))
            .unionByName(at(F.col("mask_id") % 5 * 300_000 + 200_000, "release", 2).filter("mask_id % 3 = 0")))


@query("T04_claim_lifetimes", f"""
WITH l AS (SELECT *, lead(t) OVER (PARTITION BY mask_id ORDER BY t, step) AS n FROM ({CLAIMS})), c AS (SELECT * FROM l WHERE action <> 'release')
SELECT mask_id, object_id, event, t + us AS at FROM c, (VALUES ('stale', 500000::BIGINT), ('expired', 1000000::BIGINT)) AS e(event, us)
WHERE n IS NULL OR n > t + us""")
def t04s(spark, d):
    """Claims that go stale after 0.5 s and expire after 1 s, by timers."""
    return jobs.run_closed(_as_stream(_quick_claims(prepare(spark), d), "claims"), ordered.claim_lifetimes, "lifetimes")


@query("T07_idle_stream", f"""
WITH s AS (SELECT user_id::VARCHAR AS id, epoch_us(ts) AS t, {STATUS} AS status,
 lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, det_id) AS n FROM base_detections)
SELECT id, t AS last_seen, t + 60000000 AS at FROM s WHERE status = 'provisional' AND (n IS NULL OR n >= t + 60000000)""")
def t07s(spark, d):
    """Provisional objects unseen for 60 s, by one timer an object."""
    seen = src.base_detections(prepare(spark), d).select(
        F.col("user_id").cast("string").alias("id"), "ts", src.status_of(F.col("confidence")).alias("status"),
        F.col("det_id").alias("tie"))
    return jobs.run_closed(_as_stream(seen, "sightings"), ordered.idle_objects, "idle")


@query("T10_mode_stream", MODES)
def t10s(spark, d):
    """Modes elected from the last ten recommendations of each camera, frame by frame."""
    f = recommendations(prepare(spark), d).select("camera_id", "frame_no", "det_id", "ts", "recommended")
    return jobs.run_closed(_as_stream(f, "recommendations"), ordered.mode_votes, "modes").select("det_id", "mode")


@query("S17_events", f"""
SELECT event, epoch_us(ts) AS timestamp, det_id FROM (SELECT unnest(CASE WHEN confidence < 0.05 THEN ['object_detected', 'review_needed', 'alert']
 WHEN confidence < 0.5 THEN ['object_detected', 'review_needed'] ELSE ['object_detected'] END) AS event, ts, det_id FROM base_detections)""")
def s17(spark, d):
    routed = routing.review_route(src.base_detections(spark, d))
    e = jobs.outgoing_events(routed)
    return e.select("event", micros(F.col("timestamp")).alias("timestamp"),
                    F.from_json("data", "det_id bigint")["det_id"].alias("det_id"))


# --- stored forms -----------------------------------------------------------------------------------

@query("S06_object_table", """
SELECT camera_id, count(*) AS n FROM objects GROUP BY 1""")
def s06(spark, d):
    path = scratch(prepare(spark), "objects")
    o = src.objects(spark, d)
    io.write_objects(o, path)
    return spark.read.parquet(path).groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"))


@query("S07_gallery_files", """
SELECT entry_id, object_id, camera_id, round(embedding[1], 4) AS e1, len(embedding)::INTEGER AS dim FROM gallery
WHERE object_id NOT IN (SELECT 'obj_' || id FROM objects WHERE classification_status = 'needs_review')""")
def s07(spark, d):
    """A gallery saved without the entries of removed objects and loaded again, entry by entry."""
    path = scratch(prepare(spark), "gallery")
    io.write_gallery(idn.remove_objects(src.gallery(spark, d), _unsure(spark, d)), path, "json")
    return io.read_gallery(spark, path, "json").select(
        "entry_id", "object_id", "camera_id", F.round(F.get("embedding", 0), 4).alias("e1"), F.size("embedding").alias("dim"))


def _unsure(spark, d):
    return src.objects(spark, d).filter(F.col("classification_status") == "needs_review").select(
        F.concat(F.lit("obj_"), F.col("id")).alias("object_id"))


@query("S08_load_with_fallback", """
WITH n AS (SELECT object_id, arg_max(embedding[1], entry_id) AS e FROM gallery GROUP BY 1),
u AS (SELECT 'obj_' || id AS object_id FROM objects WHERE classification_status = 'needs_review')
SELECT object_id, 'index' AS origin, round(embedding[1], 4) AS e1 FROM gallery WHERE object_id NOT IN (FROM u)
UNION ALL SELECT object_id, 'objects', round(e, 4) FROM n WHERE object_id IN (FROM u)""")
def s08(spark, d):
    """All entries of a stored index; objects that it does not hold come from their own newest embedding."""
    g = src.gallery(spark, d)
    o = idn.newest_embedding(g).select(F.col("object_id").alias("id"), F.col("embedding").alias("reid_embedding"))
    every = io.load_embeddings(idn.remove_objects(g, _unsure(spark, d)), o)
    return every.select("object_id", "origin", F.round(F.get("embedding", 0), 4).alias("e1"))


@query("S10_feedback_files", """
SELECT original_class, corrected_class, count(*) AS n, count(*) FILTER (was_correct) AS correct FROM feedback GROUP BY 1, 2""")
def s10(spark, d):
    path = scratch(prepare(spark), "feedback")
    io.write_feedback(src.feedback(spark, d), path)
    return io.read_feedback(spark, path).groupBy("original_class", "corrected_class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("was_correct").alias("correct"))


EXPORT = """SELECT label, count(*) AS n, count(DISTINCT image_path) AS images FROM (SELECT corrected_class AS label, image_path FROM feedback
 WHERE image_path IS NOT NULL) GROUP BY 1"""


def _export(spark, d, form):
    from fleetsight.operators.learning import to_examples
    back = io.export_training(to_examples(src.feedback(prepare(spark), d)), form)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_path").alias("images"))


@query("S11_export_json", EXPORT)
def s11(spark, d):
    return _export(spark, d, "json")


@query("S12_export_csv", EXPORT)
def s12(spark, d):
    return _export(spark, d, "csv")


@query("S14_A03_queue_files", """
SELECT status, count(*) AS n, (SELECT sum(strlen(coalesce(image_path, '')) + 1) FROM review_queue)::BIGINT AS bytes, 4::BIGINT AS old_files
FROM review_queue GROUP BY 1""")
def s14(spark, d):
    """Review counts next to the size of the stored crops (here: one line of text per queued crop in four files)."""
    path = scratch(prepare(spark), "crops")
    q = src.review_queue(spark, d)
    q.select(F.coalesce("image_path", F.lit("")).alias("value")).repartition(4).write.text(path)
    files = io.crop_inventory(spark, path)
    size = io.crop_bytes(files)
    counts = q.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    old = io.old_crops(files, F.lit("2200-01-01 00:00:00").cast("timestamp")).agg(F.count(F.lit(1)))
    return counts.withColumn("bytes", size.select("bytes").scalar()).withColumn(
        "old_files", old.scalar())


