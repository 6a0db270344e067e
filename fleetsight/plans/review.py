"""Queries over the review queue and its feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.functions.scalar import instant, micros
from fleetsight.operators import learning, objects as store, review as rv, routing
from fleetsight.plans.core import AS_OF, STATUS
from fleetsight.plans.registry import query
from fleetsight.sources import derive as src

HEAD = "SELECT * FROM review_queue WHERE status = 'pending'"


def _us(name):
    return micros(F.col(name)).alias(name)


@query("F27_pending_reviews", f"""
SELECT id, reason, provisional_class, epoch_us(created_at) AS created_at FROM ({HEAD}) h
WHERE provisional_class = 'person' ORDER BY h.created_at, id LIMIT 50""")
def f27(spark, d):
    return rv.pending(src.review_queue(spark, d), 50, "person").select(
        "id", "reason", "provisional_class", _us("created_at"))


@query("F28_review_item", "SELECT id, object_id, reason, confidence FROM review_queue WHERE id = 3")
def f28(spark, d):
    return src.review_queue(spark, d).filter(F.col("id") == 3).select(
        "id", "object_id", "reason", "confidence")


@query("A02_review_counts", "SELECT status, count(*) AS n FROM review_queue GROUP BY status")
def a02(spark, d):
    return src.review_queue(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("A30_largest_batch", f"""
WITH h AS ({HEAD}),
best AS (SELECT provisional_class FROM h GROUP BY 1 ORDER BY count(*) DESC, min(created_at), min(id) LIMIT 1)
SELECT id, provisional_class FROM h WHERE provisional_class IN (SELECT * FROM best) ORDER BY created_at, id LIMIT 20""")
def a30(spark, d):
    return rv.batch(src.review_queue(spark, d), 20).select("id", "provisional_class")


@query("J20_apply_decisions", """
SELECT q.id, CASE WHEN r.review_id IS NOT NULL THEN 'reviewed' ELSE q.status END AS status, r.human_class, r.reviewer
FROM review_queue q LEFT JOIN review_decisions r ON r.review_id = q.id""")
def j20(spark, d):
    q = src.review_queue(spark, d)
    return rv.apply_decisions(q, src.review_decisions(spark, d)).select(
        "id", "status", "human_class", "reviewer")


RESULTS = """SELECT r.review_id, q.object_id, q.provisional_class AS original_class, r.human_class, r.reviewer,
 r.decided_at, q.provisional_class = r.human_class AS was_correct, q.confidence AS original_confidence, q.image_path
 FROM review_decisions r JOIN review_queue q ON q.id = r.review_id"""


@query("R04_review_results", f"SELECT * EXCLUDE (decided_at), epoch_us(decided_at) AS decided_at FROM ({RESULTS})")
def r04(spark, d):
    r = rv.review_results(src.review_queue(spark, d), src.review_decisions(spark, d))
    return r.withColumn("decided_at", micros(F.col("decided_at")))


@query("J20_confirmed_objects", f"""
WITH r AS ({RESULTS}), h AS (SELECT object_id AS id, arg_max(human_class, (decided_at, review_id)) AS c,
 max(decided_at) AS t FROM r GROUP BY 1)
SELECT o.id, coalesce(h.c, o.primary_class) AS primary_class,
 CASE WHEN h.id IS NULL THEN o.classification_status ELSE 'confirmed' END AS classification_status,
 epoch_us(coalesce(h.t, o.updated_at)) AS updated_at FROM objects o LEFT JOIN h USING (id)""")
def j20b(spark, d):
    r = rv.review_results(src.review_queue(spark, d), src.review_decisions(spark, d))
    return rv.confirm_objects(src.objects(spark, d), r).select(
        "id", "primary_class", "classification_status", _us("updated_at"))


@query("R01_process_objects", f"""
SELECT id, {STATUS} AS status, CASE WHEN confidence < 0.5 THEN 'low_confidence' END AS reason,
 CASE WHEN confidence < 0.2 THEN 3 WHEN confidence < 0.5 THEN 1 END AS priority FROM objects""")
def r01(spark, d):
    r = routing.review_route(src.objects(spark, d))
    p = F.when(F.col("reason").isNotNull(),
               routing.review_priority(F.col("reason"), F.col("confidence")))
    return r.select("id", "status", "reason", p.alias("priority"))


@query("R02_enqueue", f"""
SELECT sha256(id || '|low_confidence|' || '{AS_OF}') AS review_id, id AS object_id,
 to_json({{'id': id, 'primary_class': primary_class, 'confidence': confidence, 'camera_id': camera_id}})::VARCHAR AS schema_json,
 CASE WHEN confidence < 0.2 THEN 3 ELSE 1 END AS priority, 'pending' AS status FROM objects WHERE confidence < 0.5""")
def r02(spark, d):
    o = src.objects(spark, d).filter(F.col("confidence") < 0.5)
    return rv.enqueue(o, F.lit("low_confidence"), instant(AS_OF)).select(
        "review_id", "object_id", "schema_json", "priority", "status")


@query("R03_flag_by_user", f"""
SELECT sha256(id || '|user_flagged|' || '{AS_OF}') AS review_id, id AS object_id, 4 AS priority
FROM objects WHERE camera_id = 'cam_3'""")
def r03(spark, d):
    o = src.objects(spark, d).filter(F.col("camera_id") == "cam_3")
    return rv.enqueue(o, F.lit("user_flagged"), instant(AS_OF)).select(
        "review_id", "object_id", "priority")


@query("R05_skip_batch", f"""
WITH h AS ({HEAD} ORDER BY created_at, id LIMIT 60) SELECT CASE WHEN h.id IS NOT NULL THEN 'skipped' ELSE q.status END AS status, count(*) AS n
FROM review_queue q LEFT JOIN h USING (id) GROUP BY 1""")
def r05(spark, d):
    q = src.review_queue(spark, d)
    skips = rv.decide_batch(rv.pending(q, 60), "r0", instant(AS_OF), action="skip")
    return rv.apply_decisions(q, skips).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("R06_submit_batch", f"""
WITH h AS ({HEAD}),
best AS (SELECT provisional_class FROM h GROUP BY 1 ORDER BY count(*) DESC, min(created_at), min(id) LIMIT 1)
SELECT id AS review_id, provisional_class AS original_class, 'person' AS human_class,
 provisional_class = 'person' AS was_correct FROM h
WHERE provisional_class IN (SELECT * FROM best) ORDER BY created_at, id LIMIT 20""")
def r06(spark, d):
    q = src.review_queue(spark, d)
    log = rv.decide_batch(rv.batch(q, 20), "r1", instant(AS_OF), human_class="person")
    return rv.review_results(q, log).select(
        "review_id", "original_class", "human_class", "was_correct")


@query("R07_expire", f"""
SELECT CASE WHEN status = 'pending' AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at) > 86400000000
 THEN 'expired' ELSE status END AS status, count(*) AS n FROM review_queue GROUP BY 1""")
def r07(spark, d):
    return rv.expire(src.review_queue(spark, d), instant(AS_OF)).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))


@query("F29_feedback_filter", """
SELECT feedback_id, original_class, corrected_class FROM feedback
WHERE NOT was_correct AND corrected_class = 'person' AND "timestamp" >= TIMESTAMP '2024-01-15 00:00:00'""")
def f29(spark, d):
    return learning.filter_feedback(src.feedback(spark, d), instant("2024-01-15 00:00:00"), "person",
                                    True).select("feedback_id", "original_class", "corrected_class")


EXAMPLES = """SELECT feedback_id, image_path, corrected_class AS label, 1.0::DOUBLE AS confidence,
 'human_review' AS source, attributes FROM feedback WHERE image_path IS NOT NULL AND image_path <> ''"""


@query("F30_training_examples", EXAMPLES)
def f30(spark, d):
    return learning.to_examples(src.feedback(spark, d))


@query("A05_accuracy", """
SELECT count(*) AS total_reviewed, count(*) FILTER (was_correct) AS correct, count(*) FILTER (NOT was_correct) AS incorrect,
 round(count(*) FILTER (was_correct) / count(*), 6) AS accuracy FROM feedback""")
def a05(spark, d):
    return learning.overall(src.feedback(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


def _rate(col, name):
    return f"""SELECT {col} AS class_name, count(*) AS n, round(count(*) FILTER (was_correct) / count(*), 6) AS {name}
 FROM feedback GROUP BY 1"""


@query("A06_precision", _rate("original_class", "precision"))
def a06(spark, d):
    return learning.rate_by(src.feedback(spark, d), "original_class", "precision").withColumn(
        "precision", F.round("precision", 6))


@query("A07_recall", _rate("corrected_class", "recall"))
def a07(spark, d):
    return learning.rate_by(src.feedback(spark, d), "corrected_class", "recall").withColumn(
        "recall", F.round("recall", 6))


@query("A08_confusion", """
SELECT corrected_class AS actual, original_class AS predicted, count(*) AS n FROM feedback GROUP BY 1, 2""")
def a08(spark, d):
    return learning.confusion(src.feedback(spark, d))


WORST = """SELECT original_class AS class_name, count(*) FILTER (was_correct) / count(*) AS accuracy FROM feedback
 GROUP BY 1 HAVING count(*) >= 5 ORDER BY accuracy, class_name LIMIT {n}"""
CONFUSED = """SELECT corrected_class AS actual, original_class AS predicted, count(*) AS n FROM feedback
 WHERE corrected_class <> original_class GROUP BY 1, 2 ORDER BY n DESC, actual, predicted LIMIT {n}"""
RECENT = f"""SELECT count(*) AS total_reviewed, coalesce(count(*) FILTER (was_correct) / nullif(count(*), 0), 0) AS accuracy
 FROM feedback WHERE epoch_us(TIMESTAMP '{AS_OF}') - epoch_us("timestamp") BETWEEN 0 AND 86400000000"""


@query("A09_worst_classes", f"SELECT class_name, round(accuracy, 6) AS accuracy FROM ({WORST.format(n=5)})")
def a09(spark, d):
    return learning.worst_classes(src.feedback(spark, d)).withColumn(
        "accuracy", F.round("accuracy", 6))


@query("A10_most_confused", CONFUSED.format(n=5))
def a10(spark, d):
    return learning.most_confused(src.feedback(spark, d))


@query("A11_accuracy_alert", f"""
SELECT total_reviewed, round(accuracy, 6) AS accuracy, accuracy < 0.7 AS alert FROM ({RECENT})""")
def a11(spark, d):
    return learning.alert(src.feedback(spark, d), instant(AS_OF)).withColumn(
        "accuracy", F.round("accuracy", 6))


REPORT = f"""SELECT a.total_reviewed, a.correct, a.incorrect, round(a.accuracy, 6) AS accuracy,
 round(r.accuracy, 6) AS recent_accuracy, r.accuracy < 0.7 AS alert, w.class_name AS worst_class,
 c.actual AS confused_actual, c.predicted AS confused_predicted, c.n AS confused_n
 FROM (SELECT count(*) AS total_reviewed, count(*) FILTER (was_correct) AS correct,
 count(*) FILTER (NOT was_correct) AS incorrect, count(*) FILTER (was_correct) / count(*) AS accuracy FROM feedback) a,
 ({RECENT}) r, ({WORST.format(n=1)}) w, ({CONFUSED.format(n=1)}) c"""


def _report(spark, d):
    r = learning.report(src.feedback(spark, d), instant(AS_OF))
    return r.withColumn("accuracy", F.round("accuracy", 6)).withColumn(
        "recent_accuracy", F.round("recent_accuracy", 6))


@query("A12_accuracy_report", REPORT)
def a12(spark, d):
    return _report(spark, d)


@query("A13_class_distribution", f"SELECT label, count(*) AS n FROM ({EXAMPLES}) GROUP BY label")
def a13(spark, d):
    return learning.class_distribution(learning.to_examples(src.feedback(spark, d)))


@query("A14_learning_stats", f"""
SELECT r.*, (SELECT count(*) FROM feedback WHERE NOT was_correct) AS total_corrections,
 (SELECT count(DISTINCT label) FROM ({EXAMPLES})) AS classes, (SELECT max(n) FROM (
 SELECT count(*) AS n FROM ({EXAMPLES}) GROUP BY label)) AS largest_class FROM ({REPORT}) r""")
def a14(spark, d):
    fb = src.feedback(spark, d)
    dist = learning.class_distribution(learning.to_examples(fb))
    fixes = learning.filter_feedback(fb, corrections=True).agg(F.count(F.lit(1)))
    return _report(spark, d).select(
        "*", fixes.scalar().alias("total_corrections"),
        dist.agg(F.count(F.lit(1))).scalar().alias("classes"),
        dist.agg(F.max("n")).scalar().alias("largest_class"))


@query("R08_balance", f"""
WITH e AS ({EXAMPLES}),
c AS (SELECT label, count(*) AS n FROM e GROUP BY label), t AS (SELECT least(max(n), 1000) AS target FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || feedback_id), feedback_id) AS rn FROM e)
SELECT r.feedback_id, r.label, copy FROM r JOIN c USING (label), t, range(1000) AS g(copy)
WHERE c.n >= 10 AND r.rn <= least(c.n, 1000) AND copy * least(c.n, 1000) + r.rn <= target""")
def r08(spark, d):
    e = learning.to_examples(src.feedback(spark, d))
    return learning.balance(e).select("feedback_id", "label", "copy")


@query("R09_training_export", f"""
WITH e AS (SELECT x.* FROM ({EXAMPLES}) x JOIN feedback f USING (feedback_id)
 WHERE f."timestamp" >= TIMESTAMP '2024-01-10 00:00:00'),
c AS (SELECT label, count(*) AS n FROM e GROUP BY label), t AS (SELECT least(max(n), 1000) AS target FROM c)
SELECT label, target AS n FROM c, t WHERE c.n >= 10""")
def r09(spark, d):
    from fleetsight.sources import store as io
    fb = learning.filter_feedback(src.feedback(spark, d), instant("2024-01-10 00:00:00"))
    balanced = learning.balance(learning.to_examples(fb))
    back = io.export_training(balanced, "csv")
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("R10_feedback_retention", """
SELECT feedback_id, corrected_class, "timestamp" >= TIMESTAMP '2024-01-10 00:00:00' AS recent FROM feedback""")
def r10(spark, d):
    # Everything that was saved is read back; what is recent is a column, not a cut.
    fb = src.feedback(spark, d)
    return fb.select("feedback_id", "corrected_class",
                     (F.col("timestamp") >= instant("2024-01-10 00:00:00")).alias("recent"))


PRIORITY = f"""SELECT o.id, primary_class, confidence, 1.0::DOUBLE - confidence
 + CASE WHEN coalesce(s.n, 0) < {{least}} THEN 0.5 ELSE 0 END + CASE WHEN w.class_name IS NULL THEN 0 ELSE 0.3 END AS priority
 FROM {{pool}} o LEFT JOIN (SELECT corrected_class, count(*) AS n FROM feedback GROUP BY 1) s ON s.corrected_class = primary_class
 LEFT JOIN ({WORST.format(n=5)}) w ON w.class_name = primary_class"""


@query("X20_sampling_priority", f"""
SELECT id, round(priority, 6) AS priority FROM ({PRIORITY.format(pool='objects', least=1500)})""")
def x20(spark, d):
    p = learning.priorities(src.objects(spark, d), src.feedback(spark, d), 1500)
    return p.select("id", F.round("priority", 6).alias("priority"))


POOL = """(SELECT * FROM objects WHERE classification_status = 'needs_review')"""


@query("L08_R11_suggest", f"""
SELECT id, primary_class, confidence, round(priority, 6) AS priority FROM ({PRIORITY.format(pool=POOL, least=10)}) p
ORDER BY p.priority DESC, id LIMIT 20""")
def r11(spark, d):
    s = learning.suggest(src.objects(spark, d), src.feedback(spark, d), 20)
    return s.withColumn("priority", F.round("priority", 6))


@query("W07_rolling_accuracy", """
WITH s AS (SELECT epoch_us("timestamp") AS t, was_correct FROM feedback),
h AS (SELECT unnest(range((SELECT min(t) // 3600000000 FROM s), (SELECT max(t) // 3600000000 + 26 FROM s))) AS hour),
-- every hour sees the rows of the 24 hours up to it
b AS (SELECT t // 3600000000 AS k, t, was_correct FROM s)
SELECT hour, count(*) AS total_reviewed, count(*) FILTER (was_correct) AS correct,
 round(count(*) FILTER (was_correct) / count(*), 6) AS accuracy,
 count(*) FILTER (was_correct) / count(*) < 0.7 AS alert
FROM h JOIN b ON b.k BETWEEN hour - 24 AND hour AND t <= hour * 3600000000 AND t >= (hour - 24) * 3600000000
GROUP BY hour""")
def w07(spark, d):
    return learning.hourly_accuracy(src.feedback(spark, d)).withColumn(
        "accuracy", F.round("accuracy", 6))


@query("S01_R01_saved_after_review", f"""
SELECT classification_status, count(*) AS n FROM (SELECT {STATUS} AS classification_status FROM objects) GROUP BY 1""")
def r01b(spark, d):
    o = src.objects(spark, d)
    routed = routing.review_route(o).withColumn("classification_status", F.col("status")).withColumn(
        "updated_at", F.col("updated_at") + F.expr("interval 1 second"))
    return store.upsert(o, routed.select(*o.columns)).groupBy("classification_status").agg(
        F.count(F.lit(1)).alias("n"))
