"""The review queue: enqueue, decide, skip, expire and batch.

Decisions are an append-only log; the state of an item is the latest decision about it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetsight.functions.scalar import age_seconds
from fleetsight.operators.routing import review_priority

# The reasons an item can be queued for.
REASONS = ("low_confidence", "ambiguous_class", "new_object_type", "conflicting_attributes",
           "periodic_verification", "user_flagged", "model_uncertainty")
SNAPSHOT_SCHEMA = "k bigint"


def needs_reprocess(objects: DataFrame, as_of: Column, idle_seconds: float = 60.0) -> DataFrame:
    return objects.filter((F.col("classification_status") == "provisional")
                          & (age_seconds(F.col("last_seen"), as_of) >= idle_seconds))


def enqueue(objects: DataFrame, reason: Column, as_of: Column) -> DataFrame:
    """Queue rows for objects; the id depends only on object, reason and time."""
    snapshot = F.to_json(F.struct("id", "primary_class", "confidence", "camera_id"))
    return objects.select(
        F.sha2(F.concat_ws("|", "id", reason, as_of.cast("string")), 256).alias("review_id"),
        F.col("id").alias("object_id"), snapshot.alias("schema_json"), reason.alias("reason"),
        F.col("primary_class").alias("provisional_class"), "confidence",
        review_priority(reason, F.col("confidence")).alias("priority"),
        as_of.alias("created_at"), F.lit("pending").alias("status"))


def pending(queue: DataFrame, limit: int, class_name: str | None = None) -> DataFrame:
    """The oldest ``limit`` pending items of a class (of all classes without one).  Items whose
    snapshot is not valid JSON are passed over."""
    return _waiting(queue, class_name).orderBy("created_at", "id").limit(limit)


def _waiting(queue: DataFrame, class_name: str | None = None) -> DataFrame:
    head = queue.filter(F.col("status") == "pending").filter(
        F.from_json("schema_json", SNAPSHOT_SCHEMA).isNotNull())
    if class_name:
        head = head.filter(F.col("provisional_class") == class_name)
    return head.withColumn("reason", F.when(F.col("reason").isin(*REASONS), F.col("reason"))
                           .otherwise("low_confidence"))


def latest_decisions(log: DataFrame) -> DataFrame:
    """One row per review: the last decision taken."""
    cols = [c for c in log.columns if c != "review_id"]
    g = log.groupBy("review_id").agg(
        F.max_by(F.struct(*cols), F.struct("decided_at", "reviewer")).alias("d"))
    return g.select("review_id", *[F.col(f"d.{c}").alias(c) for c in cols])


def apply_decisions(queue: DataFrame, log: DataFrame) -> DataFrame:
    """Queue state after the decision log: reviewed or skipped, with reviewer and class."""
    d = latest_decisions(log).select(
        F.col("review_id").alias("id"), F.col("action").alias("_action"),
        F.col("human_class").alias("_human_class"), F.col("reviewer").alias("_reviewer"))
    state = F.when(F.col("_action") == "skip", "skipped").when(
        F.col("_action") == "submit", "reviewed").otherwise(F.col("status"))
    return queue.join(d, "id", "left").select(
        *[c for c in queue.columns if c != "status"], state.alias("status"),
        F.col("_human_class").alias("human_class"), F.col("_reviewer").alias("reviewer"))


def review_results(queue: DataFrame, log: DataFrame) -> DataFrame:
    """What each submitted review said and whether the first class was right."""
    d = latest_decisions(log).filter(F.col("action") == "submit")
    q = queue.select(F.col("id").alias("review_id"), "object_id",
                     F.col("provisional_class").alias("original_class"),
                     F.col("confidence").alias("original_confidence"), "image_path")
    return d.join(q, "review_id").select(
        "review_id", "object_id", "original_class", "original_confidence", "human_class",
        "reviewer", "decided_at", "image_path",
        (F.col("original_class") == F.col("human_class")).alias("was_correct"))


def confirm_objects(objects: DataFrame, results: DataFrame) -> DataFrame:
    """Objects after review: the last human class wins and the status is confirmed."""
    last = results.groupBy(F.col("object_id").alias("id")).agg(
        F.max_by(F.struct("human_class", "decided_at"),
                 F.struct("decided_at", "review_id")).alias("h"))
    j = objects.join(last, "id", "left")
    seen = F.col("h").isNotNull()
    new = {"primary_class": F.col("h.human_class"), "classification_status": F.lit("confirmed"),
           "updated_at": F.col("h.decided_at")}
    return j.select(*[F.when(seen, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
                      for c in objects.columns])


def expire(queue: DataFrame, as_of: Column, hours: float = 24.0) -> DataFrame:
    old = (F.col("status") == "pending") & (
        age_seconds(F.col("created_at"), as_of) > hours * 3600)
    return queue.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def batch(queue: DataFrame, size: int = 20) -> DataFrame:
    """The oldest ``size`` items of the class with the most pending items."""
    head = _waiting(queue)
    groups = head.groupBy("provisional_class").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("created_at", "id")).alias("_first"))
    best = groups.orderBy(F.desc("_n"), F.asc("_first")).limit(1).select("provisional_class")
    return (head.join(best, "provisional_class", "left_semi")
            .orderBy("created_at", "id").limit(size))


def decide_batch(items: DataFrame, reviewer: str, as_of: Column, human_class: str | None = None,
                 action: str = "submit") -> DataFrame:
    """Decision rows that give every item of a batch the same answer (or skip it)."""
    return items.select(F.col("id").alias("review_id"),
                        F.lit(human_class).cast("string").alias("human_class"),
                        F.lit(reviewer).alias("reviewer"), as_of.alias("decided_at"),
                        F.lit(action).alias("action"))
