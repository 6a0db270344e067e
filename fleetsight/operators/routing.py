"""Detections: size, attribute branch and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetsight.functions.geometry import BOX, box, box_area, iou
from fleetsight.functions.joins import checked_broadcast
from fleetsight.functions.scalar import clean_class
from fleetsight.functions.windows import latest

# Class names of the two specialised branches.
PERSON_CLASSES = ("person", "pedestrian", "human", "man", "woman", "child")
VEHICLE_CLASSES = ("car", "truck", "bus", "motorcycle", "bicycle", "vehicle", "sedan", "suv",
                   "van", "pickup", "motorbike", "bike")
# Routing and review thresholds.
MIN_ROUTING_CONFIDENCE = 0.3
MIN_PERSON_AREA, MIN_VEHICLE_AREA = 1000, 2000
CONFIRMED, REVIEW, AMBIGUOUS = 0.85, 0.5, 0.1


def class_routes(spark, custom: list[tuple[str, str]] | None = None) -> DataFrame:
    """Default class sets joined with custom ones (duplicates collapse)."""
    base = [(c, "person") for c in PERSON_CLASSES] + [(c, "vehicle") for c in VEHICLE_CLASSES]
    schema = "class_name string, branch string"
    routes = spark.createDataFrame(base, schema)
    if custom:
        routes = routes.union(spark.createDataFrame(custom, schema)).distinct()
    return routes


def with_area(det: DataFrame) -> DataFrame:
    """Box area and integer center."""
    x1, y1, x2, y2 = box()
    return det.select("*", box_area(box()).alias("area"),
                      F.floor((x1 + x2) / 2).cast("int").alias("cx"),
                      F.floor((y1 + y2) / 2).cast("int").alias("cy"))


def status_of(confidence: Column, confirmed: float = CONFIRMED, review: float = REVIEW) -> Column:
    return (F.when(confidence >= confirmed, "confirmed")
            .when(confidence >= review, "provisional").otherwise("needs_review"))


def lookup_branch(df: DataFrame, routes: DataFrame, class_col: str = "class_name",
                  name: str = "branch") -> DataFrame:
    """Branch of a class name; anything unknown is generic.  ``routes`` is broadcast only
    where its rows are few."""
    r = checked_broadcast(routes.select(F.col("class_name").alias("_route_class"),
                                        F.col("branch").alias("_route")))
    return (df.join(r, clean_class(F.col(class_col)) == F.col("_route_class"), "left")
            .withColumn(name, F.coalesce("_route", F.lit("generic")))
            .drop("_route", "_route_class"))


def route(det: DataFrame, routes: DataFrame, area: str = "area",
          min_confidence: float = MIN_ROUTING_CONFIDENCE, min_person: int = MIN_PERSON_AREA,
          min_vehicle: int = MIN_VEHICLE_AREA) -> DataFrame:
    """Attribute branch per detection with the reason; too small or too unsure is generic."""
    d = lookup_branch(det, routes, name="_class_branch")
    c, a, b = F.col("confidence"), F.col(area), F.col("_class_branch")
    unsure = c < min_confidence
    fits = ((b == "person") & (a >= min_person)) | ((b == "vehicle") & (a >= min_vehicle))
    return d.select(
        *[x for x in d.columns if x != "_class_branch"],
        F.when(~unsure & fits, b).otherwise("generic").alias("branch"),
        F.when(unsure, "confidence_below_threshold").when(fits, "class_match")
        .otherwise("default_fallback").alias("route_reason"),
        F.when(~unsure & fits, clean_class(F.col("class_name"))).alias("matched_class"))


def route_counts(routed: DataFrame) -> DataFrame:
    """Routes per branch; those below the confidence floor are not counted."""
    return (routed.filter(F.col("route_reason") != "confidence_below_threshold")
            .groupBy("branch").agg(F.count(F.lit(1)).alias("n")))


def top_margin(alternatives: DataFrame, key: str = "det_id") -> DataFrame:
    """Difference between the two most confident candidate classes per key."""
    best = latest(alternatives, [key], [F.desc("confidence"), F.asc("class_name")], 2, "_k")
    return best.groupBy(key).agg(
        F.max(F.when(F.col("_k") == 1, F.col("confidence"))).alias("top_confidence"),
        F.max(F.when(F.col("_k") == 2, F.col("confidence"))).alias("second_confidence"),
    ).withColumn("margin", F.col("top_confidence") - F.col("second_confidence"))


def review_route(df: DataFrame, margin: str | None = None) -> DataFrame:
    """Status and review reason; ambiguity is tested before everything else."""
    c = F.col("confidence")
    ambiguous = F.coalesce(F.col(margin) < AMBIGUOUS, F.lit(False)) if margin else F.lit(False)
    return df.select(
        "*", F.when(ambiguous, "needs_review").otherwise(status_of(c)).alias("status"),
        F.when(ambiguous, "ambiguous_class").when(c < REVIEW, "low_confidence").alias("reason"))


def review_priority(reason: Column, confidence: Column) -> Column:
    """Rank 4 urgent, 3 high, 2 normal, 1 low."""
    return (F.when(reason == "user_flagged", 4).when(confidence < 0.2, 3)
            .when(reason == "new_object_type", 3).when(reason == "ambiguous_class", 2)
            .otherwise(1))


def priority_name(rank: Column) -> Column:
    return (F.when(rank == 4, "urgent").when(rank == 3, "high").when(rank == 2, "normal")
            .otherwise("low"))


def recover_class(boxes: DataFrame, det: DataFrame, frame_keys: list[str],
                  threshold: float = 0.5) -> DataFrame:
    """Class of the first detection of the same frame whose box matches (IoU above threshold)."""
    from fleetsight.operators.tracking import first_overlap
    found = first_overlap(boxes, det, frame_keys, "det_idx", "class_name", threshold)
    return boxes.join(found, [*frame_keys, *BOX]).groupBy(*frame_keys, "box_id").agg(
        F.min_by("class_name", "det_idx").alias("recovered_class"))
