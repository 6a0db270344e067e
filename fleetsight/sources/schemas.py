"""Declared schemas of the stored tables and the check applied between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Columns of the stored tables, as DDL.
OBJECTS = (
    "id string, reid_embedding array<float>, position_x double, position_y double, position_z double, "
    "bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, width_m double, height_m double, depth_m double, "
    "distance_m double, primary_class string, subclass string, confidence double, classification_status string, "
    "attributes_json string, first_seen timestamp_ntz, last_seen timestamp_ntz, camera_id string, "
    "pipelines_completed array<string>, processing_time_ms double, source_frame_ids array<bigint>, "
    "created_at timestamp_ntz, updated_at timestamp_ntz")
TRAJECTORY = "object_id string, x double, y double, z double, timestamp timestamp_ntz, camera_id string"
REVIEW_QUEUE = (
    "id long, object_id string, schema_json string, image_path string, reason string, provisional_class string, "
    "confidence double, priority int, created_at timestamp_ntz, reviewed_at timestamp_ntz, reviewer string, "
    "human_class string, human_attributes_json string, status string")
GALLERY = "entry_id long, object_id string, primary_class string, embedding array<double>, ts long, camera_id string"
FEEDBACK = (
    "feedback_id long, object_id string, original_class string, original_confidence double, corrected_class string, "
    "was_correct boolean, reviewer string, timestamp timestamp_ntz, image_path string, attributes string")
TRAINING_CSV = "image_path string, label string, confidence double, source string"
TABLES = {"objects": OBJECTS, "trajectory_points": TRAJECTORY, "review_queue": REVIEW_QUEUE,
          "gallery": GALLERY, "feedback": FEEDBACK}


def columns(declared: str) -> list[tuple[str, str]]:
    """Names and types of a declared table."""
    return [tuple(part.strip().split(" ", 1)) for part in declared.split(", ")]


def conform(df: DataFrame, declared: str) -> DataFrame:
    """The declared columns in their order and types; what ``df`` lacks is null, what it has besides stays behind."""
    return df.select(*[(F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
                       for name, kind in columns(declared)])


def require(df: DataFrame, declared: str, stage: str = "stage") -> DataFrame:
    """Fail early, before any job runs, if a stage input misses a column or has another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = []
    for name, kind in columns(declared):
        want = {"long": "bigint", "integer": "int"}.get(kind, kind)
        if have.get(name) != want and kind != "any":
            wrong.append(f"{name}: want {want}, have {have.get(name)}")
        elif name not in have:
            wrong.append(f"{name}: missing")
    if wrong:
        raise TypeError(f"{stage}: " + "; ".join(wrong))
    return df
