"""Readers and writers: snapshots, logs, exports and crop files.

Every reader declares its schema.  Snapshots are written to a new path and then used in place of
the old one, so a reader never sees half a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetsight.functions.scalar import micros
from fleetsight.session import scratch
from fleetsight.sources import schemas


def write_objects(objects: DataFrame, path: str) -> None:
    """Snapshot laid out for the lookups: by camera, newest rows together inside the files."""
    # The hour spreads a busy camera's day over tasks; folders stay one per camera and day.
    (schemas.conform(objects, schemas.OBJECTS).withColumn("seen_date", F.to_date("last_seen"))
     .repartition("camera_id", "seen_date", F.hour("last_seen")).sortWithinPartitions("last_seen", "id")
     .write.mode("errorifexists").partitionBy("camera_id", "seen_date").parquet(path))


def write_gallery(gallery: DataFrame, path: str, form: str = "parquet") -> None:
    """One table; a camera's part is a partition and the whole is a plain read of the root."""
    (gallery.repartition("camera_id", "object_id")
     .write.mode("errorifexists").partitionBy("camera_id").format(form).save(path))


def read_gallery(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.GALLERY).format(form).load(path)


def load_embeddings(index: DataFrame, objects: DataFrame) -> DataFrame:
    """Entries of the index; objects that are missing there come from the object table."""
    have = index.select("object_id", "embedding", F.lit("index").alias("origin"))
    rest = objects.select(F.col("id").alias("object_id"), F.col("reid_embedding").alias("embedding"),
                          F.lit("objects").alias("origin")).filter(F.col("embedding").isNotNull())
    return have.unionByName(rest.join(have.select("object_id").distinct(), "object_id", "left_anti"))


def write_feedback(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("errorifexists").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback with defaults for fields older writers left out."""
    f = spark.read.schema(schemas.FEEDBACK).json(path)
    return f.withColumn("reviewer", F.coalesce("reviewer", F.lit("unknown"))).withColumn(
        "was_correct", F.coalesce("was_correct", F.col("original_class") == F.col("corrected_class")))


def export_training(examples: DataFrame, form: str, path: str | None = None) -> DataFrame:
    """Write training examples as CSV (four columns) or JSON and read them back."""
    spark = examples.sparkSession
    path = path or scratch(spark, f"training-{form}")
    cols = ["image_path", "label", "confidence", "source"]
    if form == "csv":
        examples.select(*cols).write.mode("errorifexists").option("header", True).csv(path)
        return spark.read.schema(schemas.TRAINING_CSV).option("header", True).csv(path)
    extra = [c for c in ("attributes", "embedding") if c in examples.columns]
    out = examples.select(*cols, *extra)
    out.write.mode("errorifexists").json(path)
    return spark.read.schema(out.schema).json(path)


def crop_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files of the crop store without their content."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length", "modificationTime"))


def crop_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"),
                     F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def old_crops(files: DataFrame, as_of: Column, hours: float = 48.0) -> DataFrame:
    """Delete list: files last changed more than ``hours`` before ``as_of``."""
    age = micros(as_of) - micros(F.col("modificationTime"))
    return files.filter(age > F.lit(int(hours * 3_600_000_000)))
