"""Stored tables in hash buckets, so that a save touches only what changed.

A table is a folder with one partition per bucket of its key.  A save works out the buckets of its changes, reads
only these (the scan is pruned by their numbers), merges, and overwrites only these.  Saves may be repeated: they keep
the newest version, so a save that was cut short between two buckets is mended by running it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsight.operators import objects

BUCKETS = 64
_PARTS = {"bucket": "integer", "day": "date"}


def bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _write(df: DataFrame, path: str, parts: list[str], mode: str, which: str = "dynamic") -> None:
    (df.repartition(*parts).write.mode(mode).option("partitionOverwriteMode", which).partitionBy(*parts).parquet(path))


def create(df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Write a table anew.  Its mark of success, which ``exists`` looks for, comes last."""
    _write(df.withColumn("bucket", bucket(key, buckets)), path, ["bucket"], "overwrite", "static")


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stored table with the columns of ``like``."""
    return _stored(spark, path, like).select(*like.columns)


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    schema = like.drop(*_PARTS).schema
    for name in ("bucket", "day") if "timestamp" in like.columns else ("bucket",):
        schema = schema.add(name, _PARTS[name])
    return spark.read.schema(schema).parquet(path)


def touched(df: DataFrame, buckets: int) -> list[int]:
    """Numbers of the buckets with rows; never more than there are buckets."""
    return sorted(r["bucket"] for r in df.select("bucket").distinct().limit(buckets).collect())


def save(changes: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS, version: str = "updated_at") -> list[int]:
    """Merge changes into a table by key; returns the buckets written."""
    spark = changes.sparkSession
    new = changes.withColumn("bucket", bucket(key, buckets))
    hit = touched(new, buckets)
    if hit:
        old = _stored(spark, path, changes).filter(F.col("bucket").isin(hit))
        merged = objects.upsert(old.select(*changes.columns), changes, key, version)
        _write(merged.withColumn("bucket", bucket(key, buckets)), path, ["bucket"], "overwrite")
    return hit


def remove(ids: DataFrame, path: str, like: DataFrame, key: str = "id", buckets: int = BUCKETS) -> list[int]:
    """Delete rows by key; the folder of a bucket that loses its last row is deleted."""
    spark = ids.sparkSession
    new = ids.select(F.col(ids.columns[0]).alias(key)).withColumn("bucket", bucket(key, buckets))
    hit = touched(new, buckets)
    if hit:
        old = _stored(spark, path, like).filter(F.col("bucket").isin(hit))
        kept = old.join(new.select(key).distinct(), key, "left_anti")
        full = touched(kept, buckets)
        _write(kept, path, ["bucket"], "overwrite")
        jvm = spark.sparkContext._jvm
        for number in set(hit) - set(full):
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={number}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return hit


_POINT = ["object_id", "timestamp", "x", "y", "z"]


def append_points(points: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append sightings to a log laid out by bucket of the object and day.  Points that are there already are
    looked for in the same buckets and days only, and only new points are written."""
    spark = points.sparkSession
    new = (points.dropDuplicates(_POINT).withColumn("bucket", bucket("object_id", buckets))
           .withColumn("day", F.to_date("timestamp")))
    if exists(spark, path):
        hit = touched(new, buckets)
        days = new.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
        if not hit:
            return
        old = _stored(spark, path, points).filter(F.col("bucket").isin(hit) & F.col("day").between(days["a"], days["b"]))
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in _POINT]
        new = new.alias("n").join(old.select("bucket", "day", *_POINT).alias("o"), [
            F.col("n.bucket") == F.col("o.bucket"), F.col("n.day") == F.col("o.day"), *same], "left_anti")
    _write(new, path, ["bucket", "day"], "append")
