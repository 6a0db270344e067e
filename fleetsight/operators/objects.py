"""The object store as snapshots plus append-only logs.

A snapshot is one row per id.  Writers append changes and compact with ``upsert``; nothing is
updated in place, so a retried task can only write the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetsight.functions.scalar import age_seconds
from fleetsight.operators.ranks import lowest, rank_slice


def upsert(current: DataFrame, changes: DataFrame, key: str = "id",
           version: str = "updated_at") -> DataFrame:
    """Newest version per id; ``created_at`` stays that of the first save."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    cols = [c for c in current.columns if c not in (key, "created_at")]
    newest = F.max_by(F.struct(*cols), F.struct(F.col(version), F.col("_new")))
    g = both.groupBy(key).agg(newest.alias("r"), F.min("created_at").alias("created_at"))
    return g.select(key, "created_at", *[F.col(f"r.{c}").alias(c) for c in cols]) \
            .select(*current.columns)


def append_trajectory(log: DataFrame, points: DataFrame) -> DataFrame:
    """Append sightings; saving an object twice does not repeat its points."""
    return log.unionByName(points).dropDuplicates(["object_id", "timestamp", "x", "y", "z"])


def delete(objects: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return objects.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti")


def newest(df: DataFrame, n: int, order: str = "last_seen", key: str = "id") -> DataFrame:
    """Top-k report: planned as take-ordered, never as a full sort."""
    return df.orderBy(F.desc(order), F.asc(key)).limit(n)


def seen_since(df: DataFrame, as_of: Column, seconds: float, camera: str | None = None) -> DataFrame:
    d = df.filter((age_seconds(F.col("last_seen"), as_of) < seconds)
                  & (F.col("last_seen") <= as_of))
    return d.filter(F.col("camera_id") == camera) if camera else d


def update_columns(objects: DataFrame, changes: DataFrame, columns: list[str],
                   key: str = "id") -> DataFrame:
    """Set columns by id; absent or null changes leave the old value."""
    c = changes.select(key, *[F.col(x).alias(f"_n_{x}") for x in columns])
    j = objects.join(c, key, "left")
    return j.select(*[F.coalesce(f"_n_{x}", x).alias(x) if x in columns else F.col(x)
                      for x in objects.columns])


def page(df: DataFrame, number: int, size: int, sort: str = "last_seen",
         classes: str | None = None, status: str | None = None,
         min_confidence: float | None = None) -> DataFrame:
    """One page of the filtered list with the total and the page count."""
    d = df
    if classes:
        d = d.filter(F.col("primary_class") == classes)
    if status:
        d = d.filter(F.col("classification_status") == status)
    if min_confidence is not None:
        d = d.filter(F.col("confidence") >= min_confidence)
    total = d.agg(F.count(F.lit(1)).alias("total"))
    rows = rank_slice(d, sort, (number - 1) * size, size, descending=True)
    return rows.withColumn("total", total.scalar()).withColumn(
        "pages", F.ceil(F.col("total") / size).cast("long"))


def latest_position(points: DataFrame) -> DataFrame:
    """Current position and last sighting per object."""
    return points.groupBy("object_id").agg(
        F.max_by(F.struct("x", "y", "z"), F.struct("timestamp", "event_id")).alias("p"),
        F.max("timestamp").alias("last_seen")).select("object_id", "p.x", "p.y", "p.z", "last_seen")


def evictable(entries: DataFrame, capacity: int, total: int | None = None, used: str = "ts",
              fraction: float = 0.1) -> DataFrame:
    """Synced entries to drop when the cache is full: least recently used first, a tenth at a time."""
    n = entries.count() if total is None else total
    if n <= capacity:
        return entries.limit(0)
    return lowest(entries.filter("synced"), used, max(1, int(capacity * fraction)), "entry_id")

