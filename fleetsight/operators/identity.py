"""Galleries of identity embeddings: upkeep, matching and handoffs between cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetsight.functions.windows import latest
from fleetsight.operators.nearest import Search, search
from fleetsight.session import checkpoint

# Distance limits of the two matchers and how many embeddings an object keeps.
SAME_CAMERA, CROSS_CAMERA, KEEP = 0.3, 0.25, 10


def last_embeddings(gallery: DataFrame, n: int = KEEP) -> DataFrame:
    return latest(gallery, ["object_id"], [F.desc("ts"), F.desc("entry_id")], n)


def newest_embedding(gallery: DataFrame) -> DataFrame:
    return gallery.groupBy("object_id").agg(
        F.max_by(F.struct("entry_id", "camera_id", "embedding"), F.struct("ts", "entry_id")).alias(
            "e")).select("object_id", "e.entry_id", "e.camera_id", "e.embedding")


def mean_embedding(gallery: DataFrame) -> DataFrame:
    """Mean vector per object, scaled to unit length.

    Averages run per (object, position) with partial aggregation, so the number of embeddings of
    an object does not matter; only one value per position is gathered.
    """
    long = gallery.select("object_id", F.posexplode("embedding").alias("pos", "x"))
    avg = long.groupBy("object_id", "pos").agg(F.avg("x").alias("x"))
    size = avg.groupBy("object_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"),
                                        F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v"))
    unit = F.transform("_v", lambda e: F.when(F.col("_n") > 0, e["x"] / F.col("_n"))
                       .otherwise(e["x"]))
    return size.select("object_id", unit.alias("embedding"))


def gallery_counts(gallery: DataFrame, synced: str = "synced") -> DataFrame:
    return gallery.agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("object_id").alias("objects"),
        F.count_if(F.col(synced)).alias("synced"), F.count_if(~F.col(synced)).alias("unsynced"))


def remove_objects(gallery: DataFrame, ids: DataFrame) -> DataFrame:
    return gallery.join(ids.select("object_id").distinct(), "object_id", "left_anti")


def match_entry(queries: DataFrame, gallery: DataFrame, same: float = SAME_CAMERA,
                cross: float = CROSS_CAMERA) -> DataFrame:
    """Nearest entry (squared L2) that passes the limit for its camera, with the kind of match."""
    s = Search(k=1, metric="sq_l2", below_same=same, below_cross=cross)
    hit = search(queries, gallery, s)
    cams = queries.select("query_id", "camera_id")
    kind = F.when(F.col("gallery_camera") == F.col("camera_id"), "same_camera").otherwise(
        "cross_camera")
    return hit.join(cams, "query_id").withColumn("match_type", kind)


def with_last_camera(gallery: DataFrame) -> DataFrame:
    """Replace each entry's camera by the camera that saw its object last."""
    last = gallery.groupBy("object_id").agg(
        F.max_by("camera_id", F.struct("ts", "entry_id")).alias("_cam"))
    return gallery.join(last, "object_id").withColumn("camera_id", F.col("_cam")).drop("_cam")


def match_object(queries: DataFrame, gallery: DataFrame, k: int = 5, same: float = SAME_CAMERA,
                 cross: float = CROSS_CAMERA, keep: int = KEEP) -> DataFrame:
    """Objects by greatest cosine similarity over their kept embeddings; the limit depends on the
    camera that saw the object last."""
    recent = with_last_camera(last_embeddings(gallery, keep).drop("rn"))
    s = Search(k=k, metric="cosine", below_same=same, below_cross=cross, per="object_id")
    return search(queries, recent, s).withColumn("similarity", 1.0 - F.col("dist"))


def new_objects(queries: DataFrame, matches: DataFrame) -> DataFrame:
    return queries.join(matches.select("query_id").distinct(), "query_id", "left_anti")


def retrieve(queries: DataFrame, gallery: DataFrame, metadata: DataFrame, k: int = 5,
             overfetch: int | None = None, class_name: str | None = None) -> DataFrame:
    """Top-k hits with their metadata row.  The filter runs before the search; ``overfetch``
    gives the other form: fetch more, filter after, possibly return fewer."""
    if overfetch is None:
        g = gallery if class_name is None else gallery.filter(F.col("primary_class") == class_name)
        return search(queries, g, Search(k=k)).join(metadata, "entry_id")
    hit = search(queries, gallery, Search(k=k * overfetch)).join(metadata, "entry_id")
    if class_name is not None:
        hit = hit.filter(F.col("primary_class") == class_name)
    return latest(hit, ["query_id"], [F.asc("rank")], k, "position")


def assign_identities(queries: DataFrame, gallery: DataFrame, same: float = SAME_CAMERA,
                      cross: float = CROSS_CAMERA) -> DataFrame:
    """Known object per query, or a new one: (query_id, object_id, similarity, is_new).

    Queries are taken in id order and every new object can be found by later queries.  A query is
    new if neither the gallery nor an earlier new query matches it; rounds settle all queries whose
    earlier neighbours are settled, without ever listing the neighbours.
    """
    known = with_last_camera(last_embeddings(gallery).drop("rn"))
    limits = {"metric": "cosine", "below_same": same, "below_cross": cross}
    hit = search(queries, known, Search(k=1, per="object_id", **limits))
    open_ = checkpoint(queries.join(hit.select("query_id").distinct(), "query_id", "left_anti")
                       .select("query_id", "camera_id", "embedding"))
    entry = lambda df: df.select(
        F.col("query_id").alias("entry_id"), F.concat(F.lit("new_"), F.col("query_id").cast("string"))
        .alias("object_id"), "camera_id", "embedding")
    first = Search(k=1, earlier=True, **limits)
    seeds: list[DataFrame] = []
    while not open_.isEmpty():
        waiting = search(open_, entry(open_), first).select("query_id")
        new = checkpoint(open_.join(waiting, "query_id", "left_anti"))
        seeds.append(new)
        rest = open_.join(new.select("query_id"), "query_id", "left_anti")
        found = search(rest, entry(new), first).select("query_id")
        open_ = checkpoint(rest.join(found, "query_id", "left_anti"))
    pool = known.select((-1 - F.col("entry_id")).alias("entry_id"), "object_id", "camera_id", "embedding")
    fresh = None
    for s in seeds:
        fresh = s if fresh is None else fresh.unionByName(s)
    if fresh is not None:
        pool = pool.unionByName(entry(fresh))
    best = search(queries, pool, Search(k=1, per="object_id", earlier=True, **limits))
    out = queries.select("query_id").join(
        best.select("query_id", "object_id", (1.0 - F.col("dist")).alias("similarity")), "query_id", "left")
    if fresh is None:
        return out.withColumn("is_new", F.lit(False))
    out = out.join(fresh.select("query_id", F.lit(True).alias("_new")), "query_id", "left")
    new = F.coalesce("_new", F.lit(False))
    own = F.concat(F.lit("new_"), F.col("query_id").cast("string"))
    return out.select("query_id", F.when(new, own).otherwise(F.col("object_id")).alias("object_id"),
                      F.when(~new, F.col("similarity")).alias("similarity"), new.alias("is_new"))


def handoffs(sightings: DataFrame) -> DataFrame:
    """Sightings (with the previous one) at which an object changed its camera."""
    from fleetsight.operators.tracking import steps
    s = steps(sightings)
    return s.filter(F.col("prev_camera_id") != F.col("camera_id"))
