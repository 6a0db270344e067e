"""Latency, throughput, memory and load statistics over timing and metric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetsight.functions.joins import checked_broadcast
from fleetsight.functions.scalar import micros
from fleetsight.functions.windows import (last_known, latest, order_statistics, overlapped,
                                          row_numbers)

CHUNK = 4096
# Features that stay on in each processing mode.
FEATURES = ("fastsam", "depth_segmentation", "pointcloud", "pose_estimation", "face_detection",
            "plate_detection", "imagenet_classification", "reid_matching")
MODE_FEATURES = {
    "full": FEATURES,
    "balanced": ("fastsam", "depth_segmentation", "pose_estimation", "plate_detection",
                 "reid_matching"),
    "fast": ("fastsam", "reid_matching"),
    "minimal": ("fastsam",),
}
# Cost model in milliseconds and its factor per mode.
BASE_COST = (("low", 30.0), ("medium", 50.0), ("high", 80.0), ("extreme", 120.0))
MODE_FACTOR = (("full", 1.0), ("balanced", 0.7), ("fast", 0.4), ("minimal", 0.25))


def stage_stats(timings: DataFrame) -> DataFrame:
    """Count, total, extremes, mean, population deviation and nearest-rank percentiles."""
    d = F.col("duration_ms")
    basic = timings.groupBy("stage").agg(
        F.count(F.lit(1)).alias("count"), F.sum(d).alias("total_ms"), F.min(d).alias("min_ms"),
        F.max(d).alias("max_ms"), F.avg(d).alias("mean_ms"), F.stddev_pop(d).alias("std_ms"))
    ranks = {f"p{p}_ms": float(p) for p in (50, 95, 99)}
    return basic.join(order_statistics(timings, ["stage"], "duration_ms", ranks), "stage")


def last_per_key(log: DataFrame, keys: list[str], n: int) -> DataFrame:
    return latest(log, keys, [F.desc("ts"), F.desc("event_id")], n)


def latency_stats(log: DataFrame, n: int = 100) -> DataFrame:
    """Dashboard variant over the last ``n`` values: median, and tail ranks only if enough rows."""
    recent = last_per_key(log, ["stage"], n)
    v = F.array_sort(F.collect_list("duration_ms"))
    g = recent.groupBy("stage").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("duration_ms").alias("mean"),
        F.min("duration_ms").alias("min"), F.max("duration_ms").alias("max"),
        F.coalesce(F.stddev_samp("duration_ms"), F.lit(0.0)).alias("std"),
        F.median("duration_ms").alias("p50"), v.alias("_v"))
    tail = lambda q, least: F.when(
        F.col("samples") >= least,
        F.get("_v", F.floor(F.col("samples") * q).cast("int"))).otherwise(F.col("max"))
    return g.withColumn("p95", tail(0.95, 20)).withColumn("p99", tail(0.99, 100)).drop("_v")


def metric_stats(samples: DataFrame, as_of: Column, n: int = 100, seconds: float = 300) -> DataFrame:
    """Current value and spread of the last ``n`` samples not older than ``seconds``."""
    recent = last_per_key(samples.filter(F.col("ts") <= as_of), ["name"], n)
    fresh = recent.filter(micros(as_of) - micros(F.col("ts")) < F.lit(int(seconds * 1e6)))
    return fresh.groupBy("name").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("current"), F.avg("value").alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("samples"), F.first("unit").alias("unit"))


def frame_profiles(timings: DataFrame) -> DataFrame:
    return timings.groupBy("frame_id").agg(
        F.sum("duration_ms").alias("total_ms"), F.max("ts").alias("ts"),
        F.max("skipped").alias("skipped"), F.count(F.lit(1)).alias("stages"))


def recent_frames(profiles: DataFrame, n: int = 100) -> DataFrame:
    return profiles.orderBy(F.desc("frame_id")).limit(n)


def mean_times(timings: DataFrame, n: int = 100) -> DataFrame:
    """Mean per stage, and of whole frames, over the last ``n`` frames without skipped ones."""
    frames = recent_frames(frame_profiles(timings), n).filter(~F.col("skipped"))
    per_frame = frames.select(F.lit("_frame").alias("stage"), F.col("total_ms").alias("ms"))
    # A stage that occurs twice in a frame counts once, with its total.
    per_stage = (timings.join(F.broadcast(frames.select("frame_id")), "frame_id", "left_semi")
                 .groupBy("frame_id", "stage").agg(F.sum("duration_ms").alias("ms"))
                 .select("stage", "ms"))
    return per_stage.unionByName(per_frame).groupBy("stage").agg(F.avg("ms").alias("mean_ms"))


def frame_breakdown(timings: DataFrame) -> DataFrame:
    """Stage time and its share of the frame."""
    s = timings.groupBy("frame_id", "stage").agg(F.sum("duration_ms").alias("ms"))
    total = s.groupBy("frame_id").agg(F.sum("ms").alias("total_ms"))
    return s.join(total, "frame_id").withColumn(
        "percent", F.when(F.col("total_ms") > 0, F.col("ms") / F.col("total_ms") * 100)
        .otherwise(0.0))


def fps_variants(log: DataFrame, keys: list[str], n: int = 30) -> DataFrame:
    """The four meanings of frames per second over the last ``n`` frames (and all of them)."""
    recent = latest(log, keys, [F.desc("ts"), F.desc("det_id")], n)
    span = (F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6
    r = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), span.alias("span_s"))
    total = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("frame_count"), span.alias("uptime_s"))
    ok = (F.col("n") >= 2) & (F.col("span_s") > 0)
    gap = F.col("span_s") / (F.col("n") - 1)
    return r.join(total, keys).select(
        *keys, "n",
        F.when(ok, (F.col("n") - 1) / F.col("span_s")).otherwise(0.0).alias("fps_intervals"),
        F.when(ok, F.col("n") / F.col("span_s")).otherwise(0.0).alias("fps_frames"),
        F.when(ok, 1.0 / gap).otherwise(0.0).alias("fps_mean_gap"),
        F.when(F.col("uptime_s") > 0, F.col("frame_count") / F.col("uptime_s")).otherwise(0.0)
        .alias("fps_uptime"))


def complexity(objects: Column, motion: Column) -> Column:
    """Scene level from the object count, one level higher when there is much motion."""
    level = F.when(objects <= 3, 0).when(objects <= 10, 1).when(objects <= 25, 2).otherwise(3)
    bumped = F.least(F.lit(3), level + F.when(motion > 0.5, 1).otherwise(0))
    return (F.when(bumped == 0, "low").when(bumped == 1, "medium").when(bumped == 2, "high")
            .otherwise("extreme"))


def recommended_mode(fps: Column, target: float = 15.0) -> Column:
    return (F.when(fps <= 0, "balanced").when(fps >= target * 1.2, "full")
            .when(fps >= target, "balanced").when(fps >= target * 0.8, "fast")
            .otherwise("minimal"))


def mode_costs(spark) -> DataFrame:
    rows = [(c, m, b * f) for c, b in BASE_COST for m, f in MODE_FACTOR]
    return spark.createDataFrame(rows, "complexity string, mode string, cost_ms double")


def mode_features(spark) -> DataFrame:
    rows = [(m, f, f in on) for m, on in MODE_FEATURES.items() for f in FEATURES]
    return spark.createDataFrame(rows, "mode string, feature string, enabled boolean")


def rolling_fps(frames: DataFrame, key: str = "camera_id", rn: str = "frame_no",
                n: int = 30) -> DataFrame:
    """Mean of the last ``n`` gaps and processing times at every frame.

    Works on chunks of numbered frames that see the ``n`` frames before them, so one busy camera
    spreads over many tasks.
    """
    parts = overlapped(frames, rn, CHUNK, n + 1)
    seq = W.partitionBy(key, "_part").orderBy(rn)
    gap = (micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(seq)) / 1e6
    back = seq.rowsBetween(-(n - 1), 0)
    d = parts.withColumn("_gap", gap)
    d = d.withColumn("mean_gap", F.avg("_gap").over(back)).withColumn(
        "gaps", F.count("_gap").over(back)).withColumn(
        "mean_ms", F.avg("processing_ms").over(back))
    fps = F.when((F.col("gaps") >= 2) & (F.col("mean_gap") > 0), 1.0 / F.col("mean_gap"))
    return (d.filter("_own").withColumn("fps", F.coalesce(fps, F.lit(0.0)))
            .drop("_part", "_own", "_gap"))


def mode_votes(frames: DataFrame, key: str = "camera_id", rn: str = "frame_no",
               recommended: str = "recommended", n: int = 10, least_history: int = 5,
               least_votes: int = 3, start: str = "balanced") -> DataFrame:
    """Mode in force at each frame: the most common recommendation of the last ``n`` frames.

    Too short a history or too few votes keep the mode that was in force before.  Equal votes go
    to the mode that appeared first in the window.
    """
    parts = overlapped(frames, rn, CHUNK, n)
    back = W.partitionBy(key, "_part").orderBy(rn).rowsBetween(-(n - 1), 0)
    seen = F.col("_seen")
    tally = F.transform(
        F.array_distinct(seen),
        lambda m: F.struct(F.size(F.filter(seen, lambda x: x == m)).alias("votes"),
                           (-F.array_position(seen, m)).alias("early"), m.alias("mode")))
    d = (parts.withColumn("_seen", F.collect_list(recommended).over(back)).filter("_own")
         .withColumn("_best", F.array_max(tally)))
    elected = F.when((F.size(seen) >= least_history) & (F.col("_best.votes") >= least_votes),
                     F.col("_best.mode"))
    d = d.withColumn("elected", elected).drop("_part", "_own", "_seen", "_best")
    held = last_known(d, [key], rn, CHUNK, "elected", "mode")
    return held.withColumn("mode", F.coalesce("mode", F.lit(start))).drop("elected")


def skip_flags(frames: DataFrame, key: str = "camera_id", rn: str = "frame_no",
               stale_ms: float = 200.0, slow_below: float = 12.0, most: int = 2) -> DataFrame:
    """Frames a loop that is behind would skip, never more than ``most`` in a row.

    Inside a run of frames that ask to be skipped every ``most + 1``-th one is processed, which
    depends only on the position in the run; the run start is the last frame that did not ask.
    """
    asks = (F.col("age_ms") > stale_ms) | ((F.col("fps") > 0) & (F.col("fps") < slow_below))
    d = frames.withColumn("wants_skip", asks).withColumn(
        "_break", F.when(~F.col("wants_skip"), F.col(rn)))
    d = last_known(d, [key], rn, CHUNK, "_break", "_start")
    pos = F.col(rn) - F.coalesce("_start", F.lit(0))
    return d.withColumn("skipped", F.col("wants_skip") & (pos % (most + 1) != 0)).drop(
        "_break", "_start")


def peak_memory(samples: DataFrame) -> DataFrame:
    s = F.max_by(F.struct("ts", "rss_mb", "vms_mb", "percent", "available_mb"),
                 F.struct(F.col("rss_mb"), -F.col("event_id")))
    return samples.agg(s.alias("s")).select("s.*")


def memory_warnings(samples: DataFrame, threshold_mb: float) -> DataFrame:
    text = F.format_string("Memory usage (%.1fMB) exceeds threshold (%.1fMB)",
                           F.col("rss_mb"), F.lit(float(threshold_mb)))
    return samples.filter(F.col("rss_mb") > threshold_mb).withColumn("message", text)


def slow_operations(timings: DataFrame, over_ms: float = 100.0) -> DataFrame:
    return timings.filter(F.col("duration_ms") > over_ms)


def health_alerts(samples: DataFrame, limits: DataFrame) -> DataFrame:
    """Samples outside the limit of their metric; ``limits`` has one row per metric name."""
    j = samples.join(checked_broadcast(limits), "name")
    bad = F.when(F.col("direction") == "below", F.col("value") < F.col("limit_value")).otherwise(
        F.col("value") > F.col("limit_value"))
    return j.filter(bad)


