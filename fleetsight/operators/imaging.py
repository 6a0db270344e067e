"""Value, range and grid conversions on pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetsight.functions import color


def convert_color(pixels: DataFrame, source: str, target: str) -> DataFrame:
    """BGR or RGB channels (columns named by letter) to another space."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    if {source, target} == {"BGR", "RGB"} or source == target:
        return pixels
    if target == "GRAY":
        return pixels.withColumn("gray", color.gray(b, g, r))
    if source == "GRAY":
        return pixels.withColumns({c: F.col("gray") for c in "bgr"})
    if target == "LAB":
        l, a, bb = color.lab(b, g, r)
        return pixels.withColumns({"lab_l": l, "lab_a": a, "lab_b": bb})
    raise ValueError(f"no conversion from {source} to {target}")


def to_float(x: Column) -> Column:
    return x / 255.0


def to_byte(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 255.0)).cast("int")


def map_range(x: Column, source: tuple[float, float], target: tuple[float, float]) -> Column:
    (a, b), (c, d) = source, target
    return (x - a) / (b - a) * (d - c) + c


def depth_byte(depth_m: Column, low: float, high: float) -> Column:
    """Depth scaled to 0-255 for display; no depth is 0."""
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), depth_m))
    return F.when(depth_m < 0.1, 0).otherwise(((clipped - low) / (high - low) * 255).cast("int"))


def mask_image(mask_pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """0 / 255 image over each mask's box."""
    grid = (boxes.withColumn("v", F.explode(F.expr("sequence(y1, y2 - 1)")))
            .withColumn("u", F.explode(F.expr("sequence(x1, x2 - 1)")))
            .select("frame_key", "mask_id", "v", "u"))
    on = mask_pixels.withColumn("value", F.lit(255))
    return grid.join(on, ["frame_key", "mask_id", "v", "u"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0)))


def resize(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int], channel: str = "g") -> DataFrame:
    """Bilinear resampling of a (width, height) grid: every source pixel is sent to the target pixels
    it has a weight in, and the weights add up there."""
    (w, h), (tw, th) = size, target

    def reach(axis: str, n: int, tn: int) -> tuple[Column, Column]:
        scale = n / tn
        first = F.greatest(F.lit(0), F.ceil((F.col(axis) - 1 + 0.5) / scale - 0.5).cast("int"))
        last = F.least(F.lit(tn - 1), F.floor((F.col(axis) + 1 + 0.5) / scale - 0.5).cast("int"))
        lo = F.when(F.col(axis) == 0, 0).otherwise(first)
        hi = F.when(F.col(axis) == n - 1, tn - 1).otherwise(last)
        return lo, hi

    def weight(axis: str, at: str, n: int, tn: int) -> Column:
        x = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col(at) + 0.5) * (n / tn) - 0.5))
        return F.greatest(F.lit(0.0), 1.0 - F.abs(x - F.col(axis)))

    ulo, uhi = reach("u", w, tw)
    vlo, vhi = reach("v", h, th)
    sent = pixels.withColumn("_ulo", ulo).withColumn("_uhi", uhi).withColumn("_vlo", vlo).withColumn(
        "_vhi", vhi).filter("_ulo <= _uhi AND _vlo <= _vhi")
    sent = sent.withColumn("tu", F.explode(F.sequence("_ulo", "_uhi"))).withColumn(
        "tv", F.explode(F.sequence("_vlo", "_vhi")))
    part = F.col(channel) * weight("u", "tu", w, tw) * weight("v", "tv", h, th)
    return sent.groupBy("frame_key", F.col("tv").alias("v"), F.col("tu").alias("u")).agg(
        F.sum(part).alias(channel))


def window_median(places: DataFrame, pixels: DataFrame, size: int = 3) -> DataFrame:
    """Median valid depth in the ``size`` x ``size`` window around each place (0 where there is none)."""
    half = size // 2
    offs = F.sequence(F.lit(-half), F.lit(half))
    at = places.withColumn("_dv", F.explode(offs)).withColumn("_du", F.explode(offs)).select(
        "frame_key", "mask_id", (F.col("v") + F.col("_dv")).alias("v"), (F.col("u") + F.col("_du")).alias("u"))
    j = at.join(pixels.select("frame_key", "v", "u", "depth_raw"), ["frame_key", "v", "u"], "left")
    valid = F.when(F.col("depth_raw") > 0, F.col("depth_raw"))
    return j.groupBy("frame_key", "mask_id").agg(
        F.coalesce(F.median(valid) / 1000, F.lit(0.0)).alias("depth_m"))


def unletterbox(c: Column, pad: float, scale: float, size: int) -> Column:
    """Coordinate of the padded model input back to the image, clamped to it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float(size)), (c - pad) / scale))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def center_size(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1
