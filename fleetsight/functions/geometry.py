"""Box, pinhole-camera and plane arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BOX = ("x1", "y1", "x2", "y2")


def box(prefix: str = "", alias: str | None = None) -> tuple[Column, ...]:
    head = f"{alias}." if alias else ""
    return tuple(F.col(f"{head}{prefix}{c}") for c in BOX)


def box_area(b: tuple[Column, ...]) -> Column:
    x1, y1, x2, y2 = b
    return (x2 - x1) * (y2 - y1)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes; 0 where they do not overlap."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = (w * h).cast("double")
    union = F.greatest(box_area(a) + box_area(b) - inter, F.lit(1e-6))
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(inter / union)


def deproject(u: Column, v: Column, z: Column, fx, fy, cx, cy) -> tuple[Column, Column, Column]:
    """Pixel and depth to camera coordinates (pinhole, no lens distortion)."""
    return (u - cx) * z / fx, (v - cy) * z / fy, z


def project(x: Column, y: Column, z: Column, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Camera coordinates to a pixel, truncated toward zero."""
    return (x * fx / z + cx).cast("int"), (y * fy / z + cy).cast("int")


def plane_distance(p: tuple[Column, ...], normal: tuple[Column, ...],
                   origin: tuple[Column, ...]) -> Column:
    terms = [(pi - oi) * ni for pi, oi, ni in zip(p, origin, normal)]
    return terms[0] + terms[1] + terms[2]
