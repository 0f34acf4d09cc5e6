"""Box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITE = 1e10
#: Area ranges of COCO scoring, by name.
AREAS = {"all": (0.0, INFINITE), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, INFINITE)}


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x, y, w, h); 0 where the union is not positive."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx)) * F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def crowd_iou(det: list[Column], gt: list[Column], crowd: Column) -> Column:
    """IoU where a crowd region is matched by the share of the detection that it covers."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = det, gt
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx)) * F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = F.when(crowd == 1, aw * ah).otherwise(aw * ah + bw * bh - inter)
    return F.when(union > 0, inter / union).otherwise(zero)


def box(alias: str) -> list[Column]:
    return [F.col(f"{alias}.{c}") for c in ("x", "y", "w", "h")]


def xywh_to_norm1000(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct(x1, y1, x2, y2) in 0..1000, rounded half to even; null for a box without extent or an image without size."""

    def at(v: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(1000), F.rint(v * 1000 / size).cast("int")))

    ok = (w > 0) & (h > 0) & (width > 0) & (height > 0)
    b = F.struct(at(x, width).alias("x1"), at(y, height).alias("y1"), at(x + w, width).alias("x2"), at(y + h, height).alias("y2"))
    return F.when(ok, b).alias("norm1000")


def xywh_to_yxyx1000_trunc(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct(y1, x1, y2, x2) in thousandths, truncated."""
    return F.struct((y / height * 1000).cast("int").alias("y1"), (x / width * 1000).cast("int").alias("x1"), ((y + h) / height * 1000).cast("int").alias("y2"), ((x + w) / width * 1000).cast("int").alias("x2"))


def xywh_to_pixel_xyxy_clip(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct(x1, y1, x2, y2) in whole pixels, truncated and clipped to the image."""

    def clip(v: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least(v.cast("int"), size))

    return F.struct(clip(x, width).alias("x1"), clip(y, height).alias("y1"), clip(x + w, width).alias("x2"), clip(y + h, height).alias("y2"))


def relative_area(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations with rel_area, their share of the image."""
    i = images.select("dataset", "image_id", "width", "height")
    return annotations.join(i, ["dataset", "image_id"]).withColumn("rel_area", F.col("w") * F.col("h") / (F.col("width") * F.col("height")))


def focus_window(boxes: DataFrame, images: DataFrame, expansion: float = 1.5, min_fraction: float = 0.3) -> DataFrame:
    """(dataset, image_id, left, top, right, bottom): the hull of an image's boxes, grown and kept inside; without boxes the image."""
    hull = boxes.groupBy("dataset", "image_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    d = images.join(hull, ["dataset", "image_id"], "left")
    out = []
    for lo, hi, size, names in (("x1", "x2", "width", ("left", "right")), ("y1", "y2", "height", ("top", "bottom"))):
        span = F.least(F.greatest((F.col(hi) - F.col(lo)) * expansion, F.col(size) * min_fraction), F.col(size).cast("double"))
        begin = F.greatest(F.lit(0.0), F.least((F.col(lo) + F.col(hi)) / 2 - span / 2, F.col(size) - span))
        bare = F.col(lo).isNull()
        out += [F.when(bare, F.lit(0.0)).otherwise(begin).alias(names[0]), F.when(bare, F.col(size).cast("double")).otherwise(begin + span).alias(names[1])]
    return d.select("dataset", "image_id", *out)
