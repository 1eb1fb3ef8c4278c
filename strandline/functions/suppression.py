"""Non-maximum suppression as a fold over a frame's boxes in order of score: no Python at run time.

Ties in score follow det_idx, so the result is the same however rows are partitioned. A frame's boxes form one array: the
group is a frame, whose size is bounded by the detector, not by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.geometry import iou

#: Offsets that keep classes apart in class-aware suppression: fixed values of the models' post-processing.
CLASS_OFFSET = 7680


def suppress(det: DataFrame, frame: list[str], threshold: float, class_aware: bool = False, plus: int = 0, max_keep: int | None = None) -> DataFrame:
    """frame columns, det_idx, class_id, score of the boxes that remain; a box goes if its IoU with a kept one is above `threshold`.

    Boxes without a score take no part.
    """
    shift = F.coalesce(F.col("class_id"), F.lit(0)) * CLASS_OFFSET if class_aware else F.lit(0)
    box = F.struct((-F.col("score")).alias("neg"), F.col("det_idx"), F.col("class_id"), (F.col("x") + shift).cast("double").alias("x"), (F.col("y") + shift).cast("double").alias("y"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    grouped = det.where("score is not null").groupBy(*frame).agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    at = lambda b: (b["x"], b["y"], b["w"], b["h"])

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(at(k), at(b), plus) > threshold), kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), step)
    if max_keep is not None:
        kept = F.slice(kept, 1, max_keep)
    return grouped.select(*frame, F.explode(kept).alias("b")).select(*frame, "b.det_idx", "b.class_id", (-F.col("b.neg")).alias("score"))


def covariance(w: Column, h: Column, r: Column) -> tuple[Column, Column, Column]:
    """a, b, c of the Gaussian that stands for a rotated box."""
    a, b = w * w / 12, h * h / 12
    cos, sin = F.cos(r), F.sin(r)
    return a * cos * cos + b * sin * sin, a * sin * sin + b * cos * cos, (a - b) * cos * sin


def prob_iou(p: Column, q: Column, eps: float = 1e-7) -> Column:
    """Probabilistic IoU of rotated boxes: 1 - Hellinger distance of their Gaussians. Structs of x, y, w, h, r."""
    a1, b1, c1 = covariance(p["w"], p["h"], p["r"])
    a2, b2, c2 = covariance(q["w"], q["h"], q["r"])
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    det = (a1 + a2) * (b1 + b2) - F.pow(c1 + c2, 2)
    t1 = ((a1 + a2) * dy * dy + (b1 + b2) * dx * dx) / (det + eps) * 0.25
    t2 = (c1 + c2) * (-dx) * dy / (det + eps) * 0.5
    inner = F.greatest(a1 * b1 - c1 * c1, F.lit(0.0)) * F.greatest(a2 * b2 - c2 * c2, F.lit(0.0))
    t3 = F.log(det / (F.sqrt(inner) * 4 + eps) + eps) * 0.5
    bd = F.least(F.greatest(t1 + t2 + t3, F.lit(eps)), F.lit(100.0))
    return 1 - F.sqrt(1 - F.exp(-bd) + eps)


def suppress_rotated(det: DataFrame, frame: list[str], threshold: float) -> DataFrame:
    """As `suppress` for rotated boxes (centre x, y, w, h, angle r); a box goes at a ProbIoU of `threshold` or more."""
    box = F.struct((-F.col("score")).alias("neg"), "det_idx", "class_id", *[F.col(c).cast("double").alias(c) for c in "xywhr"])
    grouped = det.where("score is not null").groupBy(*frame).agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda k, b: F.when(F.exists(k, lambda o: prob_iou(o, b) >= threshold), k).otherwise(F.concat(k, F.array(b))))
    return grouped.select(*frame, F.explode(kept).alias("b")).select(*frame, "b.det_idx", "b.class_id", (-F.col("b.neg")).alias("score"))
