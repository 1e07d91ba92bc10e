"""Boxes, intervals and points as Column expressions. A box is [x1, y1, x2, y2], an interval [start, end]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = wide * high
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def iou_at(iou: Column, threshold: float) -> Column:
    return (iou >= threshold).cast("double")


def centre_inside(pred: Column, gold: Column) -> Column:
    x, y = (pred[0] + pred[2]) / 2, (pred[1] + pred[3]) / 2
    return (x.between(gold[0], gold[2]) & y.between(gold[1], gold[3])).cast("double")


def best_iou(preds: Column, golds: Column) -> Column:
    """For each predicted box the best overlap with any target box."""
    return F.transform(preds, lambda p: F.coalesce(F.array_max(F.transform(golds, lambda g: box_iou(p, g))), F.lit(0.0)))


def interval_iou(a: Column, b: Column) -> Column:
    """Overlap over the span, which is capped by the sum of both lengths."""
    both = F.greatest(F.lit(0.0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))
    union = F.least(F.greatest(a[1], b[1]) - F.least(a[0], b[0]), (a[1] - a[0]) + (b[1] - b[0]))
    return both / (union + F.lit(1e-8))


def detection_scores(preds: Column, golds: Column, threshold: float) -> tuple[Column, Column]:
    """Share of predicted intervals over the threshold with some target, and of targets with some prediction."""

    def share(xs: Column, ys: Column) -> Column:
        hits = F.size(F.filter(xs, lambda x: F.exists(ys, lambda y: interval_iou(x, y) > threshold)))
        return F.when(F.size(xs) == 0, 0.0).otherwise(hits / F.size(xs))

    return share(preds, golds), share(golds, preds)


def point_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def keypoint_similarity(pred: Column, gold: Column, decay: float = 10.0) -> Column:
    """Mean of exp(-decay * distance / sqrt(2)) over points [x, y] in the unit square; 0 if their numbers differ, or without points."""
    near = F.zip_with(pred, gold, lambda p, q: F.exp(F.lit(-decay / 2**0.5) * point_distance(p[0], p[1], q[0], q[1])))
    mean = F.aggregate(near, F.lit(0.0), lambda s, x: s + x) / F.size(gold)
    return F.when((F.size(pred) == F.size(gold)) & (F.size(gold) > 0), F.coalesce(mean, F.lit(0.0))).otherwise(0.0)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Kilometres between two places given in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
