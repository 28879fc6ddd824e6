"""Box geometry and quality scores as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SAMPLING, SCORING, STATIC, Sampling, Scoring


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    """The box held in ``<prefix>x1 .. <prefix>y2``; a struct prefix ends in a dot."""
    return Box(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])


def _bands(value: Column, steps: list[tuple[float, float]], rest: float) -> Column:
    """First ``(upper, score)`` whose ``upper`` exceeds ``value``."""
    out = F
    for upper, score in steps:
        out = out.when(value < upper, F.lit(score))
    return out.otherwise(F.lit(rest))


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    return width(b) * height(b)


def degenerate(b: Box) -> Column:
    return (b.x2 <= b.x1) | (b.y2 <= b.y1)


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0


def distance(p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
    return F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))


# scores of a single box ------------------------------------------------------------


def cutoff_score(b: Box, frame_w: Column, frame_h: Column, cfg: Scoring = SCORING) -> Column:
    short = F.least(frame_w, frame_h)
    margin = F.greatest(F.lit(1), F.bround(short * cfg.margin_ratio, 0).cast("int"))
    mx = F.least(margin, F.greatest(F.lit(0), F.floor(frame_w / 2).cast("int")))
    my = F.least(margin, F.greatest(F.lit(0), F.floor(frame_h / 2).cast("int")))
    left, top = b.x1 <= mx, b.y1 <= my
    right, bottom = b.x2 >= frame_w - mx, b.y2 >= frame_h - my
    touches = left.cast("int") + right.cast("int") + top.cast("int") + bottom.cast("int")
    opposite = (left & right) | (top & bottom)
    return (
        F.when((frame_w <= 0) | (frame_h <= 0) | degenerate(b), 0.05)
        .when(touches == 0, 1.0)
        .when(touches == 1, 0.6)
        .when((touches == 2) & ~opposite, 0.3)
        .when(touches <= 3, 0.1)
        .otherwise(0.05)
    )


def area_ratio(b: Box, frame_w: Column, frame_h: Column) -> Column:
    usable = (frame_w > 0) & (frame_h > 0) & ~degenerate(b)
    return F.when(usable, area(b) / (frame_w * frame_h).cast("double")).otherwise(0.0)


def area_score(b: Box, frame_w: Column, frame_h: Column) -> Column:
    usable = (frame_w > 0) & (frame_h > 0) & ~degenerate(b)
    # fixed values
    bands = [(0.001, 0.05), (0.003, 0.2), (0.0075, 0.5), (0.015, 0.8), (0.12, 1.0), (0.20, 0.9), (0.30, 0.75),
             (0.45, 0.55)]
    return F.when(usable, _bands(area_ratio(b, frame_w, frame_h), bands, 0.35)).otherwise(0.1)


def aspect_score(b: Box) -> Column:
    ratio = F.greatest(height(b), F.lit(1.0)) / F.greatest(width(b), F.lit(1.0))
    return (
        F.when(ratio.between(1.5, 4.0), 1.0)
        .when(ratio.between(1.0, 6.0), 0.7)
        .when((ratio >= 0.5) & (ratio < 1.0), 0.4)
        .otherwise(0.2)
    )


def confidence_score(confidence: Column) -> Column:
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), (confidence - 0.25) / 0.75 * 0.7 + 0.3))


def overlap_score(overlap: Column, b: Box, boxes_in_frame: Column) -> Column:
    # fixed values
    bands = [(0.05, 1.0), (0.15, 0.8), (0.30, 0.6), (0.50, 0.4)]
    return F.when(degenerate(b), 0.2).when(boxes_in_frame <= 1, 1.0).otherwise(_bands(overlap, bands, 0.2))


def subscores(b: Box, confidence: Column, frame_w: Column, frame_h: Column, overlap: Column,
              boxes_in_frame: Column) -> Column:
    return F.struct(
        cutoff_score(b, frame_w, frame_h).alias("cut_off"),
        area_score(b, frame_w, frame_h).alias("area_ratio"),
        aspect_score(b).alias("aspect_ratio"),
        confidence_score(confidence).alias("det_conf"),
        overlap_score(overlap, b, boxes_in_frame).alias("overlap"),
    )


def visibility(scores: Column, cfg: Scoring = SCORING) -> Column:
    total = F.lit(0.0)
    for name, weight in cfg.weights.items():
        total = total + scores[name] * weight
    return F.round(total, 4)


def visibility_tag(v: Column, cfg: Scoring = SCORING) -> Column:
    return F.when(v >= cfg.good, "good").when(v >= cfg.mid, "mid").otherwise("bad")


def force_send(confidence: Column, v: Column, overlap: Column, cutoff: Column, ratio: Column,
               cfg: Sampling = SAMPLING) -> Column:
    return (
        (confidence >= cfg.force_confidence)
        & (v >= cfg.force_visibility)
        & (overlap <= cfg.force_max_overlap)
        & (cutoff >= cfg.force_min_cutoff)
        & (ratio >= cfg.force_min_area)
    )


def spatial_key(b: Box, frame_w: Column, frame_h: Column) -> Column:
    cx, cy = centre(b)
    w, h = F.greatest(width(b), F.lit(1.0)), F.greatest(height(b), F.lit(1.0))
    return F.concat_ws(
        "_",
        F.floor(cx / 64).cast("string"),
        F.floor(cy / 64).cast("string"),
        F.floor(w / F.greatest(frame_w, F.lit(1)) * 20).cast("string"),
        F.floor(h / F.greatest(frame_h, F.lit(1)) * 20).cast("string"),
    )


def touches_edge(b: Box, frame_w: Column, frame_h: Column, px: float = STATIC.edge_px) -> Column:
    return (b.x1 <= px) | (b.y1 <= px) | (b.x2 >= frame_w - px) | (b.y2 >= frame_h - px)


# conversions -----------------------------------------------------------------------


def xyxy_to_xywh(b: Box) -> list[Column]:
    cx, cy = centre(b)
    return [cx, cy, width(b), height(b)]


def xywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def xywh_to_ltwh(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    return [cx - w / 2, cy - h / 2, w, h]


def rescale(b: Box, frame_w: Column, frame_h: Column, max_dim: int) -> Box:
    """Shrink to a frame whose longer side is ``max_dim``; smaller frames stay."""
    longest = F.greatest(frame_w, frame_h)
    scale = F.when(F.lit(max_dim > 0) & (longest > max_dim), F.lit(float(max_dim)) / longest).otherwise(F.lit(1.0))
    return Box(*[c * scale for c in b])


# two boxes -------------------------------------------------------------------------


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return w * h


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    def positive(s: Box) -> Column:
        return F.greatest(F.lit(0.0), width(s)) * F.greatest(F.lit(0.0), height(s))
    union = positive(a) + positive(b) - inter
    return F.when((inter <= 0) | (union <= 0), 0.0).otherwise(inter / union)


def iou_eps(a: Box, b: Box, eps: float = 1e-7) -> Column:
    inter = intersection(a, b)
    return inter / (area(b) + area(a) - inter + eps)


def ioa(a: Box, b: Box, eps: float = 1e-7) -> Column:
    """Intersection over the area of ``b``."""
    return intersection(a, b) / (area(b) + eps)


def size(b: Box) -> Column:
    return F.greatest(width(b), height(b), F.lit(1.0))


def centre_ratio(a: Box, b: Box) -> Column:
    return distance(centre(a), centre(b)) / F.greatest(size(a), size(b))


def _ratio(p: Column, q: Column) -> Column:
    return F.greatest(p, q) / F.greatest(F.least(p, q), F.lit(1.0))


def size_ratio(a: Box, b: Box) -> Column:
    return _ratio(size(a), size(b))


def pair_area_ratio(a: Box, b: Box) -> Column:
    def solid(s: Box) -> Column:
        return F.greatest(width(s), F.lit(1.0)) * F.greatest(height(s), F.lit(1.0))
    return _ratio(solid(a), solid(b))


def bottom_ratio(a: Box, b: Box) -> Column:
    tallest = F.greatest(height(a), height(b), F.lit(1.0))
    return F.abs(a.y2 - b.y2) / tallest


def share_edge(a: Box, b: Box, px: float = STATIC.edge_px) -> Column:
    hits = [F.abs(p - q) <= px for p, q in zip(a, b)]
    return hits[0] | hits[1] | hits[2] | hits[3]


def same_box(a: Box, b: Box, eps: float = 1.0) -> Column:
    near = [F.abs(p - q) < eps for p, q in zip(a, b)]
    return near[0] & near[1] & near[2] & near[3]


def corner_distance(a: Box, b: Box) -> Column:
    total = F.lit(0.0)
    for p, q in zip(a, b):
        total = total + (p - q) * (p - q)
    return F.sqrt(total)


def banded_iou(current: Box, other: Box) -> Column:
    value = iou_eps(current, other)
    return F.when(value >= 0.5, 1.0).when(value >= 0.3, 0.7).when(value >= 0.1, 0.4).otherwise(0.2)


def continuity_score(current: Box, previous: Box, has_previous: Column) -> Column:
    return F.when(has_previous, banded_iou(current, previous)).otherwise(0.5)


def smoothness(current: Box, prev1: Box, prev2: Box, has1: Column, has2: Column) -> Column:
    """Displacement and acceleration bands relative to the box size."""
    span = F.greatest(width(current), height(current)) + 1e-7
    c0, c1, c2 = centre(current), centre(prev1), centre(prev2)
    moved = distance(c0, c1) / span
    jerk = distance((c0[0] - c1[0], c0[1] - c1[1]), (c1[0] - c2[0], c1[1] - c2[1])) / span
    move_score = _bands(moved, [(0.3, 1.0), (0.5, 0.6)], 0.3)
    jerk_score = F.when(has2, _bands(jerk, [(0.2, 1.0), (0.4, 0.6)], 0.3)).otherwise(1.0)
    return F.when(has1, move_score * 0.6 + jerk_score * 0.4).otherwise(0.5)


def blended_visibility(v_edge: Column, continuity: Column, smooth: Column, floor_ratio: float = 0.85) -> Column:
    return F.greatest(v_edge * 0.60 + continuity * 0.25 + smooth * 0.15, v_edge * floor_ratio)


def rotated_iou(x1: Column, y1: Column, w1: Column, h1: Column, t1: Column,
                x2: Column, y2: Column, w2: Column, h2: Column, t2: Column, eps: float = 1e-7) -> Column:
    """Probabilistic overlap of two rotated boxes seen as Gaussians."""
    def covariance(w: Column, h: Column, t: Column) -> tuple[Column, Column, Column]:
        a, b, c, s = w * w / 12.0, h * h / 12.0, F.cos(t), F.sin(t)
        return a * c * c + b * s * s, a * s * s + b * c * c, (a - b) * c * s

    a1, b1, c1 = covariance(w1, h1, t1)
    a2, b2, c2 = covariance(w2, h2, t2)
    a, b, c = a1 + a2, b1 + b2, c1 + c2
    dx, dy = x2 - x1, y1 - y2
    det = a * b - c * c
    spread = (a * dy * dy + b * dx * dx) / (det + eps) * 0.25 + c * dx * dy / (det + eps) * 0.5
    own = F.sqrt(F.greatest(a1 * b1 - c1 * c1, F.lit(0.0)) * F.greatest(a2 * b2 - c2 * c2, F.lit(0.0)))
    shape = F.log(det / (own * 4.0 + eps) + eps) * 0.5
    bhattacharyya = F.greatest(F.lit(eps), F.least(F.lit(100.0), spread + shape))
    return F.lit(1.0) - F.sqrt(F.lit(1.0) - F.exp(-bhattacharyya) + eps)


def fuse_score(overlap: Column, confidence: Column) -> Column:
    """Assignment cost after weighting the overlap by the detection score."""
    return F.lit(1.0) - overlap * confidence


# labels derived from scores ---------------------------------------------------------


def live_status(v: Column, overlap: Column, has_quality: Column) -> Column:
    return (
        F.when(~has_quality, "tentative").when((v < 0.45) | (overlap >= 0.35), "recovering").otherwise("confirmed")
    )


def evidence_strength(overall: Column, good_ratio: Column) -> Column:
    return F.when((overall >= 0.8) & (good_ratio >= 0.6), "high").when(overall >= 0.65, "moderate").otherwise("weak")


def snapshot_score(v: Column, overall: Column, vector_consistency: Column, overlap: Column) -> Column:
    penalty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(overlap, F.lit(0.0)))) * 0.35
    return F.round(v * 0.5 + overall * 0.3 + vector_consistency * 0.2 - penalty, 4)


def timestamp_of_ns(ns: Column) -> Column:
    return F.timestamp_micros(F.floor(ns / 1000).cast("long"))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6
