"""Rules over categorical labels. A label set is a map<task, struct<label, confidence>>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LABELS, UNKNOWN, Labels


def label(labels: Column, task: str) -> Column:
    return F.coalesce(labels[task]["label"], F.lit(UNKNOWN))


def confidence(labels: Column, task: str) -> Column:
    return F.coalesce(labels[task]["confidence"], F.lit(0.0))


def known(value: Column) -> Column:
    return value.isNotNull() & (value != "") & (value != UNKNOWN)


def _both_known(a: Column, b: Column, task: str) -> Column:
    return known(label(a, task)) & known(label(b, task))


def _sure(a: Column, b: Column, task: str, floor: float) -> Column:
    return (confidence(a, task) >= floor) & (confidence(b, task) >= floor)


def differs(a: Column, b: Column, task: str, floor: float) -> Column:
    return _both_known(a, b, task) & (label(a, task) != label(b, task)) & _sure(a, b, task, floor)


def agrees(a: Column, b: Column, task: str, floor: float) -> Column:
    return _both_known(a, b, task) & (label(a, task) == label(b, task)) & _sure(a, b, task, floor)


def _count(flags: Sequence[Column]) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + flag.cast("int")
    return total


def hard_conflict(a: Column, b: Column, hard: str, floor: float = LABELS.strong) -> Column:
    return differs(a, b, hard, floor)


def strong_conflict(a: Column, b: Column, hard: str, cfg: Labels = LABELS) -> Column:
    soft = _count([differs(a, b, t, cfg.strong) for t in cfg.stable])
    return differs(a, b, hard, cfg.strong) | (soft >= 2)


def opposed(a: Column, b: Column, task: str) -> Column:
    return _both_known(a, b, task) & (label(a, task) != label(b, task))


def _conflict(a: Column, b: Column, hard: str, cfg: Labels, known_: Column | None) -> Column:
    """The strong conflict, or the column that already holds it."""
    return strong_conflict(a, b, hard, cfg) if known_ is None else known_


def supports_bridge(a: Column, b: Column, hard: str, cfg: Labels = LABELS,
                    conflict: Column | None = None) -> Column:
    """Hard task agrees and two stable tasks agree, all confidently."""
    matches = _count([agrees(a, b, t, cfg.bridge) for t in cfg.stable])
    return ~_conflict(a, b, hard, cfg, conflict) & agrees(a, b, hard, cfg.bridge_hard) & (matches >= 2)


def supports_high_confidence(a: Column, b: Column, hard: str, cfg: Labels = LABELS,
                             conflict: Column | None = None) -> Column:
    matches = _count([agrees(a, b, t, cfg.high) for t in cfg.stable])
    return ~_conflict(a, b, hard, cfg, conflict) & (matches >= 2)


def supports_scale(a: Column, b: Column, hard: str, cfg: Labels = LABELS,
                   conflict: Column | None = None) -> Column:
    matches = _count([agrees(a, b, t, cfg.scale) for t in cfg.scale_stable])
    return ~_conflict(a, b, hard, cfg, conflict) & ~opposed(a, b, hard) & (matches >= 2)


def supports_clothing(a: Column, b: Column, hard: str, cfg: Labels = LABELS,
                      conflict: Column | None = None) -> Column:
    matches = _count([agrees(a, b, t, cfg.clothing) for t in cfg.stable])
    return ~_conflict(a, b, hard, cfg, conflict) & (matches >= 3)


def stable_evidence(a: Column, hard: str, cfg: Labels = LABELS) -> Column:
    out = F.lit(False)
    for task in (hard, *cfg.stable):
        out = out | (known(label(a, task)) & (confidence(a, task) >= cfg.bridge))
    return out


def allows_singleton(a: Column, b: Column, hard: str, score: Column, cfg: Labels = LABELS) -> Column:
    same = agrees(a, b, hard, cfg.singleton_hard)
    return same | (~opposed(a, b, hard) & (score >= cfg.singleton_unknown))


def conflict_ready(hard_confidence: Column, support: Column, cfg: Labels = LABELS) -> Column:
    return (hard_confidence >= cfg.ready_confidence) | (support >= cfg.ready_support)


def incompatible(t_label: Column, t_conf: Column, e_label: Column, e_conf: Column, e_support: Column,
                 floor: float = LABELS.tracklet_floor, cfg: Labels = LABELS) -> Column:
    """A tracklet's hard label rules an entity out."""
    return (
        known(t_label) & known(e_label) & (t_label != e_label) & (t_conf >= floor)
        & conflict_ready(e_conf, e_support, cfg)
    )


def mask_ambiguous(e_label: Column, e_conf: Column, t_label: Column, t_conf: Column, cfg: Labels = LABELS) -> Column:
    """The entity's hard label and confidence after a fairly sure dissent."""
    hit = (
        known(e_label) & known(t_label) & (e_label != t_label)
        & (t_conf >= cfg.mask_tracklet) & (e_conf <= cfg.mask_entity)
    )
    return F.struct(
        F.when(hit, F.lit(UNKNOWN)).otherwise(e_label).alias("label"),
        F.when(hit, F.lit(0.0)).otherwise(e_conf).alias("confidence"),
    )


def unreliable(track_id: Column, v: Column, max_overlap: Column, low_visibility: float = 0.65,
               cfg: Labels = LABELS) -> Column:
    return (track_id < 0) | (v < low_visibility) | (max_overlap >= cfg.unreliable_overlap)


# shape changes ----------------------------------------------------------------------


def to_map(rows: Column) -> Column:
    """array<struct<task, label, confidence>> to the label map."""
    return F.map_from_entries(F.transform(
        rows, lambda r: F.struct(r["task"], F.struct(r["label"].alias("label"), r["confidence"].alias("confidence")))
    ))


def labels_only(labels: Column) -> Column:
    return F.transform_values(labels, lambda _, v: v["label"])


def flatten(labels: Column, tasks: Sequence[str]) -> list[Column]:
    """``task`` and ``task_confidence`` columns."""
    out: list[Column] = []
    for task in tasks:
        out += [labels[task]["label"].alias(task), labels[task]["confidence"].alias(f"{task}_confidence")]
    return out


def unflatten(tasks: Sequence[str]) -> Column:
    """The label map from ``task`` and ``task_confidence`` columns; absent labels are left out."""
    entries = F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(t).alias("label"), F.col(f"{t}_confidence").alias("confidence"))
        for t in tasks
    ])
    return to_map(F.filter(entries, lambda r: r["label"].isNotNull()))


def compact(labels: Column, hidden: Sequence[str] = (), limit: int | None = None) -> Column:
    """Known labels by falling confidence as an array of structs."""
    rows = F.transform(F.map_entries(labels), lambda e: F.struct(
        e["key"].alias("task"), e["value"]["label"].alias("label"), e["value"]["confidence"].alias("confidence")
    ))
    rows = F.filter(rows, lambda r: known(r["label"]) & ~r["task"].isin(*hidden) if hidden else known(r["label"]))
    ranked = F.array_sort(rows, lambda p, q: F.when(p["confidence"] > q["confidence"], -1)
                          .when(p["confidence"] < q["confidence"], 1)
                          .when(p["task"] < q["task"], -1).when(p["task"] > q["task"], 1).otherwise(0))
    return ranked if limit is None else F.slice(ranked, 1, limit)
