"""Finding and merging duplicate entities.

One pass: candidates by vector, features of each candidate pair, a bridge
reason from geometry, guards, one merge per entity, tables rewritten. Passes
repeat until nothing merges. Within a pass every pair sees the tables as they
were when it began.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MERGING as M
from ..functions import geometry as g
from ..functions import labels as lb
from ..lineage import cut
from ..operators import gallery, quality, similarity, temporal, tracks, votes

# fixed values
LIMITS = (4, 60, 120, 180, 240)
LOW_SCORE_BRIDGES = ("reentry_bridge", "supported_spatial_reentry", "occlusion_spatial_rejoin", "clothing_supported_reentry",
                     "spatial_only_weak_fragment", "spatial_continuation", "scale_aware_reentry")
HARD_GEOMETRY = ("duplicate_box", "boundary_duplicate_box", "same_frame_established_duplicate", "overlap_spatial_duplicate",
                 "trajectory_reentry", "ultra_continuity", "tight_spatial_reentry", "adjacent_tight_continuation",
                 "boundary_weak_continuation", "scale_aware_reentry")
DUPLICATE_BRIDGES = ("duplicate_box", "boundary_duplicate_box", "overlap_spatial_duplicate")
OVERRIDING_BRIDGES = DUPLICATE_BRIDGES + ("same_frame_established_duplicate", "trajectory_reentry", "scale_aware_reentry")
FINAL_REJECTS = ("no_support", "no_survivor")
MARGIN_REACH = 0.18
#: tracklets that the smaller entity of a bridged pair has at most
BRIDGE_MOST = 8


class Tables(NamedTuple):
    """What a merge touches. ``label_rows``: one row per sighting and task."""

    tracklets: DataFrame
    label_rows: DataFrame
    gallery: DataFrame
    hard_task: str
    descriptors: DataFrame | None = None


# features of unordered pairs ------------------------------------------------------------------


def label_map(voted: DataFrame) -> DataFrame:
    """One entry per task, so each list is as short as the task list."""
    rows = F.collect_list(F.struct("task", "label", "confidence"))
    return voted.groupBy("entity_id").agg(lb.to_map(rows).alias("labels"))


def evidence_counts(tracklets: DataFrame) -> DataFrame:
    firm = (F.col("state") != "occlusion_attached") & ~F.coalesce("provisional", F.lit(False))
    if "provisional" not in tracklets.columns:
        firm = F.col("state") != "occlusion_attached"
    return tracklets.groupBy("entity_id").agg(F.count(F.lit(1)).alias("tracklets"), F.count_if(firm).alias("canonical"))


def pair_features(pairs: DataFrame, t: Tables) -> DataFrame:
    """Everything the rules read about (entity_a, entity_b)."""
    pairs = pairs.select("entity_a", "entity_b").distinct()
    gaps = cut(temporal.min_gaps(pairs, t.tracklets))
    near = temporal.nearest_transition(gaps, t.tracklets)
    close = temporal.closest_transitions(pairs, t.tracklets, LIMITS)
    reentry = temporal.close_for_reentry(pairs, t.tracklets, near)
    devices = temporal.device_counts(pairs, t.tracklets)
    counts, labels = evidence_counts(t.tracklets), label_map(votes.entity_vote(t.label_rows))
    hard = t.label_rows.where(F.col("task") == t.hard_task)
    firm = votes.committed(hard, ["entity_id"], ["started_at"])
    split = votes.committed_disagreement(pairs, firm).select("entity_a", "entity_b", F.lit(True).alias("disagree"))

    on = ["entity_a", "entity_b"]
    out = pairs.join(near, on, "left").join(close, on, "left").join(reentry, on, "left").join(devices, on, "left").join(split, on, "left")
    for s in "ab":
        c = counts.select(F.col("entity_id").alias(f"entity_{s}"), F.col("tracklets").alias(f"n_{s}"), F.col("canonical").alias(f"firm_{s}"))
        m = labels.select(F.col("entity_id").alias(f"entity_{s}"), F.col("labels").alias(f"labels_{s}"))
        out = out.join(c, f"entity_{s}", "left").join(m, f"entity_{s}", "left")
    if t.descriptors is not None:
        out = out.join(descriptor_conflicts(pairs, t.descriptors), on, "left")
    else:
        out = out.withColumn("descriptor_conflict", F.lit(False))
    zeros = {c: 0 for c in ("n_a", "n_b", "firm_a", "firm_b", "devices")}
    out = out.na.fill(zeros).na.fill({"disagree": False, "close": False, "descriptor_conflict": False})
    # rules read each of these many times: they are worked out once and stored
    return cut(_measured(cut(_labelled(out, t.hard_task))))


def _labelled(rows: DataFrame, hard: str) -> DataFrame:
    a, b = F.col("labels_a"), F.col("labels_b")
    rows = rows.select("*", lb.strong_conflict(a, b, hard).alias("opposed"))
    held = {"conflict": F.col("opposed")}
    return rows.select(
        "*", lb.opposed(a, b, hard).alias("hard_opposed"), lb.supports_bridge(a, b, hard, **held).alias("bridge"),
        lb.supports_high_confidence(a, b, hard, **held).alias("high"), lb.supports_scale(a, b, hard, **held).alias("scaled"),
        lb.supports_clothing(a, b, hard, **held).alias("clothing"), lb.agrees(a, b, hard, lb.LABELS.singleton_hard).alias("hard_same"),
        (lb.stable_evidence(a, hard) & lb.stable_evidence(b, hard)).alias("both_stable"))


def _measured(rows: DataFrame) -> DataFrame:
    a, b = g.box("box_a."), g.box("box_b.")
    cols = [g.centre_ratio(a, b).alias("c"), g.size_ratio(a, b).alias("s"), g.pair_area_ratio(a, b).alias("r"),
            g.iou(a, b).alias("iou"), g.bottom_ratio(a, b).alias("bottom"), g.share_edge(a, b).alias("edge")]
    for limit in LIMITS:
        p, q = g.box(f"within_{limit}.box_a."), g.box(f"within_{limit}.box_b.")
        cols += [F.col(f"within_{limit}.centre").alias(f"c_{limit}"), F.col(f"within_{limit}.gap").alias(f"gap_{limit}"),
                 g.size_ratio(p, q).alias(f"s_{limit}"), g.pair_area_ratio(p, q).alias(f"r_{limit}"),
                 g.bottom_ratio(p, q).alias(f"bottom_{limit}")]
    return rows.select("*", *cols)


def descriptor_conflicts(pairs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Pairs whose descriptors disagree on some device both were seen by."""
    from ..operators import aggregation

    a = pairs.join(descriptors.withColumnRenamed("entity_id", "entity_a"), "entity_a").select(
        "entity_a", "entity_b", "device_id", "descriptor")
    b = descriptors.withColumnRenamed("entity_id", "entity_b")
    hit = aggregation.descriptor_conflicts(a, b, ["entity_b", "device_id"])
    return hit.select("entity_a", "entity_b").distinct().withColumn("descriptor_conflict", F.lit(True))


# bridge reason ----------------------------------------------------------------------------------


def bridge_reason(optional: bool = False) -> Column:
    """First geometric reason why a pair may be one entity, or null.

    Reads ``score`` and the pair features. A pair with a positive gap never
    co-occurs, so the rules that ask for both state the gap only. ``optional``
    adds the three rules that are off by default.
    """
    score, gap = F.col("score"), F.col("gap")
    few, many = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    c, s, r, iou, bottom = (F.col(n) for n in ("c", "s", "r", "iou", "bottom"))
    bridge, opposed = F.col("bridge"), F.col("opposed")

    def near(limit: int, centre: float, size: float, area: float) -> Column:
        return (F.col(f"c_{limit}") <= centre) & (F.col(f"s_{limit}") <= size) & (F.col(f"r_{limit}") <= area)

    # fixed values
    rules: list[tuple[str, Column, bool]] = [
        ("duplicate_box", (gap == 0) & (few <= 2) & ((few <= 1) | (score >= 0.78)) & ((iou >= 0.75) | (c <= 0.09)), True),
        ("boundary_duplicate_box", (gap == 0) & (few <= 2) & (score >= 0.68) & (iou >= 0.10) & (c <= 0.45) & F.col("edge"), True),
        ("overlap_spatial_duplicate", (score >= 0.78) & (many <= 24) & near(4, 0.08, 1.25, 1.60), True),
        ("trajectory_reentry", (score >= 0.60) & (many <= 24) & near(240, 0.06, 1.30, 2.00), True),
        ("same_frame_established_duplicate",
         (gap == 0) & (score >= 0.50) & (iou >= 0.75) & (c <= 0.05) & (s <= 1.15) & (r <= 1.25) & bridge, True),
        ("appearance_continuity", (gap <= 15) & (score >= 0.70) & (c <= 0.15), True),
        ("ultra_continuity", gap.between(1, 6) & (few <= 2) & (many <= 8) & (c <= 0.12) & (score >= 0.50), True),
        ("tight_spatial_reentry",
         gap.between(1, 6) & (few <= 2) & (c <= 0.12) & (score >= 0.50) & (s <= 1.15) & (r <= 1.25) & bridge, True),
        ("supported_spatial_reentry",
         gap.between(24, 90) & (many <= 8) & (score >= 0.53) & (c <= 0.18) & (s <= 1.20) & (r <= 1.80) & bridge, True),
        ("reentry_bridge", gap.between(30, 180) & ((many <= 4) | ((few <= 4) & (many <= 8))) & (score >= 0.535) & (c <= 0.85) & bridge, True),
        ("high_conf_reentry_bridge",
         gap.between(30, 120) & (many <= 8) & (score >= 0.86) & F.col("gap_120").between(30, 120) & near(120, 0.35, 1.70, 2.80)
         & F.col("high"), True),
        ("scale_aware_reentry",
         gap.between(1, 240) & (many <= 8) & (score >= 0.55) & near(240, 1.30, 2.20, 4.00) & (F.col("bottom_240") <= 0.08)
         & F.col("scaled"), True),
        ("clothing_supported_reentry",
         gap.between(30, 240) & (few <= 2) & (many <= 8) & (score >= 0.515) & F.col("clothing"), optional),
        ("occlusion_spatial_rejoin",
         (gap > 0) & (score >= 0.53) & (((score >= 0.59) & near(180, 0.42, 1.55, 2.10)) | near(180, 0.50, 1.10, 2.00)) & ~opposed, optional),
        ("spatial_only_weak_fragment",
         gap.between(1, 15) & (few <= 2) & (score >= F.when(few > 1, 0.60).otherwise(0.50)) & (c <= 0.30), True),
        ("adjacent_tight_continuation",
         gap.between(1, 4) & (many <= 8) & (score >= 0.50) & (c <= 0.06) & (s <= 1.10) & (r <= 1.15) & ~opposed
         & (~F.col("both_stable") | bridge), True),
        ("boundary_weak_continuation",
         gap.between(1, 12) & (many <= 8) & (score >= 0.50) & c.between(0.10, 0.32) & (s <= 1.80) & (r <= 2.30) & (bottom <= 0.06)
         & ~opposed & ((few <= 2) | bridge), True),
        ("singleton_spatial_continuation",
         gap.between(1, 15) & (few <= 1) & (score >= 0.30) & (c <= 0.30) & (s <= 1.80) & (r <= 2.20), True),
        ("spatial_continuation", (gap > 0) & (few <= 2) & (score >= 0.20) & (F.col("c_60") <= 0.30), optional),
    ]
    usable = (few <= BRIDGE_MOST) & gap.isNotNull() & F.col("box_a").isNotNull() & F.col("box_b").isNotNull()
    out = F
    for name, rule, on in rules:
        if on:
            out = out.when(usable & rule, F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def may_bridge(optional: bool = False) -> Column:
    """What every rule of ``bridge_reason`` asks of ``score`` and of the numbers of tracklets ``n_a`` and ``n_b``: without it there is no reason."""
    score, few = F.col("score"), F.least("n_a", "n_b")
    low = (few <= 1) | ((few <= 2) & (score >= 0.20)) if optional else few <= 1
    return (few <= BRIDGE_MOST) & (low | (score >= 0.50))


# decision -----------------------------------------------------------------------------------------


def decide(rows: DataFrame) -> DataFrame:
    """Rows of (entity_id, other_id, score, runner_up, pair features, reason) to a
    merge or the first guard that stops it."""
    a_is_own = F.col("entity_id") == F.col("entity_a")
    rows = rows.select(
        "*", F.when(a_is_own, F.col("n_a")).otherwise(F.col("n_b")).alias("own_n"),
        F.when(a_is_own, F.col("n_b")).otherwise(F.col("n_a")).alias("other_n"),
        F.coalesce(F.col("score") - F.col("runner_up"), F.lit(float("inf"))).alias("margin"))
    score, margin, gap = F.col("score"), F.col("margin"), F.coalesce("gap", F.lit(-1))
    own, other = F.col("own_n"), F.col("other_n")
    few, many = F.least(own, other), F.greatest(own, other)
    single, weak_pair = few <= 1, (own <= M.weak) & (other <= M.weak)
    reason = F.coalesce("reason", F.lit(""))
    bridged = reason != ""

    def among(names: tuple[str, ...]) -> Column:
        return reason.isin(*names)

    cross = (score >= M.cross_score) & (margin >= M.cross_margin) & (many <= M.cross_max) & (F.col("devices") >= 2)
    scale_weak = (reason == "scale_aware_reentry") & (few <= M.weak) & (many <= 8)
    clear = (score >= 0.73) & (margin >= M.bridge_margin)
    below = score < M.min_score
    same_hard = below & single & (score >= 0.80) & (many >= M.singleton_support)
    supported = single & (score >= M.singleton_score) & (many >= M.singleton_support)
    temporal_ = below & (score >= 0.85) & (few <= M.weak) & gap.between(1, 15)
    adjacent = below & ~temporal_ & single & (score >= 0.70) & gap.between(1, 3)
    reentry = below & ~temporal_ & ~adjacent & single & (score >= 0.58) & gap.between(1, 180) & F.col("close")
    unsupported = below & ~(temporal_ | adjacent | reentry | same_hard | bridged | supported | cross) & (
        ~single | (score < M.singleton_score) | (margin < M.margin))

    own_id, other_id = F.col("entity_id"), F.col("other_id")
    bigger_stays = bridged | (score >= M.established) | cross
    source = (
        F.when(weak_pair, F.greatest(own_id, other_id)).when(own <= M.weak, own_id).when(other <= M.weak, other_id)
        .when(bigger_stays & (other <= own), other_id).when(bigger_stays, own_id))
    rows = rows.withColumn("source_id", source).withColumn(
        "target_id", F.when(F.col("source_id") == own_id, other_id).when(F.col("source_id") == other_id, own_id))
    own_goes = F.col("source_id") == own_id
    source_n, target_n = F.when(own_goes, own).otherwise(other), F.when(own_goes, other).otherwise(own)
    strong = (score >= 0.89) & (margin >= 0.18)
    guarded = (source_n <= M.weak) & (target_n >= 5) & ~among(HARD_GEOMETRY) & (
        ((target_n > 8) & ~strong) | (score < 0.78) | (margin < 0.08))
    met = gap == 0
    rescued = among(DUPLICATE_BRIDGES) | (~met & (score >= 0.70) & weak_pair)
    overrides = among(OVERRIDING_BRIDGES)
    certain = (score >= M.cooccur_override) & ~temporal_ & ~adjacent & ~reentry
    rejected = (
        F.when(among(LOW_SCORE_BRIDGES) & (F.col("firm_a") > 0) & (F.col("firm_b") > 0) & (score < M.established) & ~scale_weak & ~clear,
               "low_score_bridge")
        .when((reason == "reentry_bridge") & (many > 4) & ((score < 0.70) | (margin < 0.12)), "weak_reentry_bridge")
        .when(unsupported, "no_support")
        .when(F.col("source_id").isNull(), "no_survivor")
        .when(guarded, "weak_to_supported")
        .when(F.col("disagree") & ~rescued, "label_disagreement")
        .when(same_hard & ~(F.col("hard_same") | (~F.col("hard_opposed") & (score >= lb.LABELS.singleton_unknown))), "singleton_label_guard")
        .when(met & ~overrides & ~certain, "cooccurrence")
        .when(F.col("opposed") & ~((score >= M.attribute_override) | overrides), "label_conflict")
        .when(F.col("descriptor_conflict"), "descriptor_conflict"))
    method = (
        F.when(temporal_, "temporal_continuity_gallery_merge").when(adjacent, "adjacent_fragment_gallery_merge")
        .when(reentry, "occlusion_reentry_gallery_merge").when(bridged, "soft_split_gallery_merge")
        .when(same_hard, "same_label_singleton_gallery_merge").when(single & below, "singleton_reentry_gallery_merge")
        .otherwise("weak_identity_gallery_merge"))
    rows = rows.withColumn("rejected", rejected)
    go = F.col("rejected").isNull()
    return rows.withColumn("decision", F.when(go, "merge").otherwise("reject")).withColumn("method", F.when(go, method)).withColumn(
        "source_id", F.when(go, F.col("source_id"))).withColumn("target_id", F.when(go, F.col("target_id")))


def judged(candidates: DataFrame, t: Tables, optional: bool = False) -> DataFrame:
    """Candidates of (entity_id, other_id, rank, score, runner_up) with reason and decision."""
    keyed = candidates.withColumn("entity_a", F.least("entity_id", "other_id")).withColumn(
        "entity_b", F.greatest("entity_id", "other_id"))
    keyed = cut(keyed)
    rows = keyed.join(pair_features(keyed, t), ["entity_a", "entity_b"])
    rows = rows.withColumn("reason", bridge_reason(optional))
    return cut(decide(cut(rows)))


def proposals(decided: DataFrame) -> DataFrame:
    """Per entity the first candidate that merges; a final reject ends the search,
    any other lets the next rank have its turn. At most a few rows per entity."""
    by_rank = Window.partitionBy("entity_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    stops = (F.col("decision") == "merge") | F.col("rejected").isin(*FINAL_REJECTS)
    open_ = F.coalesce(~F.bool_or(stops).over(by_rank), F.lit(True))
    rows = decided.withColumn("_open", open_).where(F.col("_open") & (F.col("decision") == "merge"))
    best = F.struct("score", (-F.col("rank")).alias("r"), (-F.col("entity_id")).alias("e"))
    return rows.groupBy("entity_a", "entity_b").agg(
        F.max_by(F.struct("source_id", "target_id", "score", "method", "reason"), best).alias("_m")).select(
        "entity_a", "entity_b", "_m.*")


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that are the best of both their entities, so no entity merges twice in a pass."""
    ends = edges.select("entity_a", "entity_b", "score", F.explode(F.array("entity_a", "entity_b")).alias("entity_id"))
    order = F.struct("score", (-F.col("entity_a")).alias("a"), (-F.col("entity_b")).alias("b"))
    best = ends.groupBy("entity_id").agg(F.max_by(F.struct("entity_a", "entity_b"), order).alias("_e")).select("_e.*")
    twice = best.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")
    return edges.join(twice, ["entity_a", "entity_b"])


# applying merges ------------------------------------------------------------------------------------


def rename(df: DataFrame, merges: DataFrame, mark: bool = False) -> DataFrame:
    """Replace merged entity ids; ``mark`` keeps the old one in ``merged_from``."""
    m = merges.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("_to"))
    out = df.join(m, "entity_id", "left")
    cols = [F.coalesce("_to", "entity_id").alias("entity_id") if c == "entity_id" else F.col(c) for c in df.columns]
    if mark:
        cols = [c for c, n in zip(cols, df.columns) if n != "merged_from"]
        old = F.col("merged_from") if "merged_from" in df.columns else F.lit(None).cast("long")
        cols.append(F.when(F.col("_to").isNotNull(), F.col("entity_id")).otherwise(old).alias("merged_from"))
    return out.select(*cols)


def apply_entities(entities: DataFrame, merges: DataFrame, sightings: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Survivors gain the sources' sightings (tracklets where there are none),
    the better snapshot and the list of merged ids. Facts are as before the merge."""
    n_s = sightings.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_s"))
    n_t = tracklets.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_t"))
    gone = merges.select(F.col("source_id").alias("entity_id"), "target_id")
    shots = F.struct(F.coalesce("best_snapshot_score", F.lit(0.0)).alias("score"), F.col("snapshot_key").alias("key"))
    absorbed = gone.join(entities, "entity_id").join(n_s, "entity_id", "left").join(n_t, "entity_id", "left").groupBy("target_id").agg(
        F.sum(F.coalesce("_s", "_t", F.lit(0))).alias("_more"),
        F.max(F.when(F.col("snapshot_key").isNotNull(), shots)).alias("_shot"),
        F.min("first_seen_at").alias("_first"), F.max("last_seen_at").alias("_last"),
        F.sort_array(F.collect_set("entity_id")).alias("_ids")).withColumnRenamed("target_id", "entity_id")
    left = entities.join(gone.select("entity_id"), "entity_id", "left_anti").join(absorbed, "entity_id", "left")
    better = F.coalesce(F.col("_shot.score") > F.coalesce("best_snapshot_score", F.lit(0.0)), F.lit(False))
    changed = {
        "sighting_count": F.col("sighting_count") + F.coalesce("_more", F.lit(0)),
        "snapshot_key": F.when(better, F.col("_shot.key")).otherwise(F.col("snapshot_key")),
        "best_snapshot_score": F.when(better, F.col("_shot.score")).otherwise(F.col("best_snapshot_score")),
        "first_seen_at": F.least("first_seen_at", "_first"), "last_seen_at": F.greatest("last_seen_at", "_last"),
    }
    return left.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in entities.columns],
                       F.coalesce("_ids", F.array().cast("array<long>")).alias("merged_ids"))


def merge_events(merges: DataFrame, at: Column) -> DataFrame:
    details = F.create_map(F.lit("source_id"), F.col("source_id").cast("string"), F.lit("method"), F.col("method"),
                           F.lit("reason"), F.coalesce("reason", F.lit("")))
    return merges.select(F.col("target_id").alias("entity_id"), F.lit("identity_merged").alias("event_type"), at.alias("timestamp"),
                         F.lit("").alias("device_id"), details.alias("details"))


def candidates(gallery_points: DataFrame, apart: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """The closest entities of each, with runners-up far enough down that every tested margin is decided."""
    vetoes = None
    if apart is not None:
        vetoes = apart.select(F.col("entity_a").alias("entity_id"), F.col("entity_b").alias("other_id")).unionByName(
            apart.select(F.col("entity_b").alias("entity_id"), F.col("entity_a").alias("other_id")))
    return similarity.closest_entities(gallery_points, M.candidate_floor - MARGIN_REACH, M.candidate_floor, M.retries, vetoes, block)


def one_pass(t: Tables, optional: bool = False, apart: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Merges of one pass: those by vector, then spatial splits among what is left. Pairs in ``apart`` (entity_a < entity_b) are no candidates."""
    by_vector = cut(mutual(proposals(judged(candidates(t.gallery, apart, block), t, optional))))
    return by_vector.unionByName(mutual(proposals(spatial_splits(t, by_vector, optional, apart))))


def spatial_splits(t: Tables, taken: DataFrame, optional: bool = False, apart: DataFrame | None = None) -> DataFrame:
    """Pairs the vector search does not rank but whose tracklets hand over, each at its true score."""
    used = taken.select(F.explode(F.array("entity_a", "entity_b")).alias("_e")).distinct()
    free = t.tracklets.join(used.withColumnRenamed("_e", "entity_id"), "entity_id", "left_anti")
    close = temporal.nearby_pairs(free, 240, 1.30)
    close = close if apart is None else close.join(apart, ["entity_a", "entity_b"], "left_anti")
    counts = evidence_counts(t.tracklets)
    for s in "ab":
        close = close.join(counts.select(F.col("entity_id").alias(f"entity_{s}"), F.col("tracklets").alias(f"n_{s}")), f"entity_{s}", "left")
    # only pairs with a reason go on, so vectors and features are read for those alone that may get one
    close = cut(close.na.fill({"n_a": 0, "n_b": 0}).where(F.least("n_a", "n_b") <= BRIDGE_MOST))
    scored = close.join(similarity.pair_similarity(close, t.gallery), ["entity_a", "entity_b"]).where(may_bridge(optional))
    rows = scored.select(F.col("entity_a").alias("entity_id"), F.col("entity_b").alias("other_id"), F.lit(1).alias("rank"), "score",
                         F.lit(None).cast("double").alias("runner_up"))
    return judged(rows, t, optional).where(F.col("reason").isNotNull())


def reconcile(t: Tables, passes: int = M.passes, optional: bool = False, block: int | None = None, cannot_link: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, score, method, reason, pass) over all passes, targets
    resolved to the final survivor. Each pass looks for the closest entities anew: a few
    rows an entity, where the scores of all pairs would grow with the square of the entities.

    Pairs in ``cannot_link`` (entity_a, entity_b) never come into one entity: a veto between two entities holds for the groups they have
    become part of, so it is relabelled after each pass, and in a pass no entity takes part in two merges.
    """
    apart = None if cannot_link is None else cut(cannot_link.select(F.least("entity_a", "entity_b").alias("entity_a"), F.greatest("entity_a", "entity_b").alias("entity_b")).distinct())
    t = t._replace(tracklets=cut(t.tracklets), label_rows=cut(t.label_rows), gallery=cut(t.gallery))
    found: DataFrame | None = None
    for n in range(1, passes + 1):
        merges = cut(one_pass(t, optional, apart, block).select("source_id", "target_id", "score", "method", "reason", F.lit(n).alias("pass")))
        if merges.isEmpty():
            break
        found = merges if found is None else found.unionByName(merges)
        if apart is not None:
            apart = cut(_relabel(apart.withColumn("score", F.lit(0.0)), merges).drop("score"))
        t = t._replace(tracklets=cut(rename(t.tracklets, merges)), label_rows=cut(rename(t.label_rows, merges)),
                       gallery=cut(rename(t.gallery, merges)))
    if found is None:
        return merges
    return final_targets(found)


def _relabel(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    m = merges.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"))
    out = pairs
    for side in ("entity_a", "entity_b"):
        out = out.join(m, F.col(side) == F.col("_s"), "left").withColumn(side, F.coalesce("_t", side)).drop("_s", "_t")
    out = out.where(F.col("entity_a") != F.col("entity_b"))
    return out.groupBy(F.least("entity_a", "entity_b").alias("entity_a"), F.greatest("entity_a", "entity_b").alias("entity_b")).agg(
        F.max("score").alias("score"))


def final_targets(merges: DataFrame) -> DataFrame:
    """Follow chains of merges to the entity that is left."""
    links = merges.select(F.col("source_id").alias("head"), F.col("target_id").alias("tail"))
    nodes = merges.select(F.explode(F.array("source_id", "target_id")).alias("box_id")).distinct()
    ends = tracks.roots(nodes, links).select(F.col("id").alias("target_id"), F.col("root").alias("_end"))
    return merges.join(ends, "target_id").withColumn("target_id", F.col("_end")).drop("_end")


def finalize(t: Tables, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """End of input: merges over all passes, then entities that never moved."""
    merges = reconcile(t)
    left = rename(t.tracklets, merges)
    return merges, quality.static_entities(left)


def merged_gallery(points: DataFrame, merges: DataFrame, keys: tuple[str, ...] = ("entity_id", "kind")) -> DataFrame:
    return gallery.prune(gallery.move_points(points, merges), keys)
