"""Deciding for each tracklet which entity it is: a known one, a new one, or not yet.

The tracklets of a batch are matched against the gallery as it stood when the
batch began. All searches of the cascade differ only in threshold, so one
similarity join at the lowest threshold serves them; the cascade itself is a
chain of conditions over the resulting columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MATCHING as M
from ..functions import geometry as g
from ..lineage import cut
from ..operators import numbering, similarity, temporal, tiles

SEARCHES = (M.capped, M.near, M.soft, M.threshold, max(M.threshold, M.low_visibility_threshold))
SEARCH_FLOOR = min(SEARCHES)


def low_visibility() -> Column:
    return (F.col("v_avg") < M.low_visibility) | (F.col("track_id") < 0)


def point_scores(tracklets: DataFrame, gallery: DataFrame, floor: float = SEARCH_FLOOR, block: int | None = None) -> DataFrame:
    """(tracklet_id, entity_id, first, second): the two best points of the entities that are among the ``top_k`` of a tracklet at ``floor``
    or at some other threshold of the cascade. No search of the cascade asks for more, so it is a few rows a tracklet, not one a hit."""
    q = tracklets.select(F.col("tracklet_id").alias("id"), F.col("tracklet_id").alias("tag"), "vec")
    p = gallery.select(F.col("point_id").alias("id"), F.col("entity_id").alias("tag"), "vec")
    asked = sorted({floor, *(t for t in SEARCHES if t > floor)})
    return tiles.best_two(q, p, floor, M.top_k, asked, M.consensus_weight, block=block).withColumnsRenamed(
        {"left_id": "tracklet_id", "right_tag": "entity_id"})


def blended(threshold: Column) -> Column:
    """An entity's score at a threshold; null below it."""
    w = M.consensus_weight
    both = F.when(F.col("second") >= threshold, F.col("first") * (1 - w) + F.col("second") * w)
    return F.when(F.col("first") >= threshold, F.coalesce(both, F.col("first")))


def leaders(scored: DataFrame, threshold: Column, top_k: int, eligible: Column, prefix: str) -> DataFrame:
    """Best and second eligible entity among the ``top_k`` of a search."""
    by_score = Window.partitionBy("tracklet_id").orderBy(F.desc("_s"), "entity_id")
    top = scored.withColumn("_s", blended(threshold)).where("_s IS NOT NULL").withColumn(
        "_r", F.row_number().over(by_score)).where(F.col("_r") <= top_k).where(eligible)
    top = top.withColumn("_r", F.row_number().over(by_score))
    other = F.col("entity_id") != F.coalesce("current_id", F.lit(-1))
    return top.groupBy("tracklet_id").agg(
        F.max(F.when(F.col("_r") == 1, F.col("entity_id"))).alias(f"{prefix}_id"),
        F.max(F.when(F.col("_r") == 1, F.col("_s"))).alias(f"{prefix}_score"),
        F.max(F.when(F.col("_r") == 2, F.col("_s"))).alias(f"{prefix}_second"),
        F.max(F.when(other, F.col("_s"))).alias(f"{prefix}_other"))


def all_leaders(scored: DataFrame, searches: list[tuple[str, Column, int, Column]]) -> DataFrame:
    """``leaders`` of several searches (prefix, threshold, top_k, eligible) over the same scores: one shuffle, one row a tracklet."""
    def ranked(order: Column) -> Column:
        return F.row_number().over(Window.partitionBy("tracklet_id").orderBy(order.desc_nulls_last(), "entity_id"))

    other = F.col("entity_id") != F.coalesce("current_id", F.lit(-1))
    rows, found = scored, []
    for prefix, threshold, k, ok in searches:
        s, t, r = f"_s_{prefix}", f"_t_{prefix}", f"_r_{prefix}"
        rows = rows.withColumn(s, blended(threshold))
        rows = rows.withColumn(t, F.when((ranked(F.col(s)) <= k) & ok, F.col(s)))
        rows = rows.withColumn(r, F.when(F.col(t).isNotNull(), ranked(F.col(t))))
        found += [F.max(F.when(F.col(r) == 1, F.col("entity_id"))).alias(f"{prefix}_id"), F.max(F.when(F.col(r) == 1, F.col(t))).alias(f"{prefix}_score"),
                  F.max(F.when(F.col(r) == 2, F.col(t))).alias(f"{prefix}_second"), F.max(F.when(other, F.col(t))).alias(f"{prefix}_other")]
    return rows.groupBy("tracklet_id").agg(*found)


def exclusion_flags(exclusions: DataFrame) -> DataFrame:
    """Rows of (tracklet_id, entity_id, reason) to one row of flags per pair."""
    return exclusions.groupBy("tracklet_id", "entity_id").agg(*[
        F.bool_or(F.col("reason") == r).alias(r) for r in ("forbidden", "recent", "blocked", "duplicate")])


def exclusion_set(parts: dict[str, DataFrame], current: DataFrame) -> DataFrame:
    """Union of the exclusion sources, the tracklet's own entity taken out."""
    rows = None
    for reason, df in parts.items():
        part = df.select("tracklet_id", "entity_id", F.lit(reason).alias("reason"))
        rows = part if rows is None else rows.unionByName(part)
    own = current.where("current_id IS NOT NULL").select("tracklet_id", F.col("current_id").alias("entity_id"))
    return rows.distinct().join(own, ["tracklet_id", "entity_id"], "left_anti")


def new_identity_gate() -> Column:
    """First gate that stops a new entity, or null."""
    return (
        F.when(F.col("entry_count") < M.mint_entries, "gate_tracklet_len")
        .when(F.col("quality_frames") < M.mint_quality_frames, "gate_high_quality_frames")
        .when(F.col("v_avg") < M.mint_v, "gate_v_avg")
        .when(F.col("vector_consistency") < M.mint_consistency, "gate_consistency"))


def with_scores(tracklets: DataFrame, gallery: DataFrame, aux: DataFrame | None = None, exclusions: DataFrame | None = None,
                block: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Every score the cascade reads, one row per tracklet; ``pairs`` are point scores that were searched before.

    Tracklets carry tracklet_id (long), track_id, vec, v_avg, vector_consistency,
    entry_count, quality_frames, max_overlap, current_id, hint_id.
    """
    scored = point_scores(tracklets, gallery, block=block) if pairs is None else pairs
    keep = tracklets.select("tracklet_id", "current_id", low_visibility().alias("_low"))
    scored = scored.join(keep, "tracklet_id")
    flags = ("forbidden", "recent", "blocked", "duplicate")
    if exclusions is None:
        for f in flags:
            scored = scored.withColumn(f, F.lit(False))
        hint_bad = tracklets.select("tracklet_id", F.lit(False).alias("hint_bad"))
    else:
        marked = cut(exclusion_flags(exclusions))
        scored = scored.join(marked, ["tracklet_id", "entity_id"], "left").na.fill({f: False for f in flags})
        hint_bad = tracklets.select("tracklet_id", F.col("hint_id").alias("entity_id")).join(
            marked, ["tracklet_id", "entity_id"], "left").select(
            "tracklet_id", F.coalesce(F.col("forbidden") | F.col("recent"), F.lit(False)).alias("hint_bad"))
    scored = cut(scored)
    own = F.coalesce(F.col("entity_id") == F.col("current_id"), F.lit(False))
    strict = F.when(F.col("_low"), F.lit(max(M.threshold, M.low_visibility_threshold))).otherwise(F.lit(M.threshold))
    main_ok = own | (~F.col("forbidden") & ~F.col("recent") & (
        ~F.col("blocked") | (F.col("duplicate") & (blended(strict) >= M.blocked))))
    free = ~F.col("forbidden") & ~F.col("recent") & ~F.col("blocked")
    # once continuity has failed the current entity is out for the looser searches
    loose = free & ~own
    led = all_leaders(scored, [
        ("main", strict, M.top_k, main_ok), ("soft", F.lit(M.soft), 2, loose), ("near", F.lit(M.near), 2, loose), ("capped", F.lit(M.capped), 2, loose),
        ("fresh", F.lit(M.threshold), M.top_k, loose), ("open", F.lit(M.near), 1, F.lit(True))])
    out = tracklets.join(led, "tracklet_id", "left")
    for name in ("current", "hint"):
        asked = tracklets.where(F.col(f"{name}_id").isNotNull()).select(
            F.col("tracklet_id").alias("query_id"), F.col(f"{name}_id").alias("entity_id"), "vec")
        got = similarity.own_score(asked, gallery).select(F.col("query_id").alias("tracklet_id"), F.col("score").alias(f"{name}_score"))
        out = out.join(got, "tracklet_id", "left")
    out = out.join(hint_bad, "tracklet_id", "left")
    if aux is None:
        return out.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("aux_id", "long"), ("aux_score", "double"), ("aux_second", "double"), ("aux_full", "double"))])
    asked = tracklets.where(similarity_aux_allowed()).select(F.col("tracklet_id").alias("query_id"), "vec")
    found = similarity.search_aux(asked, aux, block=block).withColumnRenamed("query_id", "tracklet_id")
    if exclusions is not None:
        barred = marked.where(F.col("forbidden") | F.col("recent") | F.col("blocked"))
        found = found.join(barred.select("tracklet_id", "entity_id"), ["tracklet_id", "entity_id"], "left_anti")
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("tracklet_id").orderBy("rank")))
    top = found.groupBy("tracklet_id").agg(
        F.max(F.when(F.col("_r") == 1, F.col("entity_id"))).alias("aux_id"),
        F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("aux_score"),
        F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("aux_second"))
    full = similarity.own_score(
        top.join(tracklets.select("tracklet_id", "vec"), "tracklet_id").select(
            F.col("tracklet_id").alias("query_id"), F.col("aux_id").alias("entity_id"), "vec"), gallery)
    full = full.select(F.col("query_id").alias("tracklet_id"), F.col("score").alias("aux_full"))
    return out.join(top, "tracklet_id", "left").join(full, "tracklet_id", "left")


def similarity_aux_allowed() -> Column:
    """Untracked clusters that are clear enough for the part-view gallery."""
    return (
        F.col("current_id").isNull() & (F.col("track_id") < 0) & (F.col("v_avg") >= M.aux_v)
        & (F.col("vector_consistency") >= M.aux_consistency) & (F.col("entry_count") >= M.aux_entries)
        & (F.col("max_overlap") <= M.aux_max_overlap))


def soft_hit(prefix: str) -> Column:
    """A leader clear of its runner-up."""
    gap = F.col(f"{prefix}_score") - F.col(f"{prefix}_second")
    return F.col(f"{prefix}_id").isNotNull() & F.coalesce(gap >= M.margin, F.lit(True))


def cascade(rows: DataFrame, allow_new: bool = True) -> DataFrame:
    """method, source, entity_id, score, runner_up and suggested_id per tracklet.

    The outcome is the last decision of an attempt: an ambiguous leader, a current
    identity that failed or an unsupported part-view match does not end it, and
    the attempt goes on to park, mint or fall back. ``attempts`` counts earlier parked attempts of the track, whose best one the
    row carries; ``was_ambiguous`` tells whether any of them was ambiguous.
    """
    low = low_visibility()
    has_current = F.col("current_id").isNotNull()
    floor = F.when(low, F.lit(max(M.continuity, M.low_visibility_threshold))).otherwise(F.lit(M.continuity))
    kept = F.coalesce(F.col("current_score") >= floor, F.lit(False))
    best, second, rival = F.col("main_score"), F.col("main_second"), F.col("main_other")
    lead = rival - F.col("current_score")
    switch = F.coalesce(
        ((rival >= M.certain) & (lead >= M.certain_margin))
        | ((F.col("current_score") <= M.switch_current) & (rival >= M.switch_score) & (lead >= M.switch_margin)), F.lit(False))
    found = F.col("main_id").isNotNull()
    unclear = found & F.coalesce(
        (F.col("main_id") != F.coalesce("current_id", F.lit(-1))) & (best < M.certain) & (best - second < M.margin), F.lit(False))
    hinted = (
        F.col("hint_id").isNotNull() & ~F.coalesce("hint_bad", F.lit(False))
        & ~F.coalesce(F.col("hint_id") == F.col("current_id"), F.lit(False)) & (F.col("hint_score") >= M.spatial_reuse))
    aux_found = F.col("aux_id").isNotNull() & ~has_current
    aux_backed = F.coalesce(F.col("aux_full") >= M.aux_support, F.lit(False))
    aux_clear = F.coalesce(F.col("aux_score") - F.col("aux_second") >= M.aux_margin, F.lit(True))
    promote = (F.col("v_avg") >= M.mint_v) & (F.col("vector_consistency") >= M.mint_consistency)
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    again = attempts > 1
    ambiguous = unclear | F.coalesce("was_ambiguous", F.lit(False))
    last = attempts >= M.max_attempts
    gate = new_identity_gate()
    short = F.col("entry_count") < M.mint_entries
    close = F.col("near_id").isNotNull() & F.lit(M.near < M.soft)
    may_mint_late = F.coalesce(F.col("open_score") < M.near_mint_below, F.lit(True))
    promoted = F.when(again, "tentative_promoted").otherwise("new_detection")

    def blocked(source: Column | str) -> Column:
        return F.concat_ws("__", source if isinstance(source, Column) else F.lit(source), gate)
    fresh_promote = promote & ~unclear & F.lit(allow_new)

    steps: list[tuple[Column, str, Column | str, str | None]] = [
        # condition, method, source, column prefix the entity and scores come from
        (~has_current & (F.col("vector_consistency") < M.min_consistency), "consistency_rejected", "incoherent_tracklet", None),
        (found & has_current & kept & ~switch, "current_identity_maintained", "track_continuity", "current"),
        (found & ~unclear, "gallery_match", "gallery_search", "main"),
        (has_current & kept, "current_identity_maintained", "track_continuity", "current"),
        (hinted, "spatial_appearance_reuse", "spatial_hint", "hint"),
        (aux_found & aux_backed & aux_clear, "scale_aux_gallery_match", "upper_body_gallery", "aux"),
        (promote & F.lit(not allow_new) & soft_hit("capped"), "capped_soft_match", "identity_cap", "capped"),
        (fresh_promote & short, "tentative_pending", "provisional_short_tracklet", None),
        (fresh_promote & soft_hit("soft"), "soft_match_at_promotion", promoted, "soft"),
        (fresh_promote & close, "near_gallery_deferred", promoted, None),
        (fresh_promote & gate.isNull(), "new_identity", promoted, None),
        (fresh_promote, "new_identity_blocked", blocked(promoted), None),
        (F.lit(M.eager < M.soft) & ~again & soft_hit("soft"), "eager_soft_match", "eager_pre_tentative", "soft"),
        (~again, "tentative_pending", "quality_gate", None),
        (last & F.lit(not allow_new) & soft_hit("capped"), "capped_soft_match", "identity_cap_fallback", "capped"),
        (last & F.lit(not allow_new), "new_identity_suppressed", "new_identity_disabled", None),
        (last & ambiguous & F.col("fresh_id").isNotNull(), "ambiguous_resolved", "tentative_fallback", "fresh"),
        (last & ambiguous & short, "tentative_pending", "provisional_short_tracklet", None),
        (last & ambiguous & gate.isNull(), "new_identity", "ambiguous_fallback", None),
        (last & ambiguous, "new_identity_blocked", blocked("ambiguous_fallback"), None),
        (last & soft_hit("soft"), "tentative_soft_match", "tentative_fallback", "soft"),
        (last & close & ~(promote & ~short & may_mint_late), "near_gallery_deferred", "tentative_near_gallery", None),
        (last & ~promote, "tentative_pending", "quality_gate_blocked_fallback", None),
        (last & short, "tentative_pending", "provisional_short_tracklet", None),
        (last & gate.isNull(), "new_identity", "tentative_fallback", None),
        (last, "new_identity_blocked", blocked("tentative_fallback"), None),
    ]
    index = F
    for n, (condition, *_) in enumerate(steps):
        index = index.when(condition, n)
    # stored, so that later filters on the outcome do not repeat every condition
    staged = cut(rows.withColumn("_step", index.otherwise(-1)))
    at = F.col("_step")

    def pick(values: list[tuple[int, Column]], kind: str) -> Column:
        out = F
        for n, value in values:
            out = out.when(at == n, value)
        return out.otherwise(F.lit(None).cast(kind))

    named = [(n, p) for n, (_, _, _, p) in enumerate(steps) if p]
    # a kept identity names the strongest rival it was weighed against
    seconds = [(n, F.col(f"{p}_second")) for n, p in named if p not in ("current", "hint")] + [(1, F.col("main_other"))]
    out = staged.select(
        "*", pick([(n, F.lit(m)) for n, (_, m, _, _) in enumerate(steps)], "string").alias("method"),
        pick([(n, o if isinstance(o, Column) else F.lit(o)) for n, (_, _, o, _) in enumerate(steps)], "string").alias("source"),
        pick([(n, F.col(f"{p}_id")) for n, p in named], "long").alias("entity_id"),
        pick([(n, F.col(f"{p}_score")) for n, p in named], "double").alias("score"),
        pick(seconds, "double").alias("runner_up"))
    out = out.withColumn("method", F.coalesce("method", F.lit("tentative_pending"))).withColumn(
        "source", F.coalesce("source", F.lit("quality_gate"))).drop("_step")
    deferred = F.col("method") == "near_gallery_deferred"
    return out.withColumn("suggested_id", F.when(deferred, F.col("near_id"))).withColumn(
        "score", F.when(deferred, F.col("near_score")).otherwise(F.col("score"))).withColumn(
        "runner_up", F.when(deferred, F.col("near_second")).otherwise(F.col("runner_up")))


def best_attempts(rows: DataFrame) -> DataFrame:
    """Retry state of a track: its best attempt by composite quality, how many there were."""
    keep = [c for c in rows.columns if c != "track_id"]
    quality = F.struct((F.col("v_avg") * F.col("vector_consistency")).alias("q"), (-F.col("tracklet_id")).alias("t"))
    best = rows.groupBy("track_id").agg(
        F.max_by(F.struct(*keep), quality).alias("_b"), (F.count(F.lit(1)) - 1).alias("_attempts"),
        F.max("entry_count").alias("_len"), F.max("quality_frames").alias("_hq"))
    return best.select("track_id", "_b.*", "_attempts", "_len", "_hq").drop("entry_count", "quality_frames").withColumnsRenamed(
        {"_attempts": "attempts", "_len": "entry_count", "_hq": "quality_frames"})


def provisional(decided: DataFrame, tracklets: DataFrame, misfits: DataFrame | None = None) -> DataFrame:
    """Deferred tracklets that may join their suggested entity as evidence only.

    ``tracklets``: earlier tracklets of entities; ``misfits``: (tracklet_id,
    entity_id) pairs whose labels or descriptors disagree.
    """
    open_ = decided.where((F.col("method") == "near_gallery_deferred") & F.col("current_id").isNull())
    open_ = open_.withColumn("other_id", F.col("suggested_id"))
    if misfits is not None:
        bad = misfits.select("tracklet_id", F.col("entity_id").alias("other_id"))
        open_ = open_.join(bad, ["tracklet_id", "other_id"], "left_anti")
    back = temporal.short_reentry(open_, tracklets).select("tracklet_id", F.lit(True).alias("_back"))
    rows = open_.join(back, "tracklet_id", "left").withColumn("short_reentry", F.coalesce("_back", F.lit(False))).drop("_back", "other_id")
    floor = F.when(F.col("short_reentry"), min(M.provisional, M.provisional_reentry)).otherwise(M.provisional)
    margin = F.coalesce(F.col("score") - F.col("runner_up") >= M.provisional_margin, F.lit(True))
    crowded = low_visibility() | (F.col("max_overlap") >= 0.35) | F.col("short_reentry")
    ok = (F.col("score") >= floor) & margin & (F.col("max_overlap") < M.provisional_max_overlap) & crowded
    return rows.where(ok).withColumn("entity_id", F.col("suggested_id")).withColumn(
        "method", F.lit("occlusion_provisional_match")).withColumn("provisional", F.lit(True))


def one_per_frame(decided: DataFrame) -> DataFrame:
    """Within a frame an entity goes to its best tracklet; the others wait."""
    best = Window.partitionBy("device_id", "frame_end", "entity_id").orderBy(F.desc("score"), "tracklet_id")
    matched = decided.where(F.col("entity_id").isNotNull()).withColumn("_r", F.row_number().over(best))
    lost = F.col("_r") > 1
    matched = matched.withColumn("method", F.when(lost, "reserved_by_other").otherwise(F.col("method"))).withColumn(
        "entity_id", F.when(~lost, F.col("entity_id"))).drop("_r")
    return matched.unionByName(decided.where(F.col("entity_id").isNull()))


def decide(tracklets: DataFrame, gallery: DataFrame, aux: DataFrame | None = None, exclusions: DataFrame | None = None, allow_new: bool = True,
           block: int | None = None) -> DataFrame:
    """The cascade for a batch in which an entity goes to one tracklet of a frame, with the entity barred for the others' next attempt.

    Deferred acceptance: each tracklet's attempt names the entity it wants; of those in a frame that want the same one the best scored keeps
    it for now, and the others go through the whole cascade again without that entity, where they may win another from its holder, be
    deferred or become new. The outcome is stable: whoever would rather have another entity of its frame finds it with a better scored
    tracklet. A round searches nothing anew and takes up only the tracklets that lost; every round bars pairs for good, so rounds end.
    ``round`` tells the attempt that decided. Ties go to the smaller tracklet id.
    """
    spot = ["device_id", "frame_end", "entity_id"]
    best = Window.partitionBy(*spot).orderBy(F.desc_nulls_last("score"), "tracklet_id")
    waiting, barred, held, rounds = tracklets, exclusions, None, 0
    pairs = cut(point_scores(tracklets, gallery, block=block))
    while True:
        scores = with_scores(waiting, gallery, aux, barred, block, pairs.join(waiting.select("tracklet_id"), "tracklet_id", "left_semi"))
        tried = cascade(scores, allow_new).withColumn("round", F.lit(rounds))
        claims = tried if held is None else held.unionByName(tried)
        named = claims.where(F.col("entity_id").isNotNull()).withColumn("_lost", F.row_number().over(best) > 1)
        ranked = cut(named.unionByName(claims.where(F.col("entity_id").isNull()).withColumn("_lost", F.lit(False))))
        lost = ranked.where("_lost").select("tracklet_id", F.col("entity_id").alias("_gone"))
        held = ranked.where("NOT _lost").drop("_lost")
        if lost.isEmpty():
            return held
        rounds += 1
        gone = lost.select("tracklet_id", F.col("_gone").alias("entity_id"), F.lit("forbidden").alias("reason"))
        barred = cut(gone if barred is None else barred.unionByName(gone))
        # whoever lost its own or its hinted entity has none of them any more
        waiting = cut(waiting_again(tracklets, barred.join(gone.select("tracklet_id"), "tracklet_id", "left_semi")))


def waiting_again(tracklets: DataFrame, barred: DataFrame) -> DataFrame:
    """Tracklets for another attempt, without a current or hinted entity that they lost."""
    taken = barred.where(F.col("reason") == "forbidden").groupBy("tracklet_id").agg(F.collect_set("entity_id").alias("_taken"))
    rows = tracklets.join(taken, "tracklet_id")
    return rows.select(*[F.when(~F.array_contains("_taken", F.col(c)), F.col(c)).alias(c) if c in ("current_id", "hint_id") else F.col(c)
                         for c in tracklets.columns])


def mint(decided: DataFrame, first_id: int) -> DataFrame:
    """Numbers for new entities in order of first sight."""
    new = decided.where(F.col("method") == "new_identity").drop("entity_id")
    return numbering.with_number(new, ["started_at", "tracklet_id"], first_id, "entity_id")


def linked_new(decided: DataFrame, floor: float = M.threshold, block: int | None = None) -> DataFrame:
    """New entities of one batch that are each other's closest: the later takes the earlier's id."""
    new = decided.where(F.col("method") == "new_identity").select(
        F.col("entity_id").alias("id"), F.col("entity_id").alias("tag"), "vec")
    pairs = tiles.hits(new, None, floor, block=block).select(
        F.col("left_id").alias("entity_a"), F.col("right_id").alias("entity_b"), F.round("score", tiles.DIGITS).alias("score"))
    from .merge import mutual
    return mutual(pairs).select(F.col("entity_b").alias("source_id"), F.col("entity_a").alias("target_id"), "score")


def attach_or_mint(clusters: DataFrame, gallery: DataFrame, block: int | None = None) -> DataFrame:
    """Flushed untracked clusters: evidence for a clear match, a new entity when
    clear, long and unlike everything, otherwise nothing.

    Clusters carry tracklet_id (long), vec, entry_count, v_max, overall.
    """
    from ..config import CLUSTERS as C

    fit = clusters.where((F.col("entry_count") >= C.candidate_entries) & (F.col("v_max") >= C.promote_v))
    scores = cut(point_scores(fit, gallery, M.near, block).withColumn("current_id", F.lit(None).cast("long")))
    out = fit.join(leaders(scores, F.lit(M.threshold), 2, F.lit(True), "hit"), "tracklet_id", "left").join(
        leaders(scores, F.lit(M.near), 1, F.lit(True), "near"), "tracklet_id", "left")
    clear = F.col("hit_id").isNotNull() & F.coalesce(F.col("hit_score") - F.col("hit_second") >= M.margin, F.lit(True))
    alone = (
        F.col("hit_id").isNull() & (F.col("v_max") >= C.lastresort_v) & (F.col("entry_count") >= C.lastresort_entries)
        & (F.col("overall") >= M.mint_consistency) & F.coalesce(F.col("near_score") < M.near_mint_below, F.lit(True)))
    method = F.when(clear, "untracked_cluster_evidence").when(alone, "new_identity")
    return out.withColumn("method", method).withColumn("entity_id", F.when(clear, F.col("hit_id"))).where("method IS NOT NULL")


def snapshot_rows(decided: DataFrame) -> DataFrame:
    """What a confirmed match adds to its entity: a scored snapshot key."""
    confirmed = F.col("entity_id").isNotNull() & ~F.coalesce("provisional", F.lit(False))
    return decided.where(confirmed).select(
        "entity_id", F.col("tracklet_id").alias("seq"), F.concat(F.lit("tracklet-"), F.col("tracklet_id")).alias("snapshot_key"),
        g.snapshot_score(F.col("v_avg"), F.col("overall"), F.col("vector_consistency"), F.col("max_overlap")).alias("snapshot_score"))


def recovered(promoted: DataFrame, gallery: DataFrame, block: int | None = None) -> DataFrame:
    """Chains of short fragments that were promoted: a new entity, unless one is known that they resemble; then they are deferred with it
    as suggestion, and may join it as evidence by ``provisional``.

    Chains carry chain_id, box_id of the fragment that completed them, and vec.
    """
    from ..operators.evidence import FRAGMENT_NEAR

    asked = promoted.select(F.col("chain_id").alias("tracklet_id"), "vec")
    scores = cut(point_scores(asked, gallery, FRAGMENT_NEAR, block).withColumn("current_id", F.lit(None).cast("long")))
    near = leaders(scores, F.lit(FRAGMENT_NEAR), 1, F.lit(True), "near").select(F.col("tracklet_id").alias("chain_id"), "near_id", "near_score")
    method = F.when(F.col("near_id").isNotNull(), "fragment_recovery_deferred_near_gallery").otherwise("new_identity")
    return promoted.join(near, "chain_id", "left").withColumn("method", method).withColumnsRenamed({"near_id": "suggested_id", "near_score": "score"}).withColumn(
        "source", F.lit("fragment_recovery"))
