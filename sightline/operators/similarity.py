"""Vector search over the gallery: points with (point_id, entity_id, vec)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MATCHING
from ..functions import vectors as v
from . import tiles


def _hits(queries: DataFrame, gallery: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    q = queries.select(F.col("query_id").alias("id"), F.col("query_id").alias("tag"), "vec")
    g = gallery.select(F.col("point_id").alias("id"), F.col("entity_id").alias("tag"), "vec")
    return tiles.hits(q, g, threshold, block=block).select(
        F.col("left_id").alias("query_id"), F.col("right_id").alias("point_id"),
        F.col("right_tag").alias("entity_id"), "score")


def _ranked(scores: DataFrame, top_k: int | None) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    ranked = scores.withColumn("rank", F.row_number().over(best))
    return ranked if top_k is None else ranked.where(F.col("rank") <= top_k)


def search(queries: DataFrame, gallery: DataFrame, threshold: float = MATCHING.threshold,
           top_k: int | None = MATCHING.top_k, weight: float = MATCHING.consensus_weight,
           block: int | None = None) -> DataFrame:
    """Entities per query vector. Two hits of an entity are blended, so one lucky
    view counts for less; the second only counts if it clears the threshold too."""
    if top_k is None:
        per_entity = Window.partitionBy("query_id", "entity_id").orderBy(F.desc("score"), "point_id")
        two = _hits(queries, gallery, threshold, block).withColumn("_r", F.row_number().over(per_entity)).where("_r <= 2")
        scores = two.groupBy("query_id", "entity_id").agg(
            F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("first"),
            F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("second"))
    else:
        q = queries.select(F.col("query_id").alias("id"), F.col("query_id").alias("tag"), "vec")
        g = gallery.select(F.col("point_id").alias("id"), F.col("entity_id").alias("tag"), "vec")
        scores = tiles.best_two(q, g, threshold, top_k, [threshold], weight, block=block).withColumnsRenamed(
            {"left_id": "query_id", "right_tag": "entity_id"})
    blended = F.coalesce(F.col("first") * (1.0 - weight) + F.col("second") * weight, F.col("first"))
    scores = scores.select("query_id", "entity_id", blended.alias("score")).where(F.col("score") >= threshold)
    return _ranked(scores, top_k)


def search_aux(queries: DataFrame, gallery: DataFrame, threshold: float = MATCHING.aux,
               top_k: int | None = MATCHING.aux_top_k, block: int | None = None) -> DataFrame:
    """Best single view per entity."""
    if top_k is None:
        best = _hits(queries, gallery, threshold, block).groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))
    else:
        q = queries.select(F.col("query_id").alias("id"), F.col("query_id").alias("tag"), "vec")
        g = gallery.select(F.col("point_id").alias("id"), F.col("entity_id").alias("tag"), "vec")
        best = tiles.nearest_tags(q, g, threshold, top_k, block=block).select(
            F.col("left_tag").alias("query_id"), F.col("right_tag").alias("entity_id"), "score")
    return _ranked(best, top_k)


def own_score(queries: DataFrame, gallery: DataFrame, min_score: float = 0.0, anchors_only: bool = False) -> DataFrame:
    """Best score of one named entity per query: (query_id, entity_id, vec) in,
    no row when it has no points or stays below ``min_score``."""
    points = gallery.where(F.col("is_anchor")) if anchors_only else gallery
    joined = queries.withColumnRenamed("vec", "_q").join(points.select("entity_id", "vec"), "entity_id")
    best = joined.groupBy("query_id", "entity_id").agg(F.max(v.cosine(F.col("_q"), F.col("vec"))).alias("score"))
    if not anchors_only:
        best = best.withColumn("score", F.greatest("score", F.lit(0.0)))
    return best.where(F.col("score") >= min_score)


def entity_pairs(gallery: DataFrame, floor: float, block: int | None = None) -> DataFrame:
    """Best cosine of every pair of entities that reaches ``floor``: entity_a < entity_b."""
    g = gallery.select(F.col("point_id").alias("id"), F.col("entity_id").alias("tag"), "vec")
    found = tiles.hits(g, None, floor, other_tag_only=True, block=block)
    return found.groupBy(
        F.least("left_tag", "right_tag").alias("entity_a"), F.greatest("left_tag", "right_tag").alias("entity_b"),
    ).agg(F.max("score").alias("score"))


def both_ways(pairs: DataFrame) -> DataFrame:
    one = pairs.select(F.col("entity_a").alias("entity_id"), F.col("entity_b").alias("other_id"), "score")
    two = pairs.select(F.col("entity_b").alias("entity_id"), F.col("entity_a").alias("other_id"), "score")
    return one.unionByName(two)


def duplicate_candidates(pairs: DataFrame, min_score: float, ranks: int = 1,
                         excluded: DataFrame | None = None) -> DataFrame:
    """The closest other entities of each entity with the score of the next one.

    ``pairs`` must reach further down than ``min_score`` by the widest margin a
    caller tests; a missing runner-up then means "further away than that".
    ``excluded``: (entity_id, other_id) rows that may not be proposed.
    """
    return _closest(both_ways(pairs), min_score, ranks, excluded)


def closest_entities(gallery: DataFrame, floor: float, min_score: float, ranks: int = 1, excluded: DataFrame | None = None,
                     block: int | None = None) -> DataFrame:
    """As ``duplicate_candidates`` over ``entity_pairs(gallery, floor)``, without a row for every pair: a task passes on the few
    nearest of each entity, and as many more as the longest list of an entity in ``excluded`` has."""
    more = 0
    if excluded is not None:
        most = excluded.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        more = int(most or 0)
    g = gallery.select(F.col("point_id").alias("id"), F.col("entity_id").alias("tag"), "vec")
    near = tiles.nearest_tags(g, None, floor, ranks + 1 + more, block=block).select(
        F.col("left_tag").alias("entity_id"), F.col("right_tag").alias("other_id"), "score")
    return _closest(near, min_score, ranks, excluded)


def _closest(both: DataFrame, min_score: float, ranks: int, excluded: DataFrame | None) -> DataFrame:
    if excluded is not None:
        both = both.join(excluded, ["entity_id", "other_id"], "left_anti")
    by_score = Window.partitionBy("entity_id").orderBy(F.desc("score"), "other_id")
    near = both.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= ranks + 1)
    near = near.withColumn("runner_up", F.lead("score").over(by_score))
    return near.where((F.col("rank") <= ranks) & (F.col("score") >= min_score))


def pair_similarity(pairs: DataFrame, gallery: DataFrame) -> DataFrame:
    """Best cosine between the points of two entities, 0 when a side has none.
    Galleries are pruned to a few points per entity."""
    a = gallery.select(F.col("entity_id").alias("entity_a"), F.col("vec").alias("_a"))
    b = gallery.select(F.col("entity_id").alias("entity_b"), F.col("vec").alias("_b"))
    met = pairs.select("entity_a", "entity_b").join(a, "entity_a", "left").join(b, "entity_b", "left")
    score = F.max(v.cosine(F.col("_a"), F.col("_b")))
    return met.groupBy("entity_a", "entity_b").agg(F.coalesce(score, F.lit(0.0)).alias("score"))


def by_vector(gallery: DataFrame, vector: Sequence[float], top_k: int = 10, min_score: float = 0.5,
              exclude: int | None = None) -> DataFrame:
    """One pass over the gallery; best point per entity, then the top few."""
    q = F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")
    scored = gallery.select("entity_id", v.cosine(F.col("vec"), q).alias("score")).where(F.col("score") >= min_score)
    if exclude is not None:
        scored = scored.where(F.col("entity_id") != exclude)
    best = scored.groupBy("entity_id").agg(F.max("score").alias("score"))
    top = best.orderBy(F.desc("score"), F.asc("entity_id")).limit(top_k)
    return top.withColumn("score", F.round("score", 4))


def similar_to_entity(gallery: DataFrame, entities: DataFrame | None, entity_id: int, top_k: int = 10,
                      min_score: float = 0.5) -> DataFrame:
    """Entities close to one entity's first point, with their rows."""
    own = gallery.where(F.col("entity_id") == entity_id).agg(F.min_by("vec", "point_id")).first()[0]
    near = by_vector(gallery, own or [], top_k, min_score, exclude=entity_id)
    return near if entities is None else near.join(entities, "entity_id", "left")


# gates on gallery growth -----------------------------------------------------------------------


def update_gate(own: Column) -> Column:
    """May a matched tracklet's vector join its entity's gallery?"""
    m = MATCHING
    return (
        (F.col("max_overlap") <= m.update_max_overlap) & (F.col("overall") >= m.update_overall)
        & (F.col("v_avg") >= m.update_v) & (F.col("vector_consistency") >= m.update_consistency)
        & (F.col("entry_count") >= m.update_entries) & (own.isNull() | (own >= m.update_score)))


def aux_gate() -> Column:
    m = MATCHING
    return (
        (F.col("v_avg") >= m.aux_v) & (F.col("vector_consistency") >= m.aux_consistency)
        & (F.col("entry_count") >= m.aux_entries) & (F.col("max_overlap") <= m.aux_max_overlap)
        & ~F.coalesce("provisional", F.lit(False)))
