"""Every rule of the merge occurs; vetoes hold for what entities have become part of."""

import math

import pytest
from pyspark.sql import functions as F

from sightline.catalog import bridges, merging
from sightline.operators import similarity
from sightline.plans import merge

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def judged(spark):
    return bridges.judged(spark, SF).select("reason", "rejected", "method").distinct().collect()


def test_every_default_reason_occurs(judged):
    assert {name for name, _ in merging.RULES} <= {r.reason for r in judged}


def test_every_guard_that_can_be_reached_occurs(judged):
    """``no_survivor`` cannot: whatever gets past ``no_support`` has a survivor. Descriptors are tested with their own query."""
    assert {"low_score_bridge", "weak_reentry_bridge", "no_support", "weak_to_supported", "label_disagreement", "singleton_label_guard", "cooccurrence",
            "label_conflict"} <= {r.rejected for r in judged}


def test_every_method_occurs(judged):
    assert {"temporal_continuity_gallery_merge", "adjacent_fragment_gallery_merge", "occlusion_reentry_gallery_merge", "soft_split_gallery_merge",
            "same_label_singleton_gallery_merge", "singleton_reentry_gallery_merge", "weak_identity_gallery_merge"} <= {r.method for r in judged}


def three(spark):
    """Three entities in a row, each most like its neighbour."""
    angle = {1: 0.0, 2: 0.15, 3: 0.32}
    points = spark.createDataFrame([(e, e, [math.cos(a), math.sin(a)]) for e, a in angle.items()], "point_id long, entity_id long, vec array<double>")
    box = F.struct(*[F.lit(x).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), (10.0, 10.0, 60.0, 160.0))])
    rows = spark.createDataFrame([(f"{e}:{t}", e, "d", e * 100_000 + t * 1000, e * 100_000 + t * 1000 + 20, "matched") for e in angle for t in range(4)],
                                 "tracklet_id string, entity_id long, device_id string, frame_start long, frame_end long, state string")
    labels = spark.createDataFrame([], "entity_id long, started_at timestamp, task string, label string, confidence double")
    return merge.Tables(rows.withColumn("first_box", box).withColumn("last_box", box), labels, points, "kind")


def test_passes_go_on_until_nothing_merges(spark):
    got = {(r.source_id, r.target_id, r["pass"]) for r in merge.reconcile(three(spark)).collect()}
    assert len(got) == 2 and {p for _, _, p in got} == {1, 2} and len({t for _, t, _ in got}) == 1


def test_a_veto_holds_for_the_merged_group(spark):
    apart = spark.createDataFrame([(3, 1)], "entity_a long, entity_b long")
    got = [{r.source_id, r.target_id} for r in merge.reconcile(three(spark), cannot_link=apart).collect()]
    assert got == [{1, 2}]


def test_only_pairs_that_may_get_a_reason_are_judged(spark, monkeypatch):
    """Entities of many tracklets hand over all the time; no rule bridges them, so no features are worked out for them."""
    box = F.struct(*[F.lit(x).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), (10.0, 10.0, 60.0, 160.0))])
    rows = spark.createDataFrame([(f"{e}:{t}", e, "d", 1000 * t + 30 * e, 1000 * t + 30 * e + 20, "matched") for e in range(8) for t in range(12 if e < 6 else 1)],
                                 "tracklet_id string, entity_id long, device_id string, frame_start long, frame_end long, state string")
    labels = spark.createDataFrame([], "entity_id long, started_at timestamp, task string, label string, confidence double")
    turn = 2 * math.pi / 8
    points = spark.createDataFrame([(e, e, [math.cos(turn * e), math.sin(turn * e)]) for e in range(8)], "point_id long, entity_id long, vec array<double>")
    t = merge.Tables(rows.withColumn("first_box", box).withColumn("last_box", box), labels, points, "kind")
    seen, judged = [], merge.judged
    monkeypatch.setattr(merge, "judged", lambda pairs, *a: seen.append(sorted((r.entity_id, r.other_id) for r in pairs.collect())) or judged(pairs, *a))
    none = spark.createDataFrame([], "entity_a long, entity_b long")
    got = merge.spatial_splits(t, none)
    assert seen == [[(a, b) for a in range(8) for b in range(a + 1, 8) if b >= 6]]
    found = merge.temporal.nearby_pairs(t.tracklets, 240, 1.30)
    assert found.count() == 28
    scored = similarity.pair_similarity(found, points).selectExpr("entity_a AS entity_id", "entity_b AS other_id", "1 AS rank", "score", "double(null) AS runner_up")
    want = judged(scored, t).where("reason IS NOT NULL").select("entity_a", "entity_b", "reason").collect()
    assert sorted(got.select("entity_a", "entity_b", "reason").collect()) == sorted(want) and want


@pytest.mark.parametrize("optional", [False, True])
def test_no_rule_goes_beyond_what_may_bridge(spark, optional):
    """Features that fulfil every geometric rule: a reason needs the score and the tracklets all the same."""
    near = ", ".join(f"0.0 AS c_{n}, 1.0 AS s_{n}, 1.0 AS r_{n}, 0.0 AS bottom_{n}, gap AS gap_{n}" for n in merge.LIMITS)
    rows = spark.sql(f"""SELECT *, k / 20.0D AS score, {near} FROM (SELECT explode(sequence(0, 20)) AS k), (SELECT explode(sequence(0, 10)) AS n_a), (SELECT explode(array(0, 1, 2, 3, 9, 30)) AS n_b),
      (SELECT explode(array(0, 1, 2, 5, 10, 14, 40, 100, 200, 900)) AS gap), (SELECT explode(array(0.0D, 0.05D, 0.2D)) AS c), (SELECT 1.0D AS s, 1.0D AS r, 0.8D AS iou, 0.0D AS bottom, true AS edge,
      true AS bridge, true AS high, true AS scaled, true AS clothing, false AS both_stable, false AS opposed, 1 AS box_a, 1 AS box_b)""")
    rows = rows.withColumn("reason", merge.bridge_reason(optional)).withColumn("may", merge.may_bridge(optional))
    assert rows.where("reason IS NOT NULL AND NOT may").isEmpty() and not rows.where("reason IS NULL AND NOT may").isEmpty()
    assert rows.where("may AND n_a <= 8 AND n_b <= 8").groupBy("score").agg(F.count("reason").alias("n")).where("n = 0").isEmpty()
