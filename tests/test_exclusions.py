"""Who met whom, on chunks so small that tracklets cross them, and what becomes of the answers."""

import random

import pytest

from sightline.operators import temporal
from sightline.plans import exclusions

R = random.Random(5)
TRACKLETS = [(f"t{k}", R.randrange(12), f"d{k % 2}", s, s + R.choice([0, 1, 5, 40]), R.choice(["a", "b", None]), R.choice(["a", "b", None]))
             for k, s in enumerate(R.randrange(-20, 300) for _ in range(150))]
# an entity has one label
HELD = {e: h for _, e, _, _, _, _, h in TRACKLETS}
TRACKLETS = [(*t[:6], HELD[t[1]]) for t in TRACKLETS]
SHAPE = "tracklet_id string, entity_id long, device_id string, frame_start long, frame_end long, asks string, holds string"
SEEN = "row_id long, entity_id long, track_id long, device_id string, frame_no long, x1 double, y1 double, x2 double, y2 double"


def met(near):
    return sorted({(t[0], u[1]) for t in TRACKLETS for u in TRACKLETS if t[2] == u[2] and t[1] != u[1] and t[5] and u[6] and t[5] != u[6]
                   and t[3] - near <= u[4] and u[3] <= t[4] + near})


@pytest.mark.parametrize("near,chunk", [(3, 1), (3, 4), (25, 1), (10, 64)])
def test_met_within_equals_brute_force_and_gives_pairs_once(spark, monkeypatch, near, chunk):
    monkeypatch.setattr(temporal, "CHUNK_WINDOWS", chunk)
    monkeypatch.setattr(temporal, "SWEPT_ROWS", 10)
    got = temporal.met_within(spark.createDataFrame(TRACKLETS, SHAPE), near).collect()
    assert sorted((r.tracklet_id, r.entity_id) for r in got) == met(near)


def test_neighbours_are_met_whatever_their_label(spark):
    got = exclusions.neighbours(spark.createDataFrame(TRACKLETS, SHAPE).drop("asks", "holds"), 7).collect()
    assert sorted((r.tracklet_id, r.entity_id) for r in got) == sorted({
        (t[0], u[1]) for t in TRACKLETS for u in TRACKLETS if t[2] == u[2] and t[1] != u[1] and t[3] - 7 <= u[4] and u[3] <= t[4] + 7})


def test_only_first_rows_ask_and_their_answers_are_not_moved(spark):
    rows = [(k, k % 3, k % 4, "d", k, float(k % 5 * 100), 0.0, float(k % 5 * 100 + 10), 10.0) for k in range(60)]
    starts = spark.createDataFrame([("p", 20, 2), ("q", 50, None)], "tracklet_id string, row_id long, current_id long")
    forbidden = spark.createDataFrame([("p", 9)], "tracklet_id string, entity_id long")
    out = exclusions.found(starts, spark.createDataFrame(rows, SEEN), forbidden, 4, 2)
    # at row 20 entities 0 and 1 were seen at rows 18 and 19, at row 50 at 48 and 49
    assert sorted(map(tuple, out.collect())) == [
        ("p", 0, "blocked"), ("p", 0, "recent"), ("p", 1, "blocked"), ("p", 1, "recent"), ("p", 9, "forbidden"),
        ("q", 0, "blocked"), ("q", 0, "recent"), ("q", 1, "blocked"), ("q", 1, "recent")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")] and "Join" not in plan[:plan.index("MapInArrow")]
