"""Clusters and fragment chains against brute force, as one batch and as a stream with late rows."""

from collections import defaultdict

import numpy as np
import pytest

from sightline import catalog
from sightline.catalog import streams
from sightline.operators import evidence, folds
from sightline.plans import resolve

SF = "/root/testdata/sf0.001"


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def centre(b):
    return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2])


def overall(members):
    size, move = [], []
    for p, q in zip(members, members[1:]):
        a, b = (max((r["xy"][2] - r["xy"][0]) * (r["xy"][3] - r["xy"][1]), 1) for r in (p, q))
        size.append(abs(b - a) / a)
        move.append(np.linalg.norm(centre(q["xy"]) - centre(p["xy"])) / max(q["xy"][2] - q["xy"][0], q["xy"][3] - q["xy"][1], 1))
    still = 1 - (np.mean(size) if size else 0)
    held = 1 - (np.mean(move) if move else 0) / 0.5
    good = np.mean([r["v"] >= evidence.TRACKLETS.good_frame for r in members])
    return round(float(np.clip(still, 0, 1) * 0.35 + np.clip(held, 0, 1) * 0.35 + good * 0.3), 4)


def told(device, event, members, box, tier):
    """A result row from all rows of a cluster."""
    v, c, u = ([r[k] for r in members] for k in ("v", "c", "u"))
    facts = [np.mean(v), max(v), overall(members), np.mean(c), max(c), min(u), max(u)] if event != "entry" else [None] * 7
    return (device, event, members[0]["id"], box, members[-1]["frame"], members[0]["frame"], len(members), *facts, tier)


def brute_clusters(rows):
    out = []
    by = defaultdict(lambda: defaultdict(list))
    for r in rows:
        by[r["device"]][r["frame"]].append(r)
    for device, frames in by.items():
        open_ = []  # lists of rows, and the tier
        for frame in sorted(frames):
            for c in [c for c in open_ if frame - c[0][-1]["frame"] > 36]:
                out.append(told(device, "closed" if c[1] else "flushed", c[0], None, c[1]))
                open_.remove(c)
            pairs = []
            for r in frames[frame]:
                for c in open_:
                    m = c[0]
                    far = np.linalg.norm(centre(r["xy"]) - centre(m[-1]["xy"])) / max(r["xy"][3] - r["xy"][1], m[-1]["xy"][3] - m[-1]["xy"][1], 1)
                    seen = [q["vec"] for q in m if q["vec"] is not None and q["v"] >= 0.55]
                    alike = r["v"] < 0.55 or r["vec"] is None or not seen or cosine(r["vec"], np.sum(seen, axis=0)) >= 0.62
                    if far <= 0.95 and alike:
                        pairs.append((round(far + (frame - m[-1]["frame"]) / 60, 9), m[0]["id"], r["id"], c, r))
            free, waiting = [c for c in open_], sorted(frames[frame], key=lambda r: r["id"])
            grown = []
            for _, _, _, c, r in sorted(pairs, key=lambda p: p[:3]):
                if any(c is x for x in free) and any(r is x for x in waiting):
                    free = [x for x in free if x is not c]
                    waiting = [x for x in waiting if x is not r]
                    c[0].append(r)
                    grown.append(c)
            for r in waiting:
                c = [[r], None]
                open_.append(c)
                grown.append(c)
            for c in grown:
                m = c[0]
                out.append(told(device, "entry", m, m[-1]["id"], c[1]))
                top = max(r["v"] for r in m)
                if c[1] is None and (len(m) >= 6 and top >= 0.65 or len(m) >= 5 and top >= 0.85 and overall(m) >= 0.83):
                    c[1] = "slow" if len(m) >= 6 and top >= 0.65 else "fast"
                    out.append(told(device, "promoted", m, m[-1]["id"], c[1]))
        for c in open_:
            out.append(told(device, "closed" if c[1] else "flushed", c[0], None, c[1]))
    return out


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def got(spark, name, columns):
    return rounded(tuple(r) for r in catalog.load()[0][name](spark, SF).select(*columns).collect())


@pytest.fixture(scope="module")
def clusters(spark):
    rows = [dict(device=r.device_id, frame=r.frame_no, id=r.box_id, v=r.v_score, c=r.confidence, u=r.nearest_iou, xy=(r.x1, r.y1, r.x2, r.y2), vec=r.vec)
            for r in streams.loose_boxes(spark, SF).collect()]
    return rounded(brute_clusters(rows))


def test_clusters_equal_brute_force(spark, clusters):
    rows = got(spark, "live_clusters", streams.CLUSTERED)
    assert rows == clusters
    assert {r[1] for r in rows} == {"entry", "promoted", "flushed", "closed"}


def test_stream_of_clusters_equals_batch(spark, clusters):
    assert got(spark, "stream_live_clusters", streams.CLUSTERED) == clusters


def test_fast_tier_and_vectors():
    k = evidence.Clusters("d")
    for f in range(5):
        k.frame(f, [(10 + f, 0.9, 0.5, 0.1, 0.0, 0.0, 60.0, 150.0, [1.0, float(f % 2)])])
    k.frame(5, [(30, 0.9, 0.5, 0.1, 0.0, 0.0, 60.0, 150.0, [0.0, -1.0])])
    promoted = [r for r in k.out if r[1] == "promoted"]
    assert [(r[2], r[6], r[14]) for r in promoted] == [(10, 5, "fast")]
    assert np.allclose(promoted[0][15], np.array([5, 2]) / np.sqrt(29))
    assert {r[2] for r in k.out} == {10, 30}  # the unlike box begins a cluster


def brute_chains(rows):
    out = []
    by = defaultdict(list)
    for r in rows:
        by[r["device"]].append(r)
    for device, some in by.items():
        chains = []

        def say(event, c, r):
            n = sum(x["n"] for x in c)
            out.append((device, event, c[0]["id"], r and r["id"], r["frame"] if r else max(x["end"] for x in c), min(x["frame"] for x in c), len(c), n,
                        sum(x["v"] * x["n"] for x in c) / n))

        for r in sorted(some, key=lambda r: (r["frame"], r["id"])):
            for c in [c for c in chains if r["frame"] - max(x["end"] for x in c) > 180]:
                say("dropped", c, None)
                chains.remove(c)
            if r["v"] < 0.72:
                out.append((device, "faint", None, r["id"], r["frame"], r["frame"], 1, r["n"], r["v"]))
                continue
            best, found = None, None
            for c in chains:
                vec = np.zeros(len(r["vec"]))
                for k, x in enumerate(c):  # the mean is scaled to length one after each step
                    vec = vec * sum(y["n"] for y in c[:k]) + np.array(x["vec"]) / np.linalg.norm(x["vec"]) * x["n"]
                    vec /= np.linalg.norm(vec)
                xy = c[-1]["xy"]
                far = np.linalg.norm(centre(r["xy"]) - centre(xy)) / max(r["xy"][2] - r["xy"][0], r["xy"][3] - r["xy"][1], xy[2] - xy[0], xy[3] - xy[1], 1)
                alike = cosine(r["vec"], vec)
                if r["frame"] >= max(x["end"] for x in c) and alike >= 0.62 and far <= 1.8:
                    score = (-round(alike - 0.05 * far, 9), c[0]["id"])
                    if best is None or score < best:
                        best, found = score, c
            if found is None:
                found = [r]
                chains.append(found)
            elif r["track"] in {x["track"] for x in found}:
                say("repeated", found, r)
                continue
            else:
                found.append(r)
            if len(found) >= 2 and sum(x["n"] for x in found) >= 5:
                say("promoted", found, r)
                chains.remove(found)
            else:
                say("waiting", found, r)
        for c in chains:
            say("dropped", c, None)
    return rounded(out)


@pytest.fixture(scope="module")
def chains(spark):
    rows = [dict(device=r.device_id, frame=r.frame_no, id=r.box_id, track=r.track_id, end=r.frame_end, n=r.entry_count, v=r.v_avg, xy=(r.x1, r.y1, r.x2, r.y2), vec=r.vec)
            for r in streams.short_fragments(spark, SF).collect()]
    return brute_chains(rows)


def test_fragments_equal_brute_force(spark, chains):
    rows = got(spark, "short_fragments", streams.CHAINED)
    assert rows == chains
    assert {"faint", "waiting", "promoted", "dropped"} <= {r[1] for r in rows}


def test_stream_of_fragments_equals_batch(spark, chains):
    assert got(spark, "stream_short_fragments", streams.CHAINED) == chains


def test_a_track_counts_once_in_a_chain():
    k = evidence.Fragments("d")
    for f, track in ((0, 1), (5, 1), (9, 2)):
        k.frame(f, [(f, track, f + 1, 3, 0.9, 0.0, 0.0, 60.0, 150.0, [1.0, 0.0])])
    assert [r[1] for r in k.out] == ["waiting", "repeated", "promoted"]
    assert not k.open


def test_promoted_chains_like_a_known_entity_are_deferred(spark):
    shape = "chain_id long, vec array<double>"
    promoted = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.6, 0.8, 0.0])], shape)
    gallery = spark.createDataFrame([(10, 7, [1.0, 0.0, 0.0]), (11, 8, [0.0, 0.0, 1.0])], "point_id long, entity_id long, vec array<double>")
    out = {r.chain_id: (r.method, r.suggested_id) for r in resolve.recovered(promoted, gallery).collect()}
    assert out == {1: ("fragment_recovery_deferred_near_gallery", 7), 2: ("new_identity", None), 3: ("fragment_recovery_deferred_near_gallery", 7)}


def test_no_rows(spark):
    for keeper in (evidence.Clusters, evidence.Fragments):
        none = spark.createDataFrame([], f"device_id string, frame_no long, {keeper.ROW}")
        assert folds.fold(none, keeper).count() == 0


def test_a_fragment_meets_all_open_chains_at_once(monkeypatch):
    """No call for each pair of a fragment and an open chain: with hundreds open they took the time."""
    monkeypatch.setattr(evidence, "_cosine", None)
    keeper = evidence.Fragments("dev")
    vectors = np.eye(8)
    for frame in range(4):
        keeper.frame(frame, [(frame * 8 + k, frame, frame, 1, 0.9, 10.0 * k, 0.0, 10.0 * k + 60, 150.0, vectors[k].tolist()) for k in range(8)])
    keeper.end("end")
    chains = {}
    for row in keeper.out:
        chains.setdefault(row[2], []).append(row[3])
    assert sorted(c for c in chains) == list(range(8)) and all([b for b in boxes if b is not None] == [c, c + 8, c + 16, c + 24] for c, boxes in chains.items())
