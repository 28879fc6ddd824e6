"""Live tracks against a frame-by-frame brute force, as one batch and as a stream with late rows."""

from collections import defaultdict

import pytest

from sightline.catalog import streams
from sightline.operators import live

SF = "/root/testdata/sf0.001"
COLUMNS = streams.LIVE


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def brute(rows, buffer=90):
    """Tracks as dictionaries, one pair at a time."""
    by = defaultdict(lambda: defaultdict(list))
    for device, frame, box, score, *xy in rows:
        by[device][frame].append((box, score, tuple(xy)))
    out = []
    for device, frames in by.items():
        tracks, n = {}, 0

        def place(t, frame):
            dx, dy = t["v"][0] * (frame - t["last"]), t["v"][1] * (frame - t["last"])
            x = t["xy"]
            return x[0] + dx, x[1] + dy, x[2] + dx, x[3] + dy

        def gone(t, why):
            out.append((device, "closed", t["id"], None, t["last"], t["first"], t["hits"], why))
            del tracks[t["id"]]

        for frame in sorted(frames):
            boxes = {b[0]: b for b in frames[frame]}
            for t in [t for t in tracks.values() if frame - t["last"] > buffer]:
                gone(t, "aged")
            open_, now = dict(tracks), {}
            passes = [
                (lambda t: t["state"] != "born", lambda b: b[1] >= 0.7, 0.3, True),
                (lambda t: t["state"] == "seen", lambda b: 0.35 < b[1] < 0.7, 0.5, False),
                (lambda t: t["state"] == "born", lambda b: b[1] >= 0.7, 0.7, True)]
            for want, fits, limit, weigh in passes:
                pairs = []
                for t in open_.values():
                    for b in boxes.values():
                        if want(t) and fits(b):
                            cost = 1 - overlap(place(t, frame), b[2]) * (b[1] if weigh else 1)
                            if cost <= limit:
                                pairs.append((round(cost, 9), t["id"], b[0]))
                for _, tid, bid in sorted(pairs):
                    if tid in open_ and bid in boxes:
                        t, b = open_.pop(tid), boxes.pop(bid)
                        age = frame - t["last"]
                        way = [(sum(b[2][k::2]) - sum(t["xy"][k::2])) / 2 / age for k in (0, 1)]
                        v = way if t["hits"] == 1 else [o + 0.5 * (w - o) for o, w in zip(t["v"], way)]
                        event = "found" if t["state"] == "lost" else "seen"
                        t.update(xy=b[2], v=v, last=frame, hits=t["hits"] + 1, state="seen")
                        now[tid] = t
                        out.append((device, event, tid, bid, frame, t["first"], t["hits"], None))
            for t in list(open_.values()):
                if t["state"] == "born":
                    gone(t, "unconfirmed")
                    del open_[t["id"]]
                else:
                    t["state"] = "lost"
            for b in sorted(b for b in boxes.values() if b[1] >= 0.82):
                t = dict(id=b[0], xy=b[2], v=[0, 0], first=frame, last=frame, hits=1, state="born" if n else "seen")
                tracks[b[0]] = now[b[0]] = t
                out.append((device, "born", b[0], b[0], frame, frame, 1, None))
            for t in list(open_.values()):
                if any(1 - overlap(s["xy"], place(t, frame)) <= 0.15 for s in now.values() if s["state"] == "seen"):
                    gone(t, "same")
            n += 1
        for t in list(tracks.values()):
            gone(t, "end")
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def expected(spark):
    rows = streams.live_boxes(spark, SF).select("device_id", "frame_no", "box_id", "score", "x1", "y1", "x2", "y2").collect()
    return brute([tuple(r) for r in rows])


def test_batch_equals_brute_force(spark, expected):
    from sightline import catalog

    got = plain(catalog.load()[0]["live_tracks"](spark, SF))
    assert got == expected
    events = {r[1] for r in got}
    assert events == {"born", "seen", "found", "closed"}
    assert {"unconfirmed", "same", "end"} <= {r[7] for r in got}


def test_stream_equals_batch_and_leaves_nothing_open(spark, expected):
    from sightline import catalog

    got = plain(catalog.load()[0]["stream_live_tracks"](spark, SF))
    assert got == expected
    assert sum(r[1] == "born" for r in got) == sum(r[1] == "closed" for r in got)


def test_a_moving_track_is_found_where_it_should_be():
    """Five pixels a frame; after seven frames without a box it is 40 pixels further, too far from its last box."""
    keeper = live.Keeper("d")
    for f in [*range(5), 12]:
        keeper.frame(f, [live.Box(100 + f, 0.95, 5.0 * f, 0.0, 5.0 * f + 60, 100.0)])
    keeper.frame(13, [live.Box(200, 0.95, 5.0 * 13, 0.0, 5.0 * 13 + 60, 100.0)])
    assert {r[2] for r in keeper.out} == {100}


def test_tracks_age_like_the_brute_force():
    rows = [("d", f, 10 * f + k, 0.95, 300.0 * k + f, 0.0, 300.0 * k + f + 60, 100.0) for f in [*range(4), 60, 93, 94, 150, 151] for k in range(3) if k or f < 60]
    keeper = live.Keeper("d")
    for f in sorted({r[1] for r in rows}):
        keeper.frame(f, [live.Box(*r[2:]) for r in rows if r[1] == f])
    keeper.end("end")
    assert sorted(keeper.out, key=repr) == brute(rows)
    assert "aged" in {r[7] for r in keeper.out}


def test_old_frames_repeated_boxes_and_a_crowd():
    keeper = live.Keeper("d")
    box = live.Box(1, 0.9, 0.0, 0.0, 10.0, 10.0)
    keeper.frame(5, [box, box])
    keeper.frame(5, [live.Box(2, 0.9, 0.0, 0.0, 10.0, 10.0)])
    keeper.frame(4, [live.Box(3, 0.9, 0.0, 0.0, 10.0, 10.0)])
    assert [r[3] for r in keeper.out] == [1]
    crowd = [live.Box(k, 0.9, 20.0 * (k % 70), 20.0 * (k // 70), 20.0 * (k % 70) + 15, 20.0 * (k // 70) + 15) for k in range(3000)]
    keeper = live.Keeper("d")
    keeper.frame(0, crowd)
    keeper.frame(1, [b._replace(box_id=b.box_id + 10000, x1=b.x1 + 1, x2=b.x2 + 1) for b in crowd])
    assert all(r[3] == r[2] + 10000 for r in keeper.out if r[1] == "seen") and len(keeper.out) == 6000


def test_no_boxes(spark):
    none = spark.createDataFrame([], "device_id string, frame_no long, box_id long, score double, x1 double, y1 double, x2 double, y2 double")
    assert live.keep(none).count() == 0
