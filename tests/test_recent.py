"""Last sightings of other entities, on chunks so small that they border everywhere."""

import pytest

from sightline.operators import temporal

ROWS = [(k, k * 7 % 5, k * 3 % 4, f"d{k % 2}", k // 3 if k < 90 else k, float(k), 0.0, float(k + 5), 9.0) for k in range(400)]
SHAPE = "row_id long, entity_id long, track_id long, device_id string, frame_no long, x1 double, y1 double, x2 double, y2 double"


def brute(window, strict):
    out = set()
    for q in ROWS:
        last = {}
        for o in ROWS:
            gap = q[4] - o[4]
            if o[3] == q[3] and o[1] != q[1] and (1 if strict else 0) <= gap <= window:
                last[o[1]] = min(last.get(o[1], gap), gap)
        out |= {(q[0], other, gap) for other, gap in last.items()}
    return out


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("window,chunk", [(3, 1), (20, 64)])
def test_recent_others_equal_brute_force(spark, monkeypatch, window, chunk, strict):
    monkeypatch.setattr(temporal, "CHUNK_WINDOWS", chunk)
    monkeypatch.setattr(temporal, "SWEPT_ROWS", 10)
    got = temporal.recent_others(spark.createDataFrame(ROWS, SHAPE), window, strict=strict).collect()
    assert {(r.row_id, r.other_id, r.gap) for r in got} == brute(window, strict) and len(got) == len({(r.row_id, r.other_id) for r in got})
