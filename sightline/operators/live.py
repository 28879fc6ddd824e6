"""Live tracks: boxes of a device's frames are assigned to the tracks that are open, as they come.

A track moves on with a smoothed velocity, so that it is looked for where it should be after some frames without a box. Each frame
has three passes, in each the cheapest pair first: sure boxes with confirmed and lost tracks, faint boxes with tracks that were seen
in the frame before, the sure boxes that are left with tracks born then. A sure box that fits nothing begins a track, one without
a box for too long ends. The state of a device is its open tracks, whatever the number of frames.

Frames of a device have one order, so a device is one sorted stream; devices are spread.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from . import folds
from .tracks import BIRTH, BUFFER, COST_HIGH, COST_LOW, COST_NEW, HIGH, LOW

#: share of a newly seen velocity in the kept one
GAIN = 0.5
#: lost tracks that lie on a seen one by so much are the same
SAME_COST = 0.15
BORN, SEEN, LOST = "born", "seen", "lost"
PAIR_ROWS = 1024


class Box(NamedTuple):
    box_id: int
    score: float
    x1: float
    y1: float
    x2: float
    y2: float


class Track(NamedTuple):
    """``vx`` and ``vy`` are the centre's way per frame."""

    track_id: int
    state: str
    x1: float
    y1: float
    x2: float
    y2: float
    vx: float
    vy: float
    first_frame: int
    last_frame: int
    hits: int


def expected(t: Track, frame: int) -> tuple[float, float, float, float]:
    """Where a track should be in a frame."""
    dx, dy = t.vx * (frame - t.last_frame), t.vy * (frame - t.last_frame)
    return t.x1 + dx, t.y1 + dy, t.x2 + dx, t.y2 + dy


def _costs(left: list[tuple], right: list[tuple], limit: float, weights: list[float] | None = None) -> Iterator[tuple[float, int, int]]:
    """(cost, i, j) of pairs that cost at most ``limit``: one minus the overlap, which a box's score may weigh."""
    if not left or not right:
        return
    b = np.array(right, float)
    area_b = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    w = np.ones(len(b)) if weights is None else np.array(weights)
    for at in range(0, len(left), PAIR_ROWS):
        a = np.array(left[at:at + PAIR_ROWS], float)[:, None]
        inter = np.clip(np.minimum(a[..., 2], b[:, 2]) - np.maximum(a[..., 0], b[:, 0]), 0, None) * np.clip(
            np.minimum(a[..., 3], b[:, 3]) - np.maximum(a[..., 1], b[:, 1]), 0, None)
        union = (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1]) + area_b - inter
        cost = 1.0 - np.divide(inter, union, out=np.zeros_like(inter), where=union > 0) * w
        for i, j in zip(*np.nonzero(cost <= limit)):
            yield float(cost[i, j]), at + int(i), int(j)


def _assign(tracks: list[Track], boxes: list[Box], frame: int, limit: float, weighted: bool) -> list[tuple[int, int]]:
    """Pairs (track, box), the cheapest first; of equal ones the older track, then the smaller box id."""
    found = _costs([expected(t, frame) for t in tracks], [b[2:] for b in boxes], limit, [b.score for b in boxes] if weighted else None)
    used_t, used_b, out = set(), set(), []
    for _, _, _, i, j in sorted((round(c, 9), tracks[i].track_id, boxes[j].box_id, i, j) for c, i, j in found):
        if i not in used_t and j not in used_b:
            used_t.add(i)
            used_b.add(j)
            out.append((i, j))
    return out


def _moved(t: Track, b: Box, frame: int) -> Track:
    age = frame - t.last_frame
    vx, vy = (b.x1 + b.x2 - t.x1 - t.x2) / 2 / age, (b.y1 + b.y2 - t.y1 - t.y2) / 2 / age
    if t.hits > 1:
        vx, vy = t.vx + GAIN * (vx - t.vx), t.vy + GAIN * (vy - t.vy)
    return Track(t.track_id, SEEN, *b[2:], vx, vy, t.first_frame, frame, t.hits + 1)


def step(tracks: list[Track], frame: int, boxes: list[Box], buffer: int = BUFFER, first: bool = False) -> tuple[list[Track], list[tuple], list[tuple[Track, str]]]:
    """Open tracks after a frame, its (event, track, box) rows, and the tracks it closed with the reason."""
    boxes = list({b.box_id: b for b in sorted(boxes)}.values())
    closed = [(t, "aged") for t in tracks if frame - t.last_frame > buffer]
    tracks = [t for t in tracks if frame - t.last_frame <= buffer]
    sure = [b for b in boxes if b.score >= HIGH]
    faint = [b for b in boxes if LOW < b.score < HIGH]
    pool = [t for t in tracks if t.state != BORN]
    rows: list[tuple] = []
    done: list[Track] = []

    def match(candidates: list[Track], some: list[Box], limit: float, weighted: bool) -> tuple[list[Track], list[Box]]:
        pairs = _assign(candidates, some, frame, limit, weighted)
        for i, j in pairs:
            now = _moved(candidates[i], some[j], frame)
            rows.append(("found" if candidates[i].state == LOST else "seen", now, some[j]))
            done.append(now)
        used = {i for i, _ in pairs}, {j for _, j in pairs}
        return [t for i, t in enumerate(candidates) if i not in used[0]], [b for j, b in enumerate(some) if j not in used[1]]

    left, sure = match(pool, sure, COST_HIGH, True)
    missed, _ = match([t for t in left if t.state == SEEN], faint, COST_LOW, False)
    lost = [t for t in left if t.state == LOST] + [t._replace(state=LOST) for t in missed]
    unborn, sure = match([t for t in tracks if t.state == BORN], sure, COST_NEW, True)
    closed += [(t, "unconfirmed") for t in unborn]
    for b in sure:
        if b.score >= BIRTH:
            t = Track(b.box_id, SEEN if first else BORN, *b[2:], 0.0, 0.0, frame, frame, 1)
            rows.append(("born", t, b))
            done.append(t)
    same = {j for _, i, j in _costs([t[2:6] for t in done if t.state == SEEN], [expected(t, frame) for t in lost], SAME_COST)}
    closed += [(t, "same") for j, t in enumerate(lost) if j in same]
    return done + [t for j, t in enumerate(lost) if j not in same], rows, closed


class Keeper(folds.Keeper):
    """Tracks of one device. Result rows are a box's track (``born``, ``seen``, ``found`` again) and ``closed`` tracks with their last frame,
    number of boxes and reason."""

    ROW = "box_id long, score double, x1 double, y1 double, x2 double, y2 double"
    STATE = ("track_id long, state string, x1 double, y1 double, x2 double, y2 double, vx double, vy double, first_frame long, last_frame long, "
             "hits long")
    OUTPUT = "device_id string, event string, track_id long, box_id long, frame_no long, first_frame long, hits long, closed_by string"

    def __init__(self, device: str, open_: Iterable[tuple] = (), last_frame: int | None = None, buffer: int = BUFFER) -> None:
        super().__init__(device, (Track(*t) for t in open_), last_frame)
        self.buffer = buffer

    def take(self, frame: int, rows: list[tuple]) -> None:
        self.open, matched, closed = step(self.open, frame, [Box(*r) for r in rows], self.buffer, self.last_frame is None)
        self.out += [(self.device, e, t.track_id, b.box_id, frame, t.first_frame, t.hits, None) for e, t, b in matched]
        self._closed(closed)

    def end(self, why: str) -> None:
        self._closed([(t, why) for t in self.open])
        self.open = []

    def _closed(self, closed: list[tuple[Track, str]]) -> None:
        self.out += [(self.device, "closed", t.track_id, None, t.last_frame, t.first_frame, t.hits, why) for t, why in closed]


def keep(boxes: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """Tracks of all frames at once, to their end: rows of ``Keeper`` from (device_id, frame_no, box_id, score, x1, y1, x2, y2)."""
    return folds.fold(boxes, Keeper, buffer=buffer)
