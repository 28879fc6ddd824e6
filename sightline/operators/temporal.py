"""Joins in time: recent sightings, and the nearest approach of two entities.

Rows are bucketed by time or frame so that only neighbours meet. Pair questions
are asked for given candidate pairs, never for all pairs of entities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MATCHING, MERGING
from ..functions import geometry as g
from ..lineage import cut
from . import ordered

BUCKET = 4096
#: windows in a chunk of the sweep for recent sightings
CHUNK_WINDOWS = 64
#: rows of its answer that are given out at a time
SWEPT_ROWS = 1 << 16


# recent sightings of other entities -----------------------------------------------------------


def recent_others(rows: DataFrame, window: int, axis: str = "frame_no", strict: bool = True, asks: Column | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Per row and other entity of the device its last sighting within ``window``
    before the row. Rows carry row_id, entity_id, track_id, device_id and a box. Only rows that fulfil ``asks`` are asked for; ``keep``: more
    columns of theirs.

    A device's axis is cut into chunks of many windows; a chunk also gets the rows of the window before it. Each is swept once in order, with
    the last sighting of every entity at hand, so nothing but the answer is ever a row. Rows at the same place see each other
    only if not ``strict``.
    """
    span = window * CHUNK_WINDOWS
    own = F.floor(F.col(axis) / span)
    tail = F.floor((F.col(axis) + window) / span)
    cols = ["row_id", "entity_id", "track_id", "x1", "y1", "x2", "y2", *keep]
    # at one place questions come before sightings, or after them
    turns = F.array(F.struct(F.lit(True).alias("asks"), F.lit(0 if strict else 1).alias("turn"), own.alias("chunk")),
                    F.struct(F.lit(False).alias("asks"), F.lit(1 if strict else 0).alias("turn"), own.alias("chunk")),
                    F.struct(F.lit(False).alias("asks"), F.lit(0).alias("turn"), tail.alias("chunk")))
    turns = F.when(tail > own, turns).otherwise(F.slice(turns, 1, 2))
    if asks is not None:
        turns = F.when(F.coalesce(asks, F.lit(False)), turns).otherwise(F.slice(turns, F.lit(2), F.size(turns) - 1))
    placed = rows.select("device_id", *cols, F.col(axis).alias("_at"), F.explode(turns).alias("_p")).select(
        "device_id", *cols, "_at", F.col("_p.asks").alias("_asks"), F.col("_p.turn").alias("_turn"), F.col("_p.chunk").alias("_chunk"))
    stream = placed.repartition("device_id", "_chunk").sortWithinPartitions("device_id", "_chunk", "_at", "_turn", "row_id")
    kind = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    fields = ", ".join(f"`{c}` {kind[c]}" for c in cols)
    fields += f", other_id {kind['entity_id']}, other_track {kind['track_id']}, o_x1 double, o_y1 double, o_x2 double, o_y2 double, gap {kind['_at']}"

    def answers(batch: pa.RecordBatch, ask: list[np.ndarray], hit: list[tuple]) -> pa.RecordBatch:
        index, parts = np.concatenate(ask), [np.concatenate(c) for c in zip(*hit)]
        taken = batch.take(pa.array(index))
        gap = batch.column("_at").to_numpy()[index] - parts[2]
        return pa.RecordBatch.from_arrays(
            [*(taken.column(c) for c in cols), pa.array(parts[0].tolist(), batch.schema.field("entity_id").type), pa.array(parts[1].tolist(), batch.schema.field("track_id").type),
             *(pa.array(parts[3][:, k]) for k in range(4)), pa.array(gap.tolist(), batch.schema.field("_at").type)],
            [*cols, "other_id", "other_track", "o_x1", "o_y1", "o_x2", "o_y2", "gap"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, now = _LastSeen(window), None
        for batch in batches:
            ask, hit, n = [], [], 0
            device, chunk, asks, at, entity, track = (batch.column(c).to_pylist() for c in ("device_id", "_chunk", "_asks", "_at", "entity_id", "track_id"))
            box = np.stack([batch.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1).astype(float)
            for i in range(batch.num_rows):
                if (device[i], chunk[i]) != now:
                    now = (device[i], chunk[i])
                    seen = _LastSeen(window)
                if not asks[i]:
                    seen.add(at[i], entity[i], track[i], box[i])
                else:
                    found = seen.others(at[i], entity[i])
                    ask.append(np.full(len(found[0]), i))
                    hit.append(found)
                    n += len(found[0])
                if n > SWEPT_ROWS:
                    yield answers(batch, ask, hit)
                    ask, hit, n = [], [], 0
            if ask:
                yield answers(batch, ask, hit)

    return stream.mapInArrow(sweep, fields)


class _LastSeen:
    """The last sighting of each entity, as arrays that forget what the window has left behind."""

    def __init__(self, window: int) -> None:
        self.window, self.slot = window, {}
        self.entity, self.track = np.empty(64, object), np.empty(64, object)
        self.at, self.box = np.zeros(64, np.int64), np.zeros((64, 4))

    def add(self, at: int, entity, track, box: np.ndarray) -> None:
        k = self.slot.get(entity)
        if k is None:
            if len(self.slot) == len(self.at):
                self._shrink(at)
            k = self.slot[entity] = len(self.slot)
        self.entity[k], self.track[k], self.at[k], self.box[k] = entity, track, at, box

    def _shrink(self, at: int) -> None:
        """Drop what is out of reach; grow if most is not."""
        live = np.flatnonzero(self.at[:len(self.slot)] >= at - self.window)
        size = max(64, 2 * len(live))
        for name in ("entity", "track", "at", "box"):
            old = getattr(self, name)
            new = np.zeros((size, *old.shape[1:]), old.dtype)
            new[:len(live)] = old[live]
            setattr(self, name, new)
        self.slot = {e: k for k, e in enumerate(self.entity[:len(live)])}

    def others(self, at: int, entity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.slot)
        near = self.at[:n] >= at - self.window
        k = self.slot.get(entity)
        if k is not None:
            near[k] = False
        return self.entity[:n][near], self.track[:n][near], self.at[:n][near], self.box[:n][near]


def _pair() -> tuple[g.Box, g.Box]:
    return g.box(), g.box("o_")


def entity_hint(recent: DataFrame) -> DataFrame:
    """Best recent entity to reuse: overlapping or close, score = IoU less a tenth of the distance."""
    a, b = _pair()
    near = (g.iou(a, b) >= MATCHING.reuse_iou) | (g.centre_ratio(a, b) <= MATCHING.reuse_centre)
    score = g.iou(a, b) - g.centre_ratio(a, b) * 0.1
    best = F.struct(score.alias("s"), (-F.col("other_id")).alias("i"))
    return recent.where(near).groupBy("row_id").agg(F.max_by("other_id", best).alias("hint_id"), F.max(score).alias("score"))


def _elsewhere() -> Column:
    a, b = _pair()
    return (g.iou(a, b) < MATCHING.recent_iou) & (g.centre_ratio(a, b) > MATCHING.recent_centre)


def _coincides() -> Column:
    a, b = _pair()
    return g.iou(a, b) >= MATCHING.duplicate_iou


def recently_elsewhere(recent: DataFrame) -> DataFrame:
    """Entities seen just now at a place this row cannot be."""
    return recent.where(_elsewhere()).select("row_id", "other_id")


def co_active(recent: DataFrame) -> DataFrame:
    """Entities still live on another track."""
    return recent.where(F.col("other_track") != F.col("track_id")).select("row_id", "other_id")


def duplicate_suspects(recent: DataFrame) -> DataFrame:
    """Blocked entities whose box coincides with the row's: probably one thing tracked twice."""
    return recent.where(_coincides()).select("row_id", "other_id")


def exclusion_reasons(recent: DataFrame, live: int) -> DataFrame:
    """``recent_others`` over the long window with a row for each ``reason``: ``recent`` elsewhere, and of sightings within ``live``
    ``blocked`` on another track and ``duplicate``."""
    now = F.col("gap") <= live
    reasons = F.array(F.when(_elsewhere(), "recent"), F.when(now & (F.col("other_track") != F.col("track_id")), "blocked"), F.when(now & _coincides(), "duplicate"))
    return recent.withColumn("reason", F.explode(F.filter(reasons, lambda r: r.isNotNull())))


def met_within(rows: DataFrame, near: int) -> DataFrame:
    """(tracklet_id, entity_id): other entities that a tracklet's device saw within ``near`` frames of it and whose label differs, each pair once.
    Rows carry tracklet_id, entity_id, device_id, frame_start, frame_end, ``asks``, the tracklet's label (null: it isn't asked for), and
    ``holds``, its entity's label (null: it is nobody's answer).

    A device's axis is cut into chunks of many windows, and a tracklet is in each that it touches. A chunk is swept once in order, with the
    latest end of every entity at hand: at the end of a tracklet's window all that began before it are known, and those that ended after its
    begin were met. A tracklet of several chunks leaves out in the later ones whom it met in an earlier one: there an entity also has the
    latest end of what began before the chunk. So nothing but the answer is ever a row.
    """
    span = near * CHUNK_WINDOWS

    def chunks(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / span), F.floor(last / span)))

    rows = cut(rows.select("tracklet_id", "entity_id", "device_id", "frame_start", "frame_end", "asks", "holds"))
    since, until = F.col("frame_start") - near, F.col("frame_end") + near
    there = rows.where("holds IS NOT NULL").withColumn("_chunk", chunks(F.col("frame_start"), F.col("frame_end")))
    # a row per chunk and entity
    ends = there.groupBy("device_id", "entity_id", "_chunk").agg(F.max("frame_end").alias("_end"))
    earlier = Window.partitionBy("device_id", "entity_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.max("_end").over(earlier)).drop("_end")
    none = F.lit(None)
    there = there.join(ends, ["device_id", "entity_id", "_chunk"]).select(
        none.cast(rows.schema["tracklet_id"].dataType).alias("tracklet_id"), "entity_id", "device_id", "_chunk", F.col("frame_start").alias("_at"), F.lit(0).alias("_turn"),
        F.col("holds").alias("_label"), F.col("frame_end").alias("_reach"), "_before", F.lit(False).alias("_again"))
    asked = rows.where("asks IS NOT NULL").withColumn("_chunk", chunks(since, until)).select(
        "tracklet_id", "entity_id", "device_id", "_chunk", F.least(until, (F.col("_chunk") + 1) * span - 1).alias("_at"), F.lit(1).alias("_turn"),
        F.col("asks").alias("_label"), since.alias("_reach"), none.cast("long").alias("_before"), (F.col("_chunk") > F.floor(since / span)).alias("_again"))
    placed = there.unionByName(asked)
    stream = placed.repartition("device_id", "_chunk").sortWithinPartitions("device_id", "_chunk", "_at", "_turn")
    kind = {f.name: f.dataType.simpleString() for f in placed.schema.fields}

    def answers(batch: pa.RecordBatch, ask: list[np.ndarray], hit: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("tracklet_id").take(pa.array(np.concatenate(ask))), pa.array(np.concatenate(hit).tolist(), batch.schema.field("entity_id").type)],
            ["tracklet_id", "entity_id"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, now, codes = _Ends(), None, {}
        for batch in batches:
            ask, hit, n = [], [], 0
            columns = (batch.column(c).to_pylist() for c in ("device_id", "_chunk", "_turn", "entity_id", "_label", "_reach", "_before", "_again"))
            for i, (device, chunk, turn, entity, label, reach, before, again) in enumerate(zip(*columns)):
                if (device, chunk) != now:
                    now = (device, chunk)
                    seen = _Ends()
                code = codes.setdefault(label, len(codes))
                if not turn:
                    seen.add(entity, code, reach, before)
                    continue
                found = seen.met(entity, code, reach, again)
                if len(found):
                    ask.append(np.full(len(found), i))
                    hit.append(found)
                    n += len(found)
                if n > SWEPT_ROWS:
                    yield answers(batch, ask, hit)
                    ask, hit, n = [], [], 0
            if ask:
                yield answers(batch, ask, hit)

    return stream.mapInArrow(sweep, f"tracklet_id {kind['tracklet_id']}, entity_id {kind['entity_id']}")


class _Ends:
    """The latest end of each entity of a chunk, its label, and the latest end of what began before the chunk."""

    NEVER = np.iinfo(np.int64).min

    def __init__(self) -> None:
        self.slot = {}
        self.entity = np.empty(64, object)
        self.end, self.before, self.code = (np.zeros(64, np.int64) for _ in range(3))

    def add(self, entity, code: int, end: int, before: int | None) -> None:
        k = self.slot.get(entity)
        if k is not None:
            self.end[k] = max(self.end[k], end)
            return
        k = self.slot[entity] = len(self.slot)
        if k == len(self.end):
            for name in ("entity", "end", "before", "code"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(len(old), old.dtype)]))
        self.entity[k], self.end[k], self.before[k], self.code[k] = entity, end, self.NEVER if before is None else before, code

    def met(self, entity, code: int, since: int, again: bool) -> np.ndarray:
        n = len(self.slot)
        near = (self.end[:n] >= since) & (self.code[:n] != code)
        if again:
            near &= self.before[:n] < since
        k = self.slot.get(entity)
        if k is not None:
            near[k] = False
        return self.entity[:n][near]


def never_together(boxes: DataFrame, min_frames: int = 1) -> DataFrame:
    """Tracks visible apart in one frame: they cannot be one entity. Frames of a
    device hold few boxes; sentinel frames below zero are left out."""
    cols = ["track_id", "x1", "y1", "x2", "y2"]
    real = boxes.where(F.col("frame_no") >= 0)
    a = real.select("device_id", "frame_no", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = real.select("device_id", "frame_no", *[F.col(c).alias(f"b_{c}") for c in cols])
    p, q = g.box("a_"), g.box("b_")
    apart = (g.iou(p, q) <= MATCHING.distinct_iou) & (g.centre_ratio(p, q) >= MATCHING.distinct_centre)
    met = a.join(b, ["device_id", "frame_no"]).where((F.col("a_track_id") < F.col("b_track_id")) & apart)
    per = met.groupBy("device_id", F.col("a_track_id").alias("track_a"), F.col("b_track_id").alias("track_b"))
    return per.agg(F.count(F.lit(1)).alias("shared_frames")).where(F.col("shared_frames") >= min_frames)


# pairs of entities ------------------------------------------------------------------------------


def _side(pairs: DataFrame, tracklets: DataFrame, side: str) -> DataFrame:
    cols = ["device_id", "tracklet_id", "frame_start", "frame_end", "first_box", "last_box"]
    named = tracklets.select(F.col("entity_id").alias(f"entity_{side}"), "device_id",
                             *[F.col(c).alias(f"{side}_{c}") for c in cols[1:]])
    return pairs.select("entity_a", "entity_b").join(named, f"entity_{side}")


def min_gaps(pairs: DataFrame, tracklets: DataFrame, span: int = ordered.SPAN) -> DataFrame:
    """Smallest frame gap of each pair on a shared device, 0 where ranges meet.

    One sweep in start order: the gap before a tracklet is its start less the
    latest end of the other side so far. No tracklet pairs are formed.
    """
    sides = []
    for side, flag in (("a", 0), ("b", 1)):
        s = _side(pairs, tracklets, side)
        sides.append(s.select("entity_a", "entity_b", "device_id", F.lit(flag).alias("side"),
                              F.col(f"{side}_frame_start").alias("start"), F.col(f"{side}_frame_end").alias("end"),
                              F.col(f"{side}_tracklet_id").alias("tracklet_id")))
    events = sides[0].unionByName(sides[1])
    keys = ["entity_a", "entity_b", "device_id"]
    swept = ordered.with_running(events, keys, ["start", "side", "tracklet_id"], span=span, maxima={
        "_a": F.when(F.col("side") == 0, F.col("end")), "_b": F.when(F.col("side") == 1, F.col("end"))})
    other = F.when(F.col("side") == 0, F.col("_b")).otherwise(F.col("_a"))
    gap = F.greatest(F.col("start") - other, F.lit(0))
    return swept.groupBy("entity_a", "entity_b").agg(
        F.min(F.when(other.isNotNull(), gap)).alias("gap")).where(F.col("gap").isNotNull())


def cooccurring(gaps: DataFrame) -> DataFrame:
    return gaps.where(F.col("gap") == 0).select("entity_a", "entity_b")


def _meeting(pairs: DataFrame, tracklets: DataFrame, slack: int, bucket: int = BUCKET) -> DataFrame:
    """Tracklets of the two sides on one device at most ``slack`` frames apart, once each."""
    def buckets(side: str, widen: int) -> Column:
        return F.sequence(F.floor((F.col(f"{side}_frame_start") - widen) / bucket),
                          F.floor((F.col(f"{side}_frame_end") + widen) / bucket))
    a = _side(pairs, tracklets, "a").withColumn("_bucket", F.explode(buckets("a", slack)))
    b = _side(pairs, tracklets, "b").withColumn("_bucket", F.explode(buckets("b", 0)))
    met = a.join(b, ["entity_a", "entity_b", "device_id", "_bucket"])
    owner = F.greatest(F.floor((F.col("a_frame_start") - slack) / bucket), F.floor(F.col("b_frame_start") / bucket))
    close = (F.col("a_frame_start") - slack <= F.col("b_frame_end")) & (F.col("b_frame_start") <= F.col("a_frame_end") + slack)
    return met.where(close & (F.col("_bucket") == owner))


def _box_or_null(struct: str) -> g.Box:
    return g.box(f"{struct}.")


def _best_transition(rows: DataFrame, *order: str) -> DataFrame:
    closeness = g.centre_ratio(_box_or_null("box_a"), _box_or_null("box_b"))
    rows = rows.withColumn("centre", closeness)
    rank = {"gap": F.col("gap"), "centre": F.coalesce("centre", F.lit(float("inf")))}
    best = F.struct(*[rank[o].alias(o) for o in order], F.col("a_tracklet_id"), F.col("b_tracklet_id"), F.col("turn"))
    return rows.groupBy("entity_a", "entity_b").agg(
        F.min_by(F.struct("gap", "box_a", "box_b", "centre"), best).alias("_t")).select("entity_a", "entity_b", "_t.*")


def nearest_transition(gaps: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Boxes on both sides of the smallest gap, the closest ones on equal gaps.

    With the gap known, tracklets that leave exactly that gap meet by equality;
    only pairs that overlap in time need a range join.
    """
    gaps = cut(gaps)
    apart, touching = gaps.where("gap > 0"), gaps.where("gap = 0")
    a = _side(apart, tracklets, "a").join(apart, ["entity_a", "entity_b"])
    b = _side(apart, tracklets, "b")
    forward = a.withColumn("_key", F.col("a_frame_end") + F.col("gap")).join(
        b.withColumn("_key", F.col("b_frame_start")), ["entity_a", "entity_b", "device_id", "_key"])
    backward = a.withColumn("_key", F.col("a_frame_start") - F.col("gap")).join(
        b.withColumn("_key", F.col("b_frame_end")), ["entity_a", "entity_b", "device_id", "_key"])
    over = _meeting(touching, tracklets, 0).withColumn("gap", F.lit(0).cast("long"))

    def shape(rows: DataFrame, end_a: str, end_b: str, turn: int) -> DataFrame:
        return rows.select("entity_a", "entity_b", F.col("gap").cast("long").alias("gap"), F.col(f"a_{end_a}").alias("box_a"),
                           F.col(f"b_{end_b}").alias("box_b"), "a_tracklet_id", "b_tracklet_id", F.lit(turn).alias("turn"))

    rows = shape(forward, "last_box", "first_box", 0).unionByName(shape(backward, "first_box", "last_box", 0)).unionByName(
        shape(over, "last_box", "first_box", 0))
    return _best_transition(rows, "gap", "centre")


def _transitions(met: DataFrame) -> DataFrame:
    """Every hand-over between meeting tracklets; overlapping ones in both directions."""
    over = (F.col("a_frame_start") <= F.col("b_frame_end")) & (F.col("b_frame_start") <= F.col("a_frame_end"))
    a_first = F.col("a_frame_end") < F.col("b_frame_start")

    def way(end_a: str, end_b: str, turn: int) -> Column:
        return F.struct(F.col(f"a_{end_a}").alias("box_a"), F.col(f"b_{end_b}").alias("box_b"), F.lit(turn).alias("turn"))

    forth, back = way("last_box", "first_box", 0), way("first_box", "last_box", 1)
    ways = F.when(over, F.array(forth, back)).when(a_first, F.array(forth)).otherwise(F.array(back))
    gap = F.when(over, F.lit(0)).when(a_first, F.col("b_frame_start") - F.col("a_frame_end")).otherwise(
        F.col("a_frame_start") - F.col("b_frame_end"))
    rows = met.select("entity_a", "entity_b", gap.cast("long").alias("gap"), "a_tracklet_id", "b_tracklet_id",
                      F.explode(ways).alias("_w")).select("*", "_w.*").drop("_w")
    return rows.where(F.col("box_a").isNotNull() & F.col("box_b").isNotNull())


def closest_transitions(pairs: DataFrame, tracklets: DataFrame, limits: Sequence[int], bucket: int = BUCKET) -> DataFrame:
    """Per limit the spatially closest hand-over at most that many frames apart,
    as struct columns ``within_<limit>`` from one join and one aggregate."""
    rows = _transitions(_meeting(pairs, tracklets, max(limits), bucket))
    centre = g.centre_ratio(g.box("box_a."), g.box("box_b."))
    row = F.struct(centre.alias("centre"), "gap", "a_tracklet_id", "b_tracklet_id", "turn", "box_a", "box_b")
    return rows.groupBy("entity_a", "entity_b").agg(*[
        F.min(F.when(F.col("gap") <= limit, row)).alias(f"within_{limit}") for limit in limits])


def closest_transition(pairs: DataFrame, tracklets: DataFrame, max_gap: int, bucket: int = BUCKET) -> DataFrame:
    """The spatially closest hand-over within ``max_gap`` frames."""
    best = closest_transitions(pairs, tracklets, [max_gap], bucket)
    return best.select("entity_a", "entity_b", f"within_{max_gap}.*").drop("a_tracklet_id", "b_tracklet_id", "turn")


def handovers(tracklets: DataFrame, max_gap: int, max_centre: float) -> DataFrame:
    """(entity_a, entity_b, device_id, a_tracklet_id, b_tracklet_id): entity_a leaves a place where entity_b, another one, has arrived
    before or arrives at most ``max_gap`` frames later, and boxes are within ``max_centre`` sizes. Each is a row once, and no other
    pair is a row.

    They meet in cells of time and place. The reach in place grows with the larger box, so boxes have levels of doubling size: the larger
    one is in the four cells of its level that its reach touches, the smaller one in a single cell of each level above its own. Cells
    of time are as long as a tracklet with its slack on average, so all tracklets together are in three cells each at most.
    """
    slack = F.lit(max_gap)

    def side(s: str, box: str, widen: Column) -> DataFrame:
        b = g.box(f"{box}.")
        x, y = g.centre(b)
        named = tracklets.where(F.col(box).isNotNull()).select(
            F.col("entity_id").alias(f"entity_{s}"), "device_id", F.col("tracklet_id").alias(f"{s}_tracklet_id"), F.col(box).alias(f"box_{s}"),
            F.col("frame_start").alias(f"{s}_from"), (F.col("frame_end") + widen).alias(f"{s}_to"), F.ceil(F.log2(g.size(b))).cast("int").alias("_own"), x.alias("_x"), y.alias("_y"))
        first = F.floor(F.col(f"{s}_from") / width)
        return named.withColumn(f"_{s}_first", first).withColumn("_time", F.explode(F.sequence(first, F.floor(F.col(f"{s}_to") / width))))

    levels = F.collect_set(F.ceil(F.log2(g.size(g.box("_b.")))).cast("int"))  # doublings of a box's size: a few dozen at most
    ends = tracklets.select((F.col("frame_end") - F.col("frame_start") + slack).alias("_n"), F.explode(F.array("first_box", "last_box")).alias("_b"))
    found = ends.where(F.col("_b").isNotNull()).agg(F.avg("_n").alias("n"), levels.alias("levels")).first()
    width, known = max(1, round(found.n or 1)), F.array(*[F.lit(x) for x in sorted(found.levels)]).cast("array<int>")
    leave, arrive = side("a", "last_box", slack), side("b", "first_box", F.lit(0))

    def cell(level: Column) -> Column:  # twice the reach, and a little more for rounding
        return F.pow(F.lit(2.0), level) * (2.000002 * max_centre)

    def wide(rows: DataFrame) -> DataFrame:
        w = cell(F.col("_own"))
        near = [F.array_distinct(F.array(F.floor(F.col(c) / w - 0.5), F.floor(F.col(c) / w + 0.5))) for c in ("_x", "_y")]
        return rows.withColumn("_level", F.col("_own")).withColumn("_cx", F.explode(near[0])).withColumn("_cy", F.explode(near[1])).drop("_x", "_y", "_own")

    def narrow(rows: DataFrame, strict: bool) -> DataFrame:
        above = F.filter(known, lambda x: x > F.col("_own") if strict else x >= F.col("_own"))
        rows = rows.withColumn("_level", F.explode(above))
        return rows.withColumn("_cx", F.floor(F.col("_x") / cell(F.col("_level")))).withColumn("_cy", F.floor(F.col("_y") / cell(F.col("_level")))).drop("_x", "_y", "_own")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b, ["device_id", "_time", "_level", "_cx", "_cy"])
        return both.where(
            (F.col("entity_a") != F.col("entity_b")) & (F.col("_time") == F.greatest("_a_first", "_b_first"))
            & (F.col("a_from") <= F.col("b_to")) & (F.col("b_from") <= F.col("a_to"))
            & (g.centre_ratio(g.box("box_a."), g.box("box_b.")) <= max_centre)).select("entity_a", "entity_b", "device_id", "a_tracklet_id", "b_tracklet_id")

    return met(wide(leave), narrow(arrive, False)).unionByName(met(narrow(leave, True), wide(arrive)))


def nearby_pairs(tracklets: DataFrame, max_gap: int, max_centre: float) -> DataFrame:
    """Pairs of entities with some hand-over close in time and space."""
    found = handovers(tracklets, max_gap, max_centre)
    return found.select(F.least("entity_a", "entity_b").alias("entity_a"), F.greatest("entity_a", "entity_b").alias("entity_b")).distinct()


def device_counts(pairs: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Distinct devices over both sides of a pair."""
    seen = tracklets.where(F.col("device_id") != "").select("entity_id", "device_id").distinct()
    members = pairs.select("entity_a", "entity_b", F.explode(F.array("entity_a", "entity_b")).alias("entity_id"))
    return members.join(seen, "entity_id").groupBy("entity_a", "entity_b").agg(F.countDistinct("device_id").alias("devices"))


def last_boxes(tracklets: DataFrame) -> DataFrame:
    return tracklets.groupBy("entity_id").agg(F.max_by("last_box", F.struct("frame_end", "tracklet_id")).alias("box"))


def close_for_reentry(pairs: DataFrame, tracklets: DataFrame, transitions: DataFrame,
                      max_centre: float = MERGING.reentry_centre) -> DataFrame:
    """Last boxes of both entities lie close, or else their nearest transition does."""
    last = last_boxes(tracklets)
    a = last.select(F.col("entity_id").alias("entity_a"), F.col("box").alias("_a"))
    b = last.select(F.col("entity_id").alias("entity_b"), F.col("box").alias("_b"))
    t = transitions.select("entity_a", "entity_b", F.col("centre").alias("_t"))
    rows = pairs.select("entity_a", "entity_b").join(a, "entity_a", "left").join(b, "entity_b", "left").join(
        t, ["entity_a", "entity_b"], "left")
    direct = g.centre_ratio(g.box("_a."), g.box("_b."))
    near = F.coalesce(direct <= max_centre, F.lit(False)) | F.coalesce(F.col("_t") <= max_centre, F.lit(False))
    return rows.select("entity_a", "entity_b", near.alias("close"))


def short_reentry(candidates: DataFrame, tracklets: DataFrame, max_gap: int = MATCHING.reentry_frames) -> DataFrame:
    """Candidates (tracklet_id, other_id, score, first_box, frame_start, entry_count,
    device_id) whose entity left the same place shortly before."""
    fit = candidates.where((F.col("score") >= MATCHING.provisional_reentry) & (F.col("entry_count") <= MATCHING.reentry_entries))
    bucket = F.floor(F.col("_end") / max_gap)
    ends = tracklets.select(F.col("entity_id").alias("other_id"), "device_id", F.col("frame_end").alias("_end"),
                            F.col("last_box").alias("_box"))
    ends = ends.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1)))
    met = fit.withColumn("_bucket", F.floor(F.col("frame_start") / max_gap)).join(ends, ["other_id", "device_id", "_bucket"])
    gap = F.col("frame_start") - F.col("_end")
    last = met.where((gap > 0) & (gap <= max_gap)).groupBy("tracklet_id", "other_id", "first_box").agg(
        F.max_by("_box", "_end").alias("_box"), F.min(gap).alias("gap"))
    near = g.centre_ratio(g.box("first_box."), g.box("_box.")) <= MATCHING.reentry_centre
    return last.where(near).select("tracklet_id", "other_id", "gap")
