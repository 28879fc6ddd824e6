"""Splitting a track whose appearance changes: frames unlike what the track has shown go to a virtual track.

A track's first two clear frames are what it is compared with; from the third on one is looked at every so many frames. Which ones depends
on frame numbers alone, so they are chosen first, by the chunked interval chain, and only their vectors travel. The comparison
itself goes by the track's last like frames, a memory of fixed size, as sorted rows stream past.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TRACKLETS, Tracklets
from ..functions import vectors as v
from ..lineage import cut
from . import chains

#: virtual ids per track; fixed value
STRIDE = 1_000_000


def looked_at(clear: DataFrame, keys: tuple[str, ...], frame: str, cfg: Tracklets = TRACKLETS) -> DataFrame:
    """(keys, frame, given) of the frames that matter: a track's first two, ``given``, and those at least ``split_interval`` apart after them."""
    own = list(keys)
    rows = cut(clear.select(*own, frame).distinct())
    first = rows.groupBy(*own).agg(F.min(frame).alias("_first"))
    later = rows.join(first, own).where(F.col(frame) > F.col("_first"))
    start = later.groupBy(*own).agg(F.min("_first").alias("_first"), F.min(frame).alias("_second"))
    rest = rows.join(start, own).where(F.col(frame) > F.col("_second")).select(*own, frame)
    chain = chains.chain_members(rest, own, frame, cfg.split_interval, chains.interval_jump(cfg.split_interval), span=cfg.split_interval * 4096)
    given = start.select(*own, F.explode(F.array("_first", "_second")).alias(frame), F.lit(True).alias("given"))
    return given.unionByName(chain.select(*own, frame, F.lit(False).alias("given")))


def appearance_splits(frames: DataFrame, keys: tuple[str, ...] = ("device_id", "track_id"), frame: str = "frame_no",
                      cfg: Tracklets = TRACKLETS) -> DataFrame:
    """(keys, frame, virtual_id) of the frames that leave their track; the last key is the numeric track id.

    Frames without a vector or under ``split_min_v`` are never looked at. The n-th split of a track gets -(|track| * 1,000,000 + n). A track has one
    row a frame. Rows of a track are one task's, in order: vectors of the frames looked at, a batch at a time.
    """
    names = [*keys, frame]
    clear = frames.where((F.col("v_score") >= cfg.split_min_v) & F.col("vec").isNotNull()).select(*names, v.as_double(F.col("vec")).alias("vec"))
    rows = clear.join(looked_at(clear, keys, frame, cfg), names).withColumn("_track", F.concat_ws("|", *keys))
    fields = ", ".join(f"`{n}` {clear.schema[n].dataType.simpleString()}" for n in names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shown, away = None, np.zeros((0, 0)), 0
        for batch in batches:
            matrix = np.stack(batch.column("vec").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 0))
            ids = np.zeros(batch.num_rows, np.int64)
            tracks, given, number = (batch.column(c).to_pylist() for c in ("_track", "given", keys[-1]))
            for i, track in enumerate(tracks):
                if track != now:
                    now, shown, away = track, matrix[:0], 0
                mean = shown.mean(axis=0) if len(shown) else matrix[i]
                norms = np.linalg.norm(mean) * np.linalg.norm(matrix[i])
                alike = 1.0 if given[i] else mean @ matrix[i] / norms if norms >= 1e-8 else None
                if alike is not None and alike < cfg.split_below:
                    away += 1
                    ids[i] = -(abs(int(number[i])) * STRIDE + away)
                elif alike is not None:
                    shown = np.vstack([shown, matrix[i]])[-cfg.split_memory:]
            out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(ids)], [*names, "virtual_id"])
            yield out.filter(pa.array(ids < 0))

    return rows.repartition(*keys).sortWithinPartitions(*names).mapInArrow(walk, f"{fields}, virtual_id bigint")


def split_tracks(frames: DataFrame, keys: tuple[str, ...] = ("device_id", "track_id"), frame: str = "frame_no", cfg: Tracklets = TRACKLETS) -> DataFrame:
    """``frames`` with ``virtual_track_id``: the track, or where an unlike frame went."""
    return frames.join(appearance_splits(frames, keys, frame, cfg), [*keys, frame], "left").withColumn(
        "virtual_track_id", F.coalesce("virtual_id", keys[-1])).drop("virtual_id")
