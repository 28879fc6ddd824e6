"""Greedy chains: "take a row, skip to the next allowed one, repeat".

Minimum-interval sampling, adaptive frame skipping and tracklet cutting are all
of this shape, and none can be a window function. A chain is followed in three
steps that never hold a whole key: every chunk of the axis works out where a
chain would leave it for each row it could be entered at; those few numbers are
composed along the key; then each chunk replays with its real entry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SAMPLING, TRACKLETS, Sampling, Tracklets

Jump = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]
SPAN = 1 << 16


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def chain_members(df: DataFrame, keys: Sequence[str], axis: str, reach: int, jump: Jump,
                  cols: Sequence[str] = (), span: int = SPAN) -> DataFrame:
    """The (keys, axis) rows that the chain starting at each key's first row visits.

    ``axis`` is a long, unique within a key. ``jump(axis, cols)`` gives for each
    row of a sorted run the index of the row that follows it in a chain, or the
    run length. A following row lies less than ``reach`` further on, or else it
    is simply the next row there is.
    """
    if reach >= span:
        raise ValueError("a chunk must be longer than the reach")
    keys, cols = list(keys), [c for c in cols if c != axis]
    own = F.floor(F.col(axis) / span).cast("long")
    near_start = F.col(axis) - own * span < reach
    rows = df.select(*keys, F.col(axis).cast("long").alias(axis), *cols)
    copies = rows.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(near_start, F.array(own, own - 1)).otherwise(F.array(own))))

    exits_schema = T.StructType(_fields(rows, keys) + [
        T.StructField("_chunk", T.LongType()), T.StructField("_entry", T.ArrayType(T.LongType())),
        T.StructField("_exit", T.ArrayType(T.LongType()))])

    def exits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axis, kind="stable")
        at, chunk = pdf[axis].to_numpy(), int(key[-1])
        n = int((pdf["_own"].to_numpy() == chunk).sum())
        if n == 0:
            return pd.DataFrame(columns=[f.name for f in exits_schema])
        follow = jump(at, {c: pdf[c].to_numpy() for c in cols})
        # past the copied rows the chain goes on at the first row after them
        beyond = int(at[-1]) + 1 if len(at) > n else None
        leaves: list[int | None] = [None] * n
        for i in range(n - 1, -1, -1):
            j = int(follow[i])
            leaves[i] = leaves[j] if j < n else (int(at[j]) if j < len(at) else beyond)
        early = int(np.searchsorted(at[:n], chunk * span + reach))
        entries = range(min(n, max(early, 1) + 1))
        row = [*key, [int(at[i]) for i in entries], [leaves[i] for i in entries]]
        return pd.DataFrame([row], columns=[f.name for f in exits_schema])

    summary = copies.groupBy(*keys, "_chunk").applyInPandas(exits, exits_schema)

    entry_schema = T.StructType(_fields(rows, keys) + [
        T.StructField("_chunk", T.LongType()), T.StructField("_from", T.LongType())])

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, carried = [], None
        for chunk, entry, leave in sorted(zip(pdf["_chunk"], pdf["_entry"], pdf["_exit"]), key=lambda r: r[0]):
            at = 0 if carried is None else int(np.searchsorted(entry, carried))
            carried = None
            if at == len(entry):
                continue
            out.append([*key, int(chunk), int(entry[at])])
            left = leave[at]
            carried = None if left is None or pd.isna(left) else int(left)
        return pd.DataFrame(out, columns=[f.name for f in entry_schema])

    entries = summary.groupBy(*keys).applyInPandas(compose, entry_schema)

    visit_schema = T.StructType(_fields(rows, keys) + [T.StructField(axis, T.LongType())])

    def visit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axis, kind="stable")
        at = pdf[axis].to_numpy()
        follow = jump(at, {c: pdf[c].to_numpy() for c in cols})
        i, seen = int(np.searchsorted(at, pdf["_from"].iloc[0])), []
        while i < len(at):
            seen.append(i)
            i = int(follow[i])
        return pd.DataFrame([[*key[:-1], int(at[i])] for i in seen], columns=[f.name for f in visit_schema])

    placed = rows.withColumn("_chunk", own).join(entries, [*keys, "_chunk"])
    return placed.groupBy(*keys, "_chunk").applyInPandas(visit, visit_schema)


# the three rules ------------------------------------------------------------------------------


def interval_jump(interval: int) -> Jump:
    """The next row at least ``interval`` later."""
    return lambda at, _: np.searchsorted(at, at + interval, side="left")


def skip_jump(cfg: Sampling = SAMPLING) -> Jump:
    """After a processed frame a countdown runs, longer when the frame was empty;
    a large change ends it early. The axis is the frame's position."""
    def jump(at: np.ndarray, cols: dict[str, np.ndarray]) -> np.ndarray:
        n = len(at)
        wait = np.where(cols["boxes"] > 0, cfg.skip_with_boxes, cfg.skip_without_boxes)
        changed = np.where(cols["change"] >= cfg.change_level, np.arange(n), n)
        upcoming = np.append(np.minimum.accumulate(changed[::-1])[::-1], n)
        due = np.searchsorted(at, at + wait + 1, side="left")
        return np.minimum(upcoming[1:], due)
    return jump


def tracklet_jump(cfg: Tracklets = TRACKLETS) -> Jump:
    """Where the next tracklet of a track starts: after ``max_entries`` rows, or
    once enough rows and frames have gone by, or after a long silence."""
    def jump(at: np.ndarray, _: dict[str, np.ndarray]) -> np.ndarray:
        n, index = len(at), np.arange(len(at))
        broken = np.where(np.diff(at, prepend=at[:1]) > cfg.stale_frames, index, n)
        silence = np.append(np.minimum.accumulate(broken[::-1])[::-1], n)[1:]
        aged = np.searchsorted(at, at + cfg.window_frames, side="right")
        ready = np.maximum(index + cfg.min_entries, aged)
        return np.minimum(np.minimum(np.minimum(index + cfg.max_entries, ready), silence), n)
    return jump


TRACKLET_REACH = TRACKLETS.stale_frames * (TRACKLETS.min_entries + 1)


def sample_interval(df: DataFrame, keys: Sequence[str], axis: str, interval: int, span: int | None = None) -> DataFrame:
    kept = chain_members(df, keys, axis, interval, interval_jump(interval), span=span or interval * 4096)
    return df.join(kept, [*keys, axis], "left_semi")


def processed_frames(frames: DataFrame, keys: Sequence[str], position: str, span: int = SPAN) -> DataFrame:
    reach = SAMPLING.skip_without_boxes + 2
    kept = chain_members(frames, keys, position, reach, skip_jump(), ["boxes", "change"], span)
    return frames.join(kept, [*keys, position], "left_semi")


def tracklet_starts(entries: DataFrame, keys: Sequence[str], axis: str = "frame_no", span: int = SPAN) -> DataFrame:
    """First row of every tracklet."""
    return chain_members(entries, keys, axis, TRACKLET_REACH, tracklet_jump(), span=span)
