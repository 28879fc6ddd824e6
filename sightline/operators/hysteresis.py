"""Entity labels that only flip after repeated confident dissent.

The rule is a small automaton run over an entity's tracklets in order. Its
label state is finite and its confidence and support change linearly, so a long
history is cut into chunks: each chunk works out its effect on every possible
state, the effects are composed along the key, and the chunks then replay from
the state they are really entered in. Keys that fit one chunk skip the first
two steps.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import LABELS, UNKNOWN, Labels
from . import ordered

CHUNK_ROWS = 4096
#: votes that a task holds as Python's own values at a time
SLICE_VOTES = 1 << 16
STATE = T.StructType([
    T.StructField("current", T.StringType()), T.StructField("last", T.StringType()), T.StructField("dissent", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("support", T.LongType())])
START = (UNKNOWN, UNKNOWN, 0, 0.0, 0)


def step(state: tuple, label: str, conf: float, accept: float, flip: float) -> tuple:
    """One tracklet's vote."""
    current, last, dissent, sure, support = state
    if current == UNKNOWN:
        return (label, last, dissent, conf, 1) if conf >= accept else state
    if label == current:
        return current, label, 0, 0.8 * sure + 0.2 * conf, support + 1
    dissent = min(dissent + 1, 2) if label == last else 1
    if dissent >= 2 and conf >= flip:
        return label, label, 0, conf, 1
    return current, label, dissent, sure, support


def chunk_effect(labels: Sequence[str], confs: Sequence[float], accept: float, flip: float) -> dict[str, list]:
    """Exit of every entry state. ``None`` stands for a label the chunk never
    shows; confidence and support leave as ``scale * entry + shift``."""
    shown: list[str | None] = sorted(set(labels) | {UNKNOWN}) + [None]
    code = {name: i for i, name in enumerate(shown)}
    unknown, width = code[UNKNOWN], len(shown)
    cur, last, dis = (g.ravel().copy() for g in np.meshgrid(np.arange(width), np.arange(width), np.arange(3), indexing="ij"))
    entry = (cur.copy(), last.copy(), dis.copy())
    scale, shift = np.ones(len(cur)), np.zeros(len(cur))
    keep, add = np.ones(len(cur), dtype=np.int64), np.zeros(len(cur), dtype=np.int64)
    for name, conf in zip(labels, confs):
        c = code[name]
        fresh, same = cur == unknown, (cur == c) & (cur != unknown)
        other = ~fresh & ~same
        dis = np.where(other, np.where(last == c, np.minimum(dis + 1, 2), 1), np.where(same, 0, dis))
        flips = other & (dis >= 2) & (conf >= flip)
        sets = flips | (fresh & (conf >= accept))
        last = np.where(fresh, last, c)
        scale = np.where(same, 0.8 * scale, np.where(sets, 0.0, scale))
        shift = np.where(same, 0.8 * shift + 0.2 * conf, np.where(sets, conf, shift))
        keep, add = np.where(sets, 0, keep), np.where(sets, 1, np.where(same, add + 1, add))
        cur, dis = np.where(sets, c, cur), np.where(flips, 0, dis)
    return {
        "in": [(shown[a], shown[b], int(n)) for a, b, n in zip(*entry)],
        "out": [(shown[a], shown[b], int(n), float(p), float(q), int(k), int(m))
                for a, b, n, p, q, k, m in zip(cur, last, dis, scale, shift, keep, add)],
        "shown": [s for s in shown if s is not None],
    }


def apply_effect(state: tuple, effect: dict[str, list]) -> tuple:
    current, last, dissent, sure, support = state
    shown = set(effect["shown"])
    key = (current if current in shown else None, last if last in shown else None, dissent)
    cur, lst, dis, p, q, k, m = effect["out"][effect["in"].index(key)]
    return (current if cur is None else cur, last if lst is None else lst, dis, p * sure + q, k * support + m)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Chunks a few at a time, so that a task's memory doesn't grow with the length of the histories."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, SLICE_VOTES * batch.num_rows // max(1, len(batch.column("label").flatten())))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).to_pylist()


def _chunks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], hard: str, cfg: Labels, chunk_rows: int, span: int) -> tuple[DataFrame, Callable[[dict], Iterator[tuple]]]:
    """Chunks of each key with the state that enters them, and the states after each vote of a chunk. ``keys`` end with the task."""
    placed = ordered.with_position(rows.select(*keys, *order, "label", F.col("confidence").alias("_conf")), keys, order, "_pos",
                                   span)
    placed = placed.withColumn("_chunk", F.floor((F.col("_pos") - 1) / chunk_rows).cast("long"))

    def limits(row: dict) -> tuple[float, float]:
        return cfg.accept, cfg.hard_flip if row["task"] == hard else cfg.flip

    key_fields = [placed.schema[k] for k in keys]
    row = F.struct("_pos", *order, "label", "_conf")
    # one row per chunk of a key; a chunk never holds more than ``chunk_rows`` votes
    chunks = placed.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(row)).alias("_r")).select(
        *keys, "_chunk", *[F.col(f"_r.{c}").alias(c) for c in ("label", "_conf", *order)])
    names = [*keys, "_chunk"]

    effect_row = T.StructType(key_fields + [T.StructField("_chunk", T.LongType()), T.StructField("_effect", T.StringType())])
    effect_arrow = to_arrow_schema(effect_row)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _sliced(batches):
            yield pa.RecordBatch.from_pylist([{
                **{n: r[n] for n in names}, "_effect": json.dumps(chunk_effect(r["label"], r["_conf"], *limits(r)))} for r in some], schema=effect_arrow)

    entry_row = T.StructType(key_fields + [T.StructField("_chunk", T.LongType()), T.StructField("_entry", STATE)])

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        for chunk, text in sorted(zip(pdf["_chunk"], pdf["_effect"])):
            effect = json.loads(text)
            effect["in"] = [tuple(x) for x in effect["in"]]
            state = apply_effect(state, effect)
            out.append([*key, int(chunk) + 1, dict(zip(STATE.names, state))])
        return pd.DataFrame(out, columns=entry_row.names)

    ends = placed.groupBy(*keys).agg(F.max("_chunk").alias("_end")).where(F.col("_end") > 0)
    crossing = chunks.join(ends, keys).where(F.col("_chunk") < F.col("_end")).select(*names, "label", "_conf")
    entries = crossing.mapInArrow(effects, effect_row).groupBy(*keys).applyInPandas(compose, entry_row)

    def states(row: dict) -> Iterator[tuple]:
        state = START if row["_entry"] is None else tuple(row["_entry"][n] for n in STATE.names)
        accept, flip = limits(row)
        for name, sure in zip(row["label"], row["_conf"]):
            state = step(state, name, sure, accept, flip)
            yield state

    return chunks.join(entries, names, "left").select(*names, *order, "label", "_conf", "_entry"), states


def resolve(rows: DataFrame, keys: Sequence[str], order: Sequence[str], hard: str, cfg: Labels = LABELS,
            chunk_rows: int = CHUNK_ROWS, span: int = ordered.SPAN) -> DataFrame:
    """Rows of (keys, task, order, label, confidence) with the state after each:
    current, last, dissent, confidence, support."""
    keys = [*keys, "task"]
    ready, states = _chunks(rows, keys, order, hard, cfg, chunk_rows, span)
    state_row = T.StructType([ready.schema[c] for c in (*keys, *order)] + [T.StructField("_states", T.ArrayType(STATE))])
    arrow = to_arrow_schema(state_row)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _sliced(batches):
            yield pa.RecordBatch.from_pylist([{
                **{c: r[c] for c in (*keys, *order)}, "_states": [dict(zip(STATE.names, s)) for s in states(r)]} for r in some], schema=arrow)

    done = ready.mapInArrow(replay, state_row)
    each = done.select(*keys, F.explode(F.arrays_zip(*order, "_states")).alias("_z"))
    return each.select(*keys, *[F.col(f"_z.{o}").alias(o) for o in order], "_z._states.*")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], hard: str, cfg: Labels = LABELS,
           chunk_rows: int = CHUNK_ROWS, span: int = ordered.SPAN) -> DataFrame:
    """``snapshot`` of ``resolve``, without a row for every vote: a chunk gives its last state."""
    keys = [*keys, "task"]
    ready, states = _chunks(rows, keys, order, hard, cfg, chunk_rows, span)
    end_row = T.StructType([ready.schema[c] for c in (*keys, "_chunk")] + STATE.fields)
    arrow = to_arrow_schema(end_row)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _sliced(batches):
            out = []
            for r in some:
                state = START
                for state in states(r):
                    pass
                out.append({**{c: r[c] for c in (*keys, "_chunk")}, **dict(zip(STATE.names, state))})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return snapshot(ready.drop(*order).mapInArrow(replay, end_row), keys[:-1], ["_chunk"])


def snapshot(resolved: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """State after the last row of each key and task."""
    row = F.struct("current", "confidence", "support")
    last = resolved.groupBy(*keys, "task").agg(F.max_by(row, F.struct(*order)).alias("_s"))
    return last.select(*keys, "task", F.col("_s.current").alias("label"), F.round("_s.confidence", 4).alias("confidence"),
                       F.col("_s.support").alias("support"))
