"""Chunked operators give what a plain window or a sequential loop gives."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import chains, hysteresis, numbering, ordered
from sightline.operators.percentiles import percentiles


def rows(seed, n=400, keys=3, top=3000):
    r = random.Random(seed)
    out = {(r.choice("abc"[:keys]), r.randrange(top)) for _ in range(n)}
    return sorted(out)


def frame(spark, seed=1, **kw):
    return spark.createDataFrame(rows(seed, **kw), "k string, t long")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_previous_across_chunks(spark):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", F.lag("t", 1).over(w), F.lag("t", 2).over(w))
    got = ordered.with_previous(df, ["k"], ["t"], ["t"], depth=2, span=7).select("k", "t", "prev1.t", "prev2.t")
    same(got, want)
    one = ordered.with_previous(df, ["k"], ["t"], ["t"], span=7).select("k", "t", "prev1.t")
    same(one, want.select("k", "t", F.col(want.columns[2])))


def test_running_and_position(spark):
    df = frame(spark, 2)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "t", F.sum("t").over(w), F.max(F.col("t") % 13).over(w))
    got = ordered.with_running(df, ["k"], ["t"], {"s": F.col("t")}, {"m": F.col("t") % 13}, span=11)
    same(got, want)


def test_sessions_count_rows_and_runs(spark):
    data = rows(3)
    want, state = [], {}
    for k, t in data:
        last, session, n = state.get(k, (None, 0, 0))
        session, n = (session, n + 1) if last is not None and t - last <= 10 else (session + 1, 1)
        state[k] = (t, session, n)
        want.append((k, t, session, n))
    got = ordered.with_sessions(frame(spark, 3), ["k"], ["t"], 10, span=8)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def follow(times, rule):
    out, i = [], 0
    while i < len(times):
        out.append(times[i])
        i = rule(times, i)
    return out


def test_interval_chain_matches_loop(spark):
    data = rows(4, 600)
    got = chains.sample_interval(frame(spark, 4, n=600), ["k"], "t", 9, span=40)
    want = []
    for k in "abc":
        ts = [t for q, t in data if q == k]
        want += [(k, t) for t in follow(ts, lambda a, i: next((j for j in range(i + 1, len(a)) if a[j] >= a[i] + 9), len(a)))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_tracklet_cut_matches_buffer(spark):
    r = random.Random(5)
    data = []
    for k in "abc":
        t = 0
        for _ in range(500):
            t += r.choice([1, 1, 1, 2, 5, 30, 149, 150, 151, 400])
            data.append((k, t))
    want = []
    for k in "abc":
        first, last, n = None, None, 0
        for q, t in data:
            if q != k:
                continue
            if first is None or t - last > 150 or n >= 60 or (n >= 6 and t > first + 90):
                first, n = t, 0
                want.append((k, t))
            last, n = t, n + 1
    df = spark.createDataFrame(data, "k string, t long")
    got = chains.tracklet_starts(df, ["k"], "t", span=1100)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_skip_matches_countdown(spark):
    r = random.Random(6)
    data = [(k, i + 1, r.choice([0, 1]), r.choice([0.0, 0.0, 0.0, 30.0])) for k in "ab" for i in range(300)]
    want = []
    for k in "ab":
        wait = 0
        for q, p, boxes, change in data:
            if q != k:
                continue
            if wait <= 0 or change >= 25.5:
                want.append((k, p))
                wait = 5 if boxes > 0 else 30
            else:
                wait -= 1
    df = spark.createDataFrame(data, "k string, position long, boxes long, change double")
    got = chains.processed_frames(df, ["k"], "position", span=64).select("k", "position")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_numbering_is_dense_and_ordered(spark):
    got = numbering.with_number(frame(spark, 7), ["t", "k"], 5, "n", partitions=6).orderBy("n").collect()
    assert [g.n for g in got] == list(range(5, 5 + len(got)))
    assert [(g.t, g.k) for g in got] == sorted((g.t, g.k) for g in got)


def test_percentiles_match_numpy(spark):
    r = random.Random(8)
    data = [(k, r.choice([0.25, r.random(), r.random() * 3 - 1])) for k in "ab" for _ in range(501)]
    got = percentiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"p05": .05, "p50": .5, "p99": .99}).collect()
    for g in got:
        vs = [v for k, v in data if k == g.k]
        assert np.allclose([g.p05, g.p50, g.p99], np.percentile(vs, [5, 50, 99]))


def test_hysteresis_chunks_match_steps(spark):
    r = random.Random(9)
    data = [(e, task, i, r.choice(["a", "b", "unknown"]), round(r.uniform(0.5, 1.0), 3)) for e in (1, 2) for task in ("kind", "x") for i in range(120)]
    df = spark.createDataFrame(data, "entity_id long, task string, n long, label string, confidence double")
    want = {}
    for e, task, i, label, conf in data:
        state = want.get((e, task, i - 1), hysteresis.START)
        want[(e, task, i)] = hysteresis.step(state, label, conf, 0.7, 0.65 if task == "kind" else 0.85)
    for size in (7, 1000):
        got = hysteresis.resolve(df, ["entity_id"], ["n"], "kind", chunk_rows=size).collect()
        assert len(got) == len(data)
        for g in got:
            cur, last, dis, conf, sup = want[(g.entity_id, g.task, g.n)]
            assert (g.current, g.dissent, g.support) == (cur, dis, sup) and abs(g.confidence - conf) < 1e-9


def test_latest_states_without_a_row_a_vote(spark, monkeypatch):
    r = random.Random(5)
    data = [(e, task, i, r.choice(["a", "b", "unknown"]), round(r.uniform(0.5, 1.0), 3)) for e in range(6) for task in ("kind", "x") for i in range(5 + 30 * e)]
    df = spark.createDataFrame(data, "entity_id long, task string, n long, label string, confidence double")
    monkeypatch.setattr(hysteresis, "SLICE_VOTES", 20)
    for size in (7, 1000):
        want = hysteresis.snapshot(hysteresis.resolve(df, ["entity_id"], ["n"], "kind", chunk_rows=size), ["entity_id"], ["n"])
        got = hysteresis.latest(df, ["entity_id"], ["n"], "kind", chunk_rows=size)
        same(got, want)
        assert got.count() == 12 and "Generate" not in got._jdf.queryExecution().executedPlan().toString()
