"""Block-wise comparison equals brute force for any block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import aggregation, gallery, similarity, tiles
from sightline.plans import evaluate, resolve


def points(spark, n=160, dim=8, seed=0, groups=20):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    v = centres[np.arange(n) % groups] + 0.3 * r.normal(size=(n, dim))
    rows = [(i, int(i % groups), v[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, tag long, vec array<double>"), v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("block,floor", [(1000, 0.5), (11, 0.9), (23, 0.2)])
def test_hits_are_exact(spark, block, floor):
    df, u = points(spark)
    got = {(r.left_id, r.right_id) for r in tiles.hits(df, None, floor, block=block).collect()}
    s = u @ u.T
    assert got == {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if s[i, j] >= floor}


def test_two_sided_hits(spark):
    a, u = points(spark, 40, seed=1)
    b, w = points(spark, 90, seed=2)
    got = {(r.left_id, r.right_id) for r in tiles.hits(a, b, 0.6, block=13).collect()}
    s = u @ w.T
    assert got == {(i, j) for i in range(40) for j in range(90) if s[i, j] >= 0.6}


def test_tasks_do_not_grow_with_the_blocks(spark):
    df, _ = points(spark, 800)

    def kernel(met):
        yield pd.DataFrame({"tiles": [sum(1 for _ in met)]})

    tasks = [r.tiles for r in tiles.compare(df, None, kernel, "tiles long", block=8).collect() if r.tiles]
    assert len(tasks) <= tiles.SHARES * (tiles.SHARES + 1) // 2
    assert sum(tasks) > 4000  # some hundred blocks meet each other


def test_shares_are_shuffled_once_for_all_tasks(spark):
    """A side is written once: what the shuffle moves doesn't grow with the tasks that read it."""
    import numpy as np

    vectors = np.linalg.qr(np.random.default_rng(1).normal(size=(512, 512)))[0]
    rows = [(i, i, vectors[i].tolist()) for i in range(512)]
    df = spark.createDataFrame(rows, "id long, tag long, vec array<double>").repartition(4).localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executorList(False)))

    before = shuffled()
    assert len(tiles.hits(df, None, 0.5, block=32).collect()) == 0
    moved = shuffled() - before
    assert 0 < moved < 2 * 512 * 512 * 8


@pytest.mark.parametrize("keep", [1, 3])
def test_nearest_tags_with_ties(spark, keep):
    df, u = points(spark, 90, groups=30)
    df, u = df.union(df.selectExpr("id + 90", "tag + 30", "vec")), np.vstack([u, u])  # every tag has an exact copy
    got = {(r.left_tag, r.right_tag): r.score for r in tiles.nearest_tags(df, None, 0.1, keep, block=17).collect()}
    tag, scores = np.r_[np.arange(90) % 30, np.arange(90) % 30 + 30], u @ u.T
    for a in range(60):
        best = {b: scores[np.ix_(tag == a, tag == b)].max() for b in range(60) if b != a}
        reach = {b: x for b, x in best.items() if x >= 0.1}
        mine = {b: x for (t, b), x in got.items() if t == a}
        assert len(mine) == min(keep, len(reach))
        assert sorted(mine.values(), reverse=True) == pytest.approx(sorted(reach.values(), reverse=True)[:keep])
        assert all(x == pytest.approx(reach[b]) for b, x in mine.items())


@pytest.mark.parametrize("keep", [1, 3])
def test_best_two_of_the_leading_tags(spark, keep):
    """Whatever the number of hits, a row keeps the tags that lead at some threshold, with both their scores; equal vectors tie by tag."""
    thresholds = (0.1, 0.5, 0.8)
    a, u = points(spark, 25, seed=1)
    b, w = points(spark, 200, groups=40, seed=2)
    b, w = b.union(b.selectExpr("id + 200", "tag + 40", "vec")), np.vstack([w, w])
    got = {(r.left_id, r.right_tag): (r.first, r.second) for r in tiles.best_two(a, b, 0.1, keep, thresholds, 0.5, block=17).collect()}
    tag, scores, want = np.r_[np.arange(200) % 40, np.arange(200) % 40 + 40], np.round(u @ w.T, 12), {}
    for i in range(25):
        two = {t: [s for s in sorted(scores[i][tag == t], reverse=True)[:2] if s >= 0.1] for t in range(80)}
        for at in thresholds:
            score = {t: sum(x for x in s if x >= at) / sum(x >= at for x in s) for t, s in two.items() if s and s[0] >= at}
            for t in sorted(score, key=lambda t: (-score[t], t))[:keep]:
                want[i, t] = tuple((two[t] + [None])[:2])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_point_scores_are_a_few_rows_a_tracklet(spark):
    a, _ = points(spark, 10, seed=1)
    b, _ = points(spark, 1500, dim=8, groups=1500, seed=2)
    t, g = a.selectExpr("id AS tracklet_id", "vec"), b.selectExpr("id AS point_id", "tag AS entity_id", "vec").union(
        a.crossJoin(spark.range(300).withColumnRenamed("id", "k")).selectExpr("5000 + id * 300 + k", "5000 + id * 300 + k", "vec"))
    per = {r.tracklet_id: r["count"] for r in resolve.point_scores(t, g, block=64).groupBy("tracklet_id").count().collect()}
    assert len(per) == 10 and max(per.values()) <= 5 * len(resolve.SEARCHES)


def test_closest_entities_skip_the_excluded(spark):
    df, _ = points(spark, 60, groups=12)
    g = df.selectExpr("id AS point_id", "tag AS entity_id", "vec")
    pairs = similarity.entity_pairs(g, 0.0)
    first = similarity.duplicate_candidates(pairs, 0.0)
    barred = first.select("entity_id", "other_id")
    want = similarity.duplicate_candidates(pairs, 0.0, excluded=barred).select("entity_id", "other_id").collect()
    got = similarity.closest_entities(g, 0.0, 0.0, excluded=barred).select("entity_id", "other_id").collect()
    assert sorted(got) == sorted(want) and want


def test_zero_vector_and_empty_gallery(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "query_id long, vec array<double>")
    g = spark.createDataFrame([(5, 7, [1.0, 0.1])], "point_id long, entity_id long, vec array<double>")
    assert [r.query_id for r in similarity.search(q, g, 0.7).collect()] == [2]
    assert similarity.search(q, g.where("false"), 0.7).count() == 0


def test_second_hit_counts_only_above_threshold(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    g = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 7, [0.6, 0.8]), (3, 8, [0.9, 0.43589])], "point_id long, entity_id long, vec array<double>")
    got = {r.entity_id: round(r.score, 3) for r in similarity.search(q, g, 0.7).collect()}
    assert got == {7: 1.0, 8: 0.9}
    low = {r.entity_id: round(r.score, 3) for r in similarity.search(q, g, 0.5).collect()}
    assert low[7] == 0.8


def test_sweep_totals(spark):
    df, u = points(spark, 60)
    items = df.withColumnRenamed("tag", "label")
    rows = evaluate.threshold_sweep(items, block=17).collect()
    n = 60 * 59 // 2
    assert len(rows) == 46 and all(r.tp + r.fp + r.tn + r.fn == n for r in rows)


def test_cascade_paths(spark):
    far = [0.0, 0.0, 1.0]
    cols = ("tracklet_id long, track_id long, vec array<double>, v_avg double, vector_consistency double, entry_count long, quality_frames long,"
            " max_overlap double, current_id long, hint_id long, attempts int, was_ambiguous boolean")
    base = dict(v_avg=0.9, vc=0.9, n=8, hq=4, ov=0.1, cur=None, hint=None, att=0, amb=False)

    def row(i, vec, **kw):
        p = {**base, **kw}
        return (i, kw.get("track", i), vec, p["v_avg"], p["vc"], p["n"], p["hq"], p["ov"], p["cur"], p["hint"], p["att"], p["amb"])

    gallery = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0]), (2, 2, [0.0, 1.0, 0.0])], "point_id long, entity_id long, vec array<double>")
    half = [0.71, 0.70, 0.05]
    data = [
        row(1, [1.0, 0.1, 0.0]), row(2, far), row(3, far, n=3), row(4, far, v_avg=0.5), row(5, [1.0, 0.1, 0.0], vc=0.4),
        row(6, [0.65, 0.0, 0.76]), row(7, [0.6, 0.0, 0.8], cur=1), row(8, [0.1, 0.0, 1.0], cur=1), row(9, [0.65, 0.0, 0.76], hint=1),
        row(10, far, hq=1), row(11, half, v_avg=0.5), row(12, far, v_avg=0.5, att=4), row(13, [1.0, 0.1, 0.0], cur=2),
    ]
    out = {r.tracklet_id: r for r in resolve.cascade(resolve.with_scores(spark.createDataFrame(data, cols), gallery)).collect()}
    want = {1: "gallery_match", 2: "new_identity", 3: "tentative_pending", 4: "tentative_pending", 5: "consistency_rejected",
            6: "near_gallery_deferred", 7: "current_identity_maintained", 8: "new_identity", 9: "spatial_appearance_reuse",
            10: "new_identity_blocked", 11: "tentative_pending", 12: "tentative_pending", 13: "gallery_match"}
    assert {k: v.method for k, v in out.items()} == want
    assert out[3].source == "provisional_short_tracklet" and out[10].source == "new_detection__gate_high_quality_frames"
    assert out[6].suggested_id == 1 and out[1].entity_id == 1 and out[13].entity_id == 1
    assert out[8].entity_id is None


def test_prune_keeps_the_most_diverse_of_a_crowded_key(spark):
    r = np.random.default_rng(3)
    vecs = r.normal(size=(120, 6))
    vecs[50] = vecs[7]  # an exact copy
    keys = [1 if i % 10 else 2 + i // 60 for i in range(120)]  # one key holds nine in ten rows
    rows = [(i, keys[i], "main", 1000 + (i * 37) % 120, vecs[i].tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "point_id long, entity_id long, kind string, s long, vec array<double>")
    df = df.withColumn("added_at", F.timestamp_seconds("s"))
    got = {(x.entity_id, x.point_id) for x in gallery.prune(df, keep=5).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = set()
    for key in set(keys):
        own = [i for i in range(120) if keys[i] == key]
        kept = [max(own, key=lambda i: (rows[i][3], i))]
        while len(kept) < min(5, len(own)):
            rest = [i for i in own if i not in kept]
            kept.append(max(rest, key=lambda i: (round(1 - max(unit[i] @ unit[k] for k in kept), 9), -rows[i][3], -i)))
        want |= {(key, i) for i in kept}
    assert got == want
    assert gallery.prune(df.where("false")).count() == 0


def test_tracklet_vectors_of_few_frames(spark):
    cols = "tracklet_id string, frame_no long, v_score double, overlap_ratio double, vec array<double>"
    rows = [("one", 1, 0.5, 0.9, [3.0, 4.0]), ("crowd", 1, 0.8, 0.0, [1.0, 0.0]), ("crowd", 2, 0.8, 0.1, [1.0, 0.1]),
            ("crowd", 3, 0.9, 0.6, [0.0, 1.0]), ("zero", 1, 0.7, 0.0, [0.0, 0.0])]
    got = {r.tracklet_id: r for r in aggregation.tracklet_vectors(spark.createDataFrame(rows, cols)).collect()}
    assert got["one"].vec == pytest.approx([0.6, 0.8]) and got["one"].consistency == 1.0
    assert got["crowd"].frames == [1, 2] and got["crowd"].vec[0] > 0.99
    assert got["zero"].vec == [0.0, 0.0]


def test_weighted_mean_of_frames_without_weight(spark, tmp_path):
    """A tracklet whose only frame has a visibility of 0 is not a number in SQL."""
    import duckdb

    from sightline import catalog

    queries, sql = catalog.load()
    sf = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 1000 < 2")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{sf}/embeddings.parquet").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {r[0]: repr(r[1:]) for r in con.execute(sql["weighted_vector_mean"]).fetchall()}
    got = {r.tracklet_id: repr((r.first, r.last, r.total)) for r in queries["weighted_vector_mean"](spark, str(tmp_path)).collect()}
    assert "(nan, nan, nan)" in want.values() and got == want


def test_norms_are_worked_out_once_a_vector(spark):
    from sightline.functions import vectors as v

    plan = spark.createDataFrame([([1.0, 2.0],)], "vec array<double>").select(v.l2_normalise(F.col("vec")))._jdf.queryExecution().optimizedPlan().toString()
    assert "/ sqrt" not in plan.lower()  # the divisor of each element is a value, not an expression


def tile(n, m, dim=16, seed=0, same=False):
    r = np.random.default_rng(seed)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.normal(size=(n, dim)), r.normal(size=(m, dim))))
    b = a if same else b
    ids = np.arange(n + m)
    right = ids[:m] if same else ids[n:]
    return tiles.Tile(ids[:n], ids[:n] // 2, a, right, right // 2, b, same, 0, 0 if same else 1, a.astype(np.float32), b.astype(np.float32))


def test_single_precision_leaves_scores_exact():
    """A floor that is one of the scores: rounding may not lose it, nor take in the one below."""
    for same in (False, True):
        t = tile(90, 90, seed=3, same=same)
        s = t.left @ t.right.T
        floor = np.sort(s[np.triu_indices(90, 1)])[-200]
        i, j, scores = t.reaching(floor - 1e-13)
        want = {(a, b) for a, b in zip(*np.nonzero(s >= floor - 1e-13)) if not same or a < b}
        assert set(zip(i.tolist(), j.tolist())) == want and scores == pytest.approx(s[i, j], abs=1e-13)
    mask = np.random.default_rng(1).random((37, 11)) < 0.05
    assert all((x == y).all() for x, y in zip(tiles.where(mask), np.nonzero(mask)))


def test_few_scores_are_looked_at_one_by_one(monkeypatch):
    """With a low floor one score in three is a hit; a row wants its three nearest tags only."""
    looked, scores = [], tiles.Tile.scores
    monkeypatch.setattr(tiles.Tile, "scores", lambda self, i, j: looked.append(len(i)) or scores(self, i, j))
    t = tile(1500, 1500, seed=5)
    rows, columns = tiles.Nearest(t.left_tags, 3, 0.1), tiles.Nearest(t.right_tags, 3, 0.1)
    tiles.meet(t, rows, columns, True)
    s = np.round(t.left @ t.right.T, tiles.DIGITS)
    assert 0 < sum(looked) < (s >= 0.1).sum() / 20
    for side, own, other, table in ((rows, t.left_tags, t.right_tags, s), (columns, t.right_tags, t.left_tags, s.T)):
        got = side.rows(["a", "b", "s"]).groupby("a")
        for k in range(0, 1500, 211):
            best = {}
            for x, tag in sorted(zip(table[k], other), reverse=True):
                best.setdefault(int(tag), x)
            mine = [(x, tag) for r, x, tag in zip(side.row, side.score, side.tag) if r == k]
            assert mine == [(pytest.approx(x, abs=1e-11), tag) for tag, x in sorted(best.items(), key=lambda p: -p[1])[:3]]
        assert len(got) == len(set(own))


def test_rows_of_a_label_meet_without_the_rest(spark):
    df, _ = points(spark, 1200, groups=300)
    items = df.withColumnRenamed("tag", "label")

    def kernel(met):
        yield pd.DataFrame({"tiles": [sum(1 for _ in met)]})

    assert sum(r.tiles for r in tiles.compare(items, None, kernel, "tiles long", tag_col="label", block=40, within=True).collect()) < 150  # of 465


def test_distribution_and_separation_of_labels(spark):
    df, u = points(spark, 150, groups=9)
    label = np.where(np.arange(150) % 9 == 8, 0, np.arange(150) % 9).astype(float)
    label[7::40] = np.nan
    items = df.selectExpr("id", "CASE WHEN id % 40 = 7 THEN NULL WHEN tag = 8 THEN 0 ELSE tag END AS label", "vec")
    s = u @ u.T
    i, j = np.triu_indices(150, 1)
    same = label[i] == label[j]
    got = {r.same: r for r in evaluate.score_distribution(items, block=17).collect()}
    for k in (True, False):
        v = np.round(s[i, j][same == k], evaluate.DIGITS)
        assert got[k].pairs == len(v) and got[k]["max"] == pytest.approx(v.max())
        assert [got[k][f"p{int(p * 100):02d}"] for p in (.05, .5, .99)] == pytest.approx(np.quantile(v, [.05, .5, .99]).tolist())
    for r in evaluate.per_label(items, block=17).collect():
        mine = np.flatnonzero(label == r.label)
        inside = np.round([s[a, b] for a in mine for b in mine if a < b], evaluate.DIGITS)
        near = np.array([s[a][label != r.label].max() for a in mine])
        assert r["count"] == len(mine) and r.same_p05 == pytest.approx(np.quantile(inside, .05)) and r.same_p50 == pytest.approx(np.quantile(inside, .5))
        assert r.nearest_negative_mean == pytest.approx(near.mean()) and r.nearest_negative_p95 == pytest.approx(np.quantile(near, .95))
