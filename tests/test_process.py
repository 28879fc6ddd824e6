"""The store's batches and what merges do to it; the tables of two batches are compared with SQL in the registry test."""

import uuid

import pytest
from pyspark.sql import functions as F

from sightline.catalog.streams import scratch
from sightline.plans import process, store

SCHEMAS = {"a": "id long, x string", "b": "id long"}


def rows(spark, ids):
    return spark.createDataFrame([(i, f"x{i}") for i in ids], SCHEMAS["a"])


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_batch_is_there_once_and_in_order(spark):
    s = store.Store(spark, scratch(spark), SCHEMAS)
    assert s.read("a").count() == 0 and s.last_batch() == -1
    assert s.commit(1, {"a": rows(spark, [1, 2]), "b": rows(spark, [7])})
    assert not s.commit(1, {"a": rows(spark, [1, 2, 3])})
    assert s.commit(4, {"a": rows(spark, [3])})
    with pytest.raises(ValueError):
        s.commit(3, {"a": rows(spark, [9])})
    assert ids(s.read("a")) == [1, 2, 3] and ids(s.read("a", upto=3)) == [1, 2] and ids(s.read("b")) == [7]
    assert {(r.id, r.batch) for r in s.read("a").collect()} == {(1, 1), (2, 1), (3, 4)}


def test_rows_without_a_manifest_are_not_seen(spark):
    s = store.Store(spark, scratch(spark), SCHEMAS)
    s.commit(1, {"a": rows(spark, [1])})
    broken = rows(spark, [5]).withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        s.commit(2, {"a": rows(spark, [4]), "b": broken.where("x IS NOT NULL")})
    assert ids(s.read("a")) == [1] and s.read("b").count() == 0
    assert s.commit(2, {"a": rows(spark, [4]), "b": rows(spark, [6])})
    assert ids(s.read("a")) == [1, 4] and ids(s.read("b")) == [6]


def test_compaction_changes_no_answer(spark):
    s = store.Store(spark, scratch(spark), SCHEMAS)
    for batch, some in ((1, [1, 2]), (2, [3]), (3, [4])):
        s.commit(batch, {"a": rows(spark, some)})
        if batch == 2:
            s.compact({"a": lambda df: df})
    assert ids(s.read("a")) == [1, 2, 3, 4] and ids(s.read("a", upto=1)) == [1, 2]
    assert s.read("a").select("batch").distinct().count() == 3
    assert not s.commit(2, {"a": rows(spark, [8])})


def point(spark, some):
    return spark.createDataFrame([(p, e, [1.0, float(p)], a, None) for p, e, a in some], "point_id long, entity_id long, vec array<double>, is_anchor boolean, added_at timestamp")


def entity(spark, some):
    stamp = [F.lit(f"2024-01-0{k} 00:00:00").cast("timestamp") for k in (1, 2)]
    return spark.createDataFrame(some, "entity_id long, sighting_count long, dev string").select(
        "entity_id", (stamp[0] + F.make_dt_interval(hours=F.col("entity_id").cast("int"))).alias("first_seen_at"), F.col("dev").alias("first_seen_device"),
        (stamp[1] + F.make_dt_interval(hours=F.col("entity_id").cast("int"))).alias("last_seen_at"), F.col("dev").alias("last_seen_device"), "sighting_count",
        F.lit("new_identity").alias("source"), F.lit(True).alias("is_active"))


def test_merges_move_points_and_counts(spark):
    s = process.open_store(spark, scratch(spark))
    s.commit(1, {"entities": entity(spark, [(1, 5, "p"), (2, 3, "q"), (66, 2, "r")]),
                 "gallery": process.change(point(spark, [(10, 1, True), (20, 2, True), (21, 2, False), (30, 66, True)]), "add")}, process.PARTITIONS)
    merges = spark.createDataFrame([(2, 1)], "source_id long, target_id long")
    assert process.apply_merges(s, 2, merges) and not process.apply_merges(s, 2, merges)
    process.apply_merges(s, 3, spark.createDataFrame([(1, 66)], "source_id long, target_id long"))
    got = {r.point_id: (r.entity_id, r.is_anchor) for r in process.points(s).collect()}
    assert got == {10: (66, False), 20: (66, False), 21: (66, False), 30: (66, True)}
    before = {r.point_id: r.entity_id for r in process.points(s, upto=1).collect()}
    assert before == {10: 1, 20: 2, 21: 2, 30: 66}
    # 2 and 66 share a bucket: a bucket answers for itself
    own = spark.createDataFrame([(66,)], "entity_id long").select(process.bucket().alias("bucket"))
    assert {r.point_id for r in process.points(s, buckets=own).collect()} == {10, 20, 21, 30}
    left = {r.entity_id: (r.sighting_count, r.is_active) for r in process.entities(s).collect()}
    assert left == {1: (0, False), 2: (0, False), 66: (10, True)}
    assert {(r.source_id, r.target_id) for r in process.survivors(s).collect()} == {(1, 66), (2, 66)}
    process.compact(s)
    assert {r.point_id: (r.entity_id, r.is_anchor) for r in process.points(s).collect()} == got
    assert {r.entity_id: (r.sighting_count, r.is_active) for r in process.entities(s).collect()} == left


def test_a_point_added_and_dropped_in_one_batch_is_gone(spark):
    s = process.open_store(spark, f"{scratch(spark)}-{uuid.uuid4().hex}")
    some = point(spark, [(1, 1, True), (2, 1, False)])
    s.commit(1, {"gallery": process.change(some, "add").unionByName(process.change(some.where("point_id = 2"), "drop"))}, process.PARTITIONS)
    assert [r.point_id for r in process.points(s).collect()] == [1]


def test_points_that_were_dropped_are_still_known(spark):
    s = process.open_store(spark, scratch(spark))
    some = point(spark, [(1, 1, True), (2, 1, False), (3, 1, False)])
    s.commit(1, {"gallery": process.change(some.where("point_id < 3"), "add")}, process.PARTITIONS)
    s.commit(2, {"gallery": process.change(some.where("point_id = 3"), "add").unionByName(process.change(some.where("point_id <> 1"), "drop"))}, process.PARTITIONS)
    for _ in range(2):
        assert [r.point_id for r in process.points(s).collect()] == [1]
        assert sorted((r.point_id, r.entity_id, r.is_anchor) for r in process.dropped(s).collect()) == [(2, 1, False), (3, 1, False)]
        process.compact(s)


def test_a_crowded_gallery_lists_all_points_that_were_added(spark, monkeypatch):
    """More points than a gallery keeps: the query has them all, as its SQL has."""
    from sightline.catalog import processing, registry

    s = process.open_store(spark, scratch(spark))
    many = point(spark, [(i, 1, i == 0) for i in range(12)]).withColumn("added_at", F.timestamp_seconds("point_id"))
    confirmed = many.select(F.col("point_id").alias("tracklet_id"), "entity_id", "vec", F.col("added_at").alias("ended_at"), F.when(F.col("is_anchor"), "new_identity").otherwise("gallery_match").alias("method"),
                            *[F.lit(x).alias(c) for c, x in (("max_overlap", 0.0), ("overall", 1.0), ("v_avg", 1.0), ("vector_consistency", 1.0), ("entry_count", 9))])
    s.commit(1, {"gallery": process.grown(s, confirmed, process.points(s))}, process.PARTITIONS)
    assert process.points(s).count() == 8
    monkeypatch.setattr(processing, "_two_batches", lambda *_: s)
    got = registry.QUERIES["process_gallery"](spark, "").collect()
    assert sorted((r.point_id, r.is_anchor) for r in got) == [(i, i == 0) for i in range(12)]


def test_new_vectors_that_tie_link_to_the_smallest_id(spark, monkeypatch):
    """Products of equal vectors may differ in the last digit, by their place in a matrix; they tie all the same."""
    from sightline.plans import resolve

    scores = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9 + 2e-16), (2, 3, 0.9)], "left_id long, right_id long, score double")
    monkeypatch.setattr(resolve.tiles, "hits", lambda *_, **__: scores)
    new = spark.createDataFrame([(i, "new_identity", [1.0]) for i in (1, 2, 3)], "entity_id long, method string, vec array<double>")
    assert [(r.source_id, r.target_id) for r in resolve.linked_new(new).collect()] == [(2, 1)]


def test_stored_batches_are_those_of_the_table(spark, tmp_path, monkeypatch):
    """Another table at the same path, or a store that is gone, is processed anew."""
    from sightline.catalog import processing

    def fake(s, batch, tracklets):
        return s.commit(batch, {"candidates": tracklets.select(*[
            F.col("tracklet_id").alias(c) if c == "candidate_id" else F.lit(None).alias(c) for c in (f.name for f in s._fields("candidates"))])})

    def stored(n):
        vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "vec_id long, embedding array<float>")
        vectors.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        s = processing._two_batches(spark, str(tmp_path))
        return s.path, s.read("candidates").count()

    monkeypatch.setattr(process, "process", fake)
    first, second = stored(5), stored(9)
    assert (first[1], second[1]) == (16, 32)
    assert stored(9)[0] == second[0]
    for key in processing._STORED:
        monkeypatch.setitem(processing._STORED, key, f"{scratch(spark)}/gone")
    assert stored(9)[1] == 32
