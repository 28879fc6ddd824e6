"""A spread of registered queries against their SQL, and the entry points."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ("entity_search", "sighting_aggregation_hour", "global_stats", "device_lookup", "cutoff_score", "box_iou", "visibility_score",
          "stride_sampling", "tracklet_consistency", "spaced_top_k_frames", "adaptive_frame_skip", "gallery_search", "tracklet_label_vote",
          "label_hysteresis", "covisibility_exclusion", "minimum_frame_gap", "closest_transition", "track_ids", "merge_decisions",
          "candidate_upsert", "stream_tracklets", "untracked_clusters", "appearance_split", "weighted_vector_mean", "vector_consensus")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    text, _, ok = check.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reconcile_has_no_cycle_and_reaches_a_fixpoint(spark):
    from sightline.catalog import merging
    from sightline.plans import merge

    t = merging.tables_of(spark, SF)
    merges = merge.reconcile(t)
    pairs = [(r.source_id, r.target_id) for r in merges.collect()]
    sources = [s for s, _ in pairs]
    assert len(sources) == len(set(sources)) and not set(sources) & {x for _, x in pairs}
