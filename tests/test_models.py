"""Batched model calls with a stand-in model."""

from sightline.functions import models


def test_vectors_and_labels(spark):
    df = spark.createDataFrame([(i, bytes([i, i + 1])) for i in range(70)], "id long, content binary")

    def vectors(images):
        assert len(images) <= 32
        return [[float(b[0]), float(b[1])] for b in images]

    def labels(images):
        return [{"kind": {"label": "a" if b[0] % 2 else "b", "confidence": 0.9}} for b in images]

    got = {r.id: r.vec for r in models.extract_vectors(df, vectors).collect()}
    assert got[5] == [5.0, 6.0] and len(got) == 70
    named = {r.id: r.labels["kind"]["label"] for r in models.extract_labels(df, labels).collect()}
    assert named[4] == "b" and named[5] == "a"
