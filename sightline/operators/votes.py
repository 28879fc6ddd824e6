"""Label votes: per tracklet, per entity, and with hysteresis over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LABELS, UNKNOWN


def vote(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and task the label with the largest confidence sum; its mean is
    the result's confidence. Two partial aggregates; equal sums go to the smaller label."""
    tally = rows.groupBy(*keys, "task", "label").agg(
        F.sum("confidence").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    row = F.struct("label", F.round(F.col("_sum") / F.col("_n"), 4).alias("confidence"))
    best = tally.groupBy(*keys, "task").agg(
        F.min_by(row, F.struct((-F.round("_sum", 6)).alias("s"), F.col("label"))).alias("_best")
    )
    return best.select(*keys, "task", "_best.label", "_best.confidence")


def tracklet_vote(rows: DataFrame, keys: Sequence[str] = ("tracklet_id",)) -> DataFrame:
    """Every frame votes, unknown labels included."""
    return vote(rows.where(F.col("label").isNotNull()), keys)


def entity_vote(rows: DataFrame, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Sightings with an unknown label or no confidence do not vote."""
    usable = F.col("label").isNotNull() & (F.col("label") != "") & (F.col("label") != UNKNOWN)
    return vote(rows.where(usable & (F.col("confidence") > 0)), keys)


def committed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], floor: float = LABELS.committed,
              runs: int = LABELS.committed_runs) -> DataFrame:
    """Keys whose latest ``runs`` confident labels all agree, with that label."""
    sure = rows.where(F.col("label").isNotNull() & (F.col("label") != UNKNOWN) & (F.col("confidence") >= floor))
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    recent = sure.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= runs)
    same = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("label"), F.max("label").alias("_m"))
    return same.where((F.col("_n") == runs) & (F.col("label") == F.col("_m"))).select(*keys, "label")


def committed_disagreement(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose sides are committed to different labels."""
    a = labels.select(F.col("entity_id").alias("entity_a"), F.col("label").alias("label_a"))
    b = labels.select(F.col("entity_id").alias("entity_b"), F.col("label").alias("label_b"))
    return pairs.join(a, "entity_a").join(b, "entity_b").where(F.col("label_a") != F.col("label_b"))
