"""Gap-free numbering of a whole table without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

ROW_BITS = 33


def with_number(df: DataFrame, order: Sequence[str], start: int = 1, name: str = "number",
                partitions: int | None = None) -> DataFrame:
    """Range-partition by ``order``, sort inside each range, then shift every
    range by the rows before it. Only one count per range is brought together."""
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_range", F.shiftright("_mid", ROW_BITS)).withColumn(
        "_inside", F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    # one row per range: never more than ``partitions`` rows
    return placed.join(F.broadcast(offsets), "_range").select(
        *df.columns, (F.lit(start) + F.col("_before") + F.col("_inside")).cast("long").alias(name)
    )
