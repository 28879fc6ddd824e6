"""Helpers that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import ensure_checkpoint_dir

#: words of the corpus: runs of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: Column, folds: int) -> Column:
    """Remainder of crc32 of the key written as text; null keys fall in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes in ``column`` (at least a row each)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    for cut in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
        yield batch.slice(int(cut[0]), len(cut))


def raw(batch: pa.RecordBatch | pa.Table, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column, nulls as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch | pa.Table, column: str) -> list[str]:
    """A text column, nulls as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_slices(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """Map bounded slices of the rows with ``make``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield make(part)

    return df.mapInArrow(over, schema)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in the whole table, which size partitions and sketches."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to shared storage as a table and read again: columns take a fraction of the room that checkpointed rows do."""
    path = path or shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
