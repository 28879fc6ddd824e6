"""Tables that grow by batches: what a batch adds to all of them becomes visible at once, or not at all.

A batch writes its rows of every table to folders of its own and then one manifest that names them. Readers follow manifests only,
so rows of a batch that died are never seen; a batch whose manifest exists is not written again, so a retry changes nothing. Folded
tables are written as a new base by ``compact``, which is a manifest too; older versions stay readable. A store has one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "seq long, batch long, kind string, name string, folder string"


class Store:
    """``path`` is a folder that all executors share; ``schemas`` name the tables and their columns as DDL."""

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str]) -> None:
        self.spark, self.path, self.schemas = spark, path, dict(schemas)

    def manifests(self) -> list:
        """All manifest rows in order: a few for each batch or base, never rows of a table."""
        try:
            rows = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifests")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # nothing was committed yet
                return []
            raise
        return sorted(rows.collect(), key=lambda r: (r.seq, r.name))

    def last_batch(self) -> int:
        return max((r.batch for r in self.manifests()), default=-1)

    def commit(self, batch: int, rows: Mapping[str, DataFrame], partition_by: Mapping[str, Sequence[str]] | None = None) -> bool:
        """Add the rows of a batch to their tables; False, and nothing done, if the batch is there already. Batches come in order."""
        done = self.manifests()
        if any(r.kind == "delta" and r.batch == batch for r in done):
            return False
        if any(r.batch >= batch for r in done):
            raise ValueError(f"batch {batch} comes after a later one")
        self._write(done, batch, "delta", rows, partition_by or {})
        return True

    def compact(self, folds: Mapping[str, Callable[[DataFrame], DataFrame]], partition_by: Mapping[str, Sequence[str]] | None = None) -> None:
        """Write each table, as ``folds`` makes it of all its rows, as the base for later reads."""
        done = self.manifests()
        if done:
            self._write(done, max(r.batch for r in done), "base", {n: fold(self.read(n)) for n, fold in folds.items()}, partition_by or {})

    def _write(self, done: list, batch: int, kind: str, rows: Mapping[str, DataFrame], partition_by: Mapping[str, Sequence[str]]) -> None:
        seq = max((r.seq for r in done), default=-1) + 1
        named = []
        for name, df in rows.items():
            folder = f"{self.path}/data/{name}/{batch}-{kind}-{uuid.uuid4().hex}"
            columns = [F.col(f.name).cast(f.dataType) for f in self._fields(name)]
            keys = list(partition_by.get(name, ()))
            out = df.select(*columns, F.lit(batch).cast("long").alias("batch") if "batch" not in df.columns or kind == "delta" else F.col("batch"))
            (out.repartition(*keys).write.partitionBy(*keys) if keys else out.write).parquet(folder)
            named.append((seq, batch, kind, name, folder))
        # one file, so the manifest is there as a whole or not; a folder without one is what a writer left that died
        self.spark.createDataFrame(named, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{seq:09d}")

    def _fields(self, name: str):
        return self.spark.createDataFrame([], self.schemas[name]).schema.fields

    def read(self, name: str, upto: int | None = None) -> DataFrame:
        """All rows of a table with their ``batch``, as they stood after batch ``upto``: the last base and the deltas after it."""
        seen = [r for r in self.manifests() if r.name == name and (upto is None or r.batch <= upto)]
        bases = [r for r in seen if r.kind == "base"]
        parts = [r for r in seen if r.kind == "delta" and (not bases or r.seq > bases[-1].seq)] + bases[-1:]
        return self._rows(name, parts)

    def deltas(self, name: str) -> DataFrame:
        """All rows that batches added, whatever was folded since, with their ``batch``."""
        return self._rows(name, [r for r in self.manifests() if r.name == name and r.kind == "delta"])

    def _rows(self, name: str, parts: list) -> DataFrame:
        out = self.spark.createDataFrame([], f"{self.schemas[name]}, batch long")
        for r in parts:
            out = out.unionByName(self.spark.read.option("basePath", r.folder).parquet(r.folder))
        return out
