"""Token totals kept by deltas.

A batch of changes (insert, delete, revise) becomes signed rows by document; their sums by source, language and tokenizer version
are the batch's delta. State and delta of a batch go to folders of the attempt; a manifest that names them, written last, commits both
at once, so a lost attempt leaves nothing and committing again changes no total. Totals are the sum of the committed deltas; the last
state of each document says what a delete or a revision takes back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .text import WORD, slices, strings

GROUP = ("source", "lang", "version")
STATE = "doc_id long, source string, lang string, version string, tokens long, alive boolean, batch long"
MANIFEST = "batch long, attempt string"
DELTA = "source string, lang string, version string, docs long, tokens long, batch long"


def words() -> Callable[[Column], Column]:
    """Counts runs of anything but ASCII white space."""
    return lambda text: F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bpe_counts(docs: DataFrame, path: str, name: str) -> DataFrame:
    """``docs`` with the number of BPE tokens of ``text`` in column ``name``, and without the text."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n = [len(run(t)) for t in strings(part, "text")]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(n, pa.int64())], [*(f.name for f in kept), name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(make, f"{fields}, `{name}` long")


class Rollup:
    """Totals in a folder that all executors share: ``state`` and ``delta``, a sub-folder an attempt, and ``commit``, a manifest a batch.

    ``tokenizers`` maps a version to a path of BPE ranks, or to a function from the text column to a count.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, str | Callable[[Column], Column]]) -> None:
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), tokenizers

    def _committed(self) -> dict[int, str]:
        """The attempt that each committed batch is made of. The manifests are a line a batch."""
        of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        path = of(f"{self.folder}/commit")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [str(s.getPath()) for s in fs.listStatus(path) if fs.exists(of(f"{s.getPath()}/_SUCCESS"))] if fs.exists(path) else []
        return {r.batch: r.attempt for r in self.spark.read.schema(MANIFEST).parquet(*names).collect()} if names else {}

    def _read(self, what: str, schema: str, attempts: list[str]) -> DataFrame:
        names = [f"{self.folder}/{what}/{x}" for x in attempts]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _counted(self, rows: DataFrame) -> DataFrame:
        """One row a document and version."""
        native = {v: f for v, f in self.tokenizers.items() if callable(f)}
        out = rows.select("doc_id", "source", "lang", "alive", "text", *[f(F.col("text")).alias(f"n:{v}") for v, f in native.items()])
        rest = {v: p for v, p in self.tokenizers.items() if v not in native}
        for k, (v, p) in enumerate(rest.items()):
            out = bpe_counts(out if k == len(rest) - 1 else out.withColumn("_keep", F.col("text")), p, f"n:{v}")
            out = out.withColumnRenamed("_keep", "text")
        pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"`n:{v}`").alias("tokens")) for v in self.tokenizers]))
        return out.select("doc_id", "source", "lang", "alive", pairs.alias("t")).select("doc_id", "source", "lang", "t.version", "t.tokens", "alive")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Apply ``changes`` (op, doc_id, text, source, lang) as batch number ``batch``.

        Committing the last batch again replaces it. A committed batch that others followed stays as it is; a new batch
        below the last is a ValueError, since what it takes back would depend on what came after it.
        op is insert, revise (both set the document's counts) or delete. Of several changes of a document the greatest by (op, text, source, lang) counts, whatever
        their order; null ids and unknown ops are ignored; deleting what isn't there changes nothing; a null text has no tokens.
        """
        committed = self._committed()
        if batch < max(committed, default=batch):
            if batch in committed:
                return
            raise ValueError(f"batch {batch} comes after batch {max(committed)}")
        attempt = f"batch={batch:08d}-{uuid.uuid4().hex}"
        known = changes.filter(F.col("doc_id").isNotNull() & F.col("op").isin("insert", "revise", "delete"))
        order = F.struct("op", F.xxhash64("text", "source", "lang").alias("h"))
        best = known.groupBy("doc_id").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("n"))
        many = best.filter("n > 1").select("doc_id", "best")
        if many.isEmpty():  # then no text has to be shuffled
            rows = known
        else:
            rows = known.join(many, "doc_id", "left").filter(F.col("best").isNull() | (order == F.col("best")))
        rows = rows.withColumn("alive", F.col("op") != "delete")
        fresh = self._counted(rows.filter("alive")).dropDuplicates(["doc_id", "version"])
        old = self._last(self._read("state", STATE, [a for b, a in committed.items() if b < batch]).join(known.select("doc_id").distinct(), "doc_id", "left_semi")).filter("alive")
        gone = rows.filter("not alive").select("doc_id").distinct()
        dead = old.join(gone, "doc_id", "left_semi").withColumn("alive", F.lit(False)).select(*fresh.columns)
        state = fresh.unionByName(dead).withColumn("batch", F.lit(batch).cast("long"))
        state.select(*[c.split()[0] for c in STATE.split(", ")]).write.parquet(f"{self.folder}/state/{attempt}")
        now = self._read("state", STATE, [attempt]).filter("alive")
        signed = now.select(*GROUP, F.lit(1).alias("d"), "tokens").unionByName(old.select(*GROUP, F.lit(-1).alias("d"), (-F.col("tokens")).alias("tokens")))
        delta = signed.groupBy(*GROUP).agg(F.sum("d").alias("docs"), F.sum("tokens").alias("tokens")).withColumn("batch", F.lit(batch).cast("long"))
        delta.write.parquet(f"{self.folder}/delta/{attempt}")
        done = self.spark.createDataFrame([(batch, attempt)], MANIFEST)
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commit/batch={batch:08d}")

    @staticmethod
    def _last(state: DataFrame) -> DataFrame:
        """Each document's last state by version."""
        return state.groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "tokens", "alive"), "batch").alias("s")).select("doc_id", "version", "s.*")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) of all committed batches; groups whose documents are all gone are left out."""
        return self._read("delta", DELTA, list(self._committed().values())).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")
