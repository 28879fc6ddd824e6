"""Frame messages: reading, normalising, grouping back and writing.

A file folder stands in for the message bus where its connector is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import UNKNOWN

DETECTION = T.StructType([
    T.StructField("bbox", T.ArrayType(T.FloatType())), T.StructField("confidence", T.FloatType()),
    T.StructField("class_id", T.IntegerType()), T.StructField("visibility_score", T.FloatType()),
    T.StructField("overlap_ratio", T.FloatType()), T.StructField("visibility_tag", T.StringType())])
FRAME = T.StructType([
    T.StructField("device_id", T.StringType()), T.StructField("frame_number", T.LongType()),
    T.StructField("detections", T.ArrayType(DETECTION)), T.StructField("created_at", T.LongType()),
    T.StructField("image_data", T.BinaryType())])
SCHEMA_VERSION = 3


def frame_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = FRAME,
                 max_files: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def bus_stream(spark: SparkSession, servers: str, topic: str, avro_schema: str) -> DataFrame:
    """The message-bus form; needs the Kafka and Avro packages on the cluster."""
    from pyspark.sql.avro.functions import from_avro

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(from_avro("value", avro_schema).alias("m")).select("m.*")


def detected(frames: DataFrame) -> DataFrame:
    """Heartbeat frames carry no detections and are left out."""
    return frames.where(F.size("detections") > 0)


def end_of_stream(frame: str = "frame_number") -> Column:
    image = F.col("image_data")
    return (F.col(frame) < 0) & (F.coalesce(F.size("detections"), F.lit(0)) <= 0) & (image.isNull() | (F.length(image) == 0))


def to_detections(frames: DataFrame) -> DataFrame:
    """One row per detection."""
    rows = detected(frames).select("device_id", F.col("frame_number").alias("frame_no"), "created_at",
                                   F.posexplode("detections").alias("det_idx", "d"))
    corner = [F.col("d.bbox")[i].cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select("device_id", "frame_no", "det_idx", *corner, F.col("d.confidence").cast("double").alias("confidence"),
                       F.col("d.class_id").alias("class_id"), F.col("d.visibility_score").cast("double").alias("visibility_score"),
                       F.col("d.overlap_ratio").cast("double").alias("overlap_ratio"),
                       F.coalesce("d.visibility_tag", F.lit("mid")).alias("visibility_tag"), "created_at")


def to_frames(rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """Rows back to one message per frame."""
    item = F.struct(order, *[f for f in fields if f != order])
    return rows.groupBy("device_id", "frame_no").agg(F.array_sort(F.collect_list(item)).alias("tracked"), F.max("created_at").alias("created_at"))


def _text(value: Column) -> Column:
    clean = F.trim(value.cast("string"))
    return F.when(clean.isNull() | (clean == ""), UNKNOWN).otherwise(clean)


def normalised(rows: DataFrame, tasks: list[str], nested: tuple[str, ...] = ("quality", "matching")) -> DataFrame:
    """The output contract: types, defaults, and null sub-records kept null."""
    cols = [F.col("entity_id").cast("int").alias("entity_id"),
            F.coalesce(F.col("confidence").cast("float"), F.lit(0.0).cast("float")).alias("confidence")]
    for t in tasks:
        cols += [_text(F.col(t)).alias(t), F.coalesce(F.col(f"{t}_confidence").cast("float"), F.lit(0.0).cast("float")).alias(f"{t}_confidence")]
    cols += [F.col(n) for n in nested if n in rows.columns]
    return rows.select(*[c for c in rows.columns if c in ("device_id", "frame_no", "created_at")], *cols,
                       F.lit(SCHEMA_VERSION).alias("schema_version"))


def display_frames(frames: DataFrame, label: str = "detected") -> DataFrame:
    """Raw frames in the shape of tracked ones for display; frames without an image are dropped."""
    shown = F.transform("detections", lambda d: F.struct(
        d["bbox"].alias("bbox"), d["confidence"].alias("confidence"),
        F.create_map(F.lit("label"), F.lit(label), F.lit("tag"), F.coalesce(d["visibility_tag"], F.lit("mid"))).alias("attributes")))
    some = F.col("image_data").isNotNull() & (F.length("image_data") > 0)
    return frames.where(some).select("device_id", "frame_number", shown.alias("tracked"), F.base64("image_data").alias("image"), "created_at")


def keyed_messages(frames: DataFrame) -> DataFrame:
    """Key and value for a sink: keyed by device, so one device stays in order."""
    return frames.select(F.col("device_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Drain what is there and stop."""
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def labelled_folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp", ".bmp")) -> DataFrame:
    """Files in one subfolder per label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    keep = F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)).isin(*suffixes)
    return files.where(keep).select(F.element_at(F.split("path", "/"), -2).alias("label"), "path", "content")


def write_report(items: DataFrame, sweep: DataFrame, summary: DataFrame, path: str) -> None:
    items.write.mode("overwrite").option("header", "true").csv(f"{path}/items")
    sweep.write.mode("overwrite").option("header", "true").csv(f"{path}/thresholds")
    summary.write.mode("overwrite").json(f"{path}/summary")
