"""Running a caller's model over an image column in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH = 32


def _mapped(df: DataFrame, column: str, out: T.StructField, model: Callable[[Sequence[bytes]], Sequence], batch: int) -> DataFrame:
    schema = T.StructType([f for f in df.schema if f.name != column] + [out])

    def run(parts):
        for pdf in parts:
            images, results = pdf[column].tolist(), []
            for i in range(0, len(images), batch):
                results.extend(model(images[i:i + batch]))
            yield pdf.drop(columns=[column]).assign(**{out.name: pd.Series(results, index=pdf.index, dtype=object)})[schema.names]

    return df.mapInPandas(run, schema)


def extract_vectors(df: DataFrame, model: Callable[[Sequence[bytes]], Sequence[Sequence[float]]], column: str = "content",
                    batch: int = BATCH) -> DataFrame:
    """Replace the image column by ``vec``. The model gets at most ``batch`` images at once."""
    return _mapped(df, column, T.StructField("vec", T.ArrayType(T.DoubleType())), model, batch)


def extract_labels(df: DataFrame, model: Callable[[Sequence[bytes]], Sequence[dict]], column: str = "content", batch: int = BATCH) -> DataFrame:
    """Replace the image column by the label map ``labels``."""
    value = T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return _mapped(df, column, T.StructField("labels", T.MapType(T.StringType(), value)), model, batch)
