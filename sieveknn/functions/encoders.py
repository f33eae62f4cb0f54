"""Pluggable encoders (V7, V8): text or image bytes to vectors.

The model itself is a parameter: any zero-argument factory returning a callable that maps a list of
inputs to a 2-D float array.  The factory runs once per task, not once per row or batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import pool_query

Encoder = Callable[[Sequence], np.ndarray]


def _encode_column(make_encoder: Callable[[], Encoder]):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            present = batch[batch.notna()]
            vectors = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if len(present):
                rows = np.asarray(encoder(list(present)), dtype=np.float32)
                vectors.loc[present.index] = pd.Series(list(rows), index=present.index)
            yield vectors

    return encode


def encode_text(df: DataFrame, column: str, make_encoder: Callable[[], Encoder], out: str = "embedding") -> DataFrame:
    """V7: add a vector column computed from a text column; NULL text gives a NULL vector."""
    return df.withColumn(out, _encode_column(make_encoder)(F.col(column)))


def encode_images(
    spark: SparkSession, path: str, make_encoder: Callable[[], Encoder], glob: str | None = None
) -> DataFrame:
    """V8: image files to ``(path, embedding)``; files are read by the executors."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return encode_bytes(reader.load(path), "content", make_encoder).select("path", "embedding")


def encode_bytes(df: DataFrame, column: str, make_encoder: Callable[[], Encoder], out: str = "embedding") -> DataFrame:
    """V8 for images already held in a binary column."""
    return df.withColumn(out, _encode_column(make_encoder)(F.col(column)))


def encode_workloads(
    workloads: DataFrame,
    images: DataFrame,
    make_image_encoder: Callable[[], Encoder],
    make_text_encoder: Callable[[], Encoder],
) -> DataFrame:
    """Workloads ``(qid, images, texts, where_sql)`` to queries ``(qid, qvec, where_sql)`` (V5, V7, V8).

    ``images`` holds ``(path, content)``, as ``spark.read.format("binaryFile")`` gives it; each image and
    each text is encoded once, however many workloads use it.  An unknown path is an error, and so is
    a workload with neither images nor texts.
    """
    paths = workloads.select("qid", F.explode("images").alias("path"))
    texts = workloads.select("qid", F.explode("texts").alias("text"))
    used = images.select("path", "content").join(paths.select("path").distinct(), "path", "left_semi")
    known = encode_bytes(used, "content", make_image_encoder, "vec").select("path", "vec", F.lit(True).alias("known"))
    missing = F.raise_error(F.concat(F.lit("encode_workloads: no image "), F.col("path"))).cast("array<float>")
    seen = paths.join(known, "path", "left").select("qid", F.when(F.col("known"), F.col("vec")).otherwise(missing).alias("vec"))
    spoken = encode_text(texts.select("text").distinct(), "text", make_text_encoder, "vec")
    said = texts.join(spoken, "text").select("qid", "vec")
    nothing = workloads.select("qid", F.lit(None).cast("array<float>").alias("vec"))
    pooled = pool_query(seen.unionAll(said).unionAll(nothing))
    return workloads.select("qid", "where_sql").join(pooled, "qid").select("qid", "qvec", "where_sql")


def letter_count_encoder() -> Callable[[], Encoder]:
    """A deterministic stand-in for a text model: how often each letter a-z occurs."""

    def make() -> Encoder:
        def encode(texts: Sequence[str]) -> np.ndarray:
            codes = [np.frombuffer(text.encode("utf-8"), dtype=np.uint8) for text in texts]
            return np.stack([np.bincount(code, minlength=256)[97:123] for code in codes])

        return encode

    return make


def byte_histogram_encoder() -> Callable[[], Encoder]:
    """A deterministic stand-in for an image model: how often each byte value occurs."""

    def make() -> Encoder:
        def encode(blobs: Sequence[bytes]) -> np.ndarray:
            return np.stack(
                [np.bincount(np.frombuffer(blob, dtype=np.uint8), minlength=256) for blob in blobs]
            ).astype(np.float32)

        return encode

    return make
