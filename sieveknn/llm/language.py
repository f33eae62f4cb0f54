"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; a document's probabilities are the means over all its
positions. It is trained on at most ``SAMPLE_ROWS`` documents with a language (those with the smallest hash of
the id whose crc32(doc_id) mod 3 is not 1), ``WINDOWS_PER_ROW`` windows of each; prediction reads every
text whole, cut into windows of 64 bytes.

* A null text, or one without any letter, has ``lang_pred`` ``und`` and score 0; so has every text if no
  language could be learned.
* Rows with a null language or id are not learned from, and are predicted like others; ``held_out`` is false
  for a null id. Repeated rows get equal answers. Further columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveknn.llm.common import hash_sample, remainder, whole_text
from sieveknn.llm.recurrent import WINDOW, Network, train, windows
from sieveknn.session import ship_package

SAMPLE_ROWS = 6_000
LEAST_ROWS = 100  # of each language, as far as it has them, beside the sample
WINDOWS_PER_ROW = 4
HIDDEN = 12
STEPS = 260
UNDETERMINED = "und"
_TEXTS_BYTES = 8 << 20


def training_windows(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, per_row: int = WINDOWS_PER_ROW) -> pd.DataFrame:
    """``lang, bytes``: windows from evenly spread places of the sampled documents.

    At most ``sample_rows`` documents, and ``LEAST_ROWS`` of each language, those with the smallest hashes.
    """
    ship_package(docs.sparkSession)
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), whole_text().alias("text"))
    known = known.where("doc_id is not null and lang is not null").where(remainder(F.col("doc_id"), 3) != 1).where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    least = known.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEAST_ROWS).select("doc_id")
    chosen = hash_sample(known.select("doc_id"), sample_rows).unionByName(least).distinct()
    rows = known.join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids, and LEAST_ROWS for each language

    def run(frames):
        for frame in frames:
            out = []
            for doc_id, lang, text in zip(frame["doc_id"], frame["lang"], frame["text"], strict=True):
                data = text.encode("utf-8", "replace")
                for k in range(per_row if len(data) > per_row * WINDOW else 1):
                    at = k * max(0, len(data) - WINDOW) // max(1, per_row - 1)
                    out.append((str(doc_id), k, lang, data[at : at + WINDOW]))
            yield pd.DataFrame(out, columns=["id", "k", "lang", "bytes"])

    table = rows.mapInPandas(run, "id string, k int, lang string, bytes binary").toPandas()
    table = table.sort_values(["id", "k", "lang", "bytes"], ignore_index=True)
    # Ids on many rows may bring more; then each language keeps its first windows.
    most = (sample_rows + LEAST_ROWS * table["lang"].nunique()) * per_row
    first = table.groupby("lang").cumcount().sort_values(kind="stable").index[:most]
    return table.loc[first.sort_values()]


def train_language(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, hidden: int = HIDDEN, steps: int = STEPS) -> Network | None:
    table = training_windows(docs, sample_rows)
    if not len(table):
        return None
    labels = sorted(table["lang"].unique())
    cut = [windows(bytes(b)) for b in table["bytes"]]
    rows, lengths = np.concatenate([r for r, _ in cut]), np.concatenate([n for _, n in cut])
    target = np.array([labels.index(x) for x in table["lang"]])
    return train(labels, rows, lengths, target, hidden, steps)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, text_has_letter, lang_pred, score`` of every document."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            readable = batch.column(2).to_pylist()
            names: list[str] = []
            scores: list[float] = []
            start = 0
            while start < len(column):
                texts, size = [], 0
                while start + len(texts) < len(column) and (not texts or size < _TEXTS_BYTES):
                    at = start + len(texts)
                    texts.append(column[at].as_buffer().to_pybytes() if readable[at] and model else b"")
                    size += len(texts[-1])
                if model:
                    p = model.document_probabilities(texts)
                    best = p.argmax(axis=1)
                for k, text in enumerate(texts):
                    names.append(model.labels[best[k]] if text else UNDETERMINED)
                    scores.append(float(min(1.0, p[k, best[k]])) if text else 0.0)
                start += len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    text = whole_text()
    kind = dict(docs.dtypes)["doc_id"]
    plain = docs.select("doc_id", text.alias("text"), text.rlike(r"\p{L}").alias("readable"))
    return plain.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``; trained on the documents themselves."""
    found = identify(docs, train_language(docs, sample_rows))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
