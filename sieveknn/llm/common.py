"""What several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveknn.session import new_scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word is a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; pure ASCII takes the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def hash_sample(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of ``doc_id``; alike whatever the partitions.

    Rows with clearly larger hashes are left where they are, so that little more than the sample moves.
    """
    place = F.xxhash64("doc_id")
    share = 1.2 * (most + 50) / max(1, ids.count())
    near = ids if share >= 1 else ids.where(place <= int(share * 2**64) - 2**63)
    return near.orderBy(place, "doc_id").limit(most)


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again: survives lost executors, cuts the lineage."""
    path = new_scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
