"""Exact deduplication through an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. Each text's 64-bit hash (its key) addresses a bucket
by its leading bits. The directory doubles as long as a slot holds more than ``capacity`` keys; a bucket has the
least depth at which it fits, so buckets that never were overfull keep several slots. The key space is cut
into ranges of whole buckets, each with an owner task. Rows are dealt to the owner of their key, which compares the
texts of a key byte by byte and writes one entry for each different text; entries of one key form a chain. Lookups go by
bucket, key and, along the chain, SHA-256.

A key that holds very many rows is dealt to many owners, whose entries meet in a second comparison of bytes.

* Null texts count as empty, empty texts are equal to each other.
* A group's row with the largest ``doc_id`` stays; rows without an id never stay unless the whole
  group has none. Repeated rows (same id, equal text) count in ``group_size`` and are marked alike;
  ``keep_one`` leaves a single one of them.
* No rows give no rows; further columns of the input are ignored by ``exact_groups`` and kept by
  ``keep_one``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveknn.llm.common import lower_ascii, stored, whole_text
from sieveknn.session import new_scratch_path

CAPACITY = 4096  # keys of a bucket
KEY_BITS = 64  # leading bits of the hash that make a key; fewer only to provoke collisions in tests
OWNER_BYTES = 32 << 20  # text for one owner, as far as whole buckets allow
HOT_ROWS = 1024  # rows of one key for one owner, unless that would be more than MAX_HOT_KEYS keys
MAX_HOT_KEYS = 100_000


class Directory(NamedTuple):
    """``slots(slot, local, bucket)`` of the occupied slots, the number of bits of a slot and the least local depth."""

    slots: DataFrame
    depth: int
    least: int


class Index(NamedTuple):
    """``entries(bucket, key, chain, sha, keep_id, group_size)``, one row per different text, and the directory."""

    entries: DataFrame
    directory: Directory


def _slot(key: Column, bits: int) -> Column:
    """The key's leading bits as a number from 0."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def fingerprints(docs: DataFrame, text: str = "text", key_bits: int = KEY_BITS) -> DataFrame:
    """docs with ``__norm`` (normalised text) and ``__key`` (its hash)."""
    norm = docs.withColumn("__norm", lower_ascii(whole_text(text)))
    key = F.xxhash64("__norm")
    return norm.withColumn("__key", key if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits))


def _sha() -> Column:
    return F.unhex(F.sha2(F.col("__norm"), 256))


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """The directory for different ``keys(key)``. Its depth grows with them; only its depth and sums reach the driver."""
    depth = min(64, (max(0, keys.count() - 1) // capacity).bit_length())
    while True:
        fill = stored(keys.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n")), "exact-fill")
        if depth == 64 or not fill.where(F.col("n") > capacity).limit(1).count():
            break
        depth += 1  # the directory doubles
    levels = fill.withColumn("local", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(slot, {depth} - local)"))
    fits = levels.groupBy("local", "prefix").agg(F.sum("n").alias("total")).where((F.col("total") <= capacity) | (F.col("local") == depth))
    # A bucket's depth is the least at which it fits; its name is its first slot, so all its slots find the same one.
    slots = levels.join(fits, ["local", "prefix"]).groupBy("slot").agg(F.min("local").alias("local"))
    slots = stored(slots.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {depth} - local), {depth} - local)")), "exact-directory")
    return Directory(slots, depth, slots.agg(F.min("local")).first()[0] or 0)


def _with_bucket(rows: DataFrame, key: str, directory: Directory) -> DataFrame:
    """rows with the ``__bucket`` of their key."""
    slots = directory.slots.select(F.col("slot").alias("__slot"), F.col("bucket").alias("__bucket"))
    return rows.withColumn("__slot", _slot(F.col(key), directory.depth)).join(slots, "__slot").drop("__slot")


def build_index(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS, hot_rows: int = HOT_ROWS) -> Index:
    """The stored index. Every owner writes one file, sorted by bucket and key.

    Texts move once, to the owners of their keys. At most ``MAX_HOT_KEYS`` keys and their numbers of rows are broadcast.
    """
    spark = docs.sparkSession
    marked = fingerprints(docs.select("doc_id", "text"), key_bits=key_bits).select("doc_id", "__norm", F.col("__key").alias("key"))
    counted = marked.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("__norm")).alias("bytes"))
    keys = stored(counted, "exact-keys")
    rows, size = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    directory = build_directory(keys, capacity)

    # 2 ** bits owners; no more than the least depth, so that every bucket has one owner.
    wanted = max(2 * spark.sparkContext.defaultParallelism, size // OWNER_BYTES)
    bits = min(directory.least, wanted.bit_length(), 20)
    owner = _slot(F.col("key"), bits)
    most = max(hot_rows, -(-rows // MAX_HOT_KEYS))
    hot = keys.where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).alias("parts"))
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("parts"))
    dealt = (
        marked.join(F.broadcast(hot), "key", "left")
        .withColumn("part", F.coalesce(salt, F.lit(0)))
        .withColumn("owner", ((owner + F.col("part")) % (1 << bits)).cast("int"))
        .repartitionById(1 << bits, "owner")
    )
    # The owner tells the texts of a key apart by their bytes.
    texts = dealt.groupBy("owner", "key", "part", "__norm", F.col("parts").isNotNull().alias("hot")).agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    found = texts.select("key", _sha().alias("sha"), F.when(F.col("hot"), F.col("__norm")).alias("__norm"), "hot", "keep_id", "group_size")
    found = stored(found, "exact-texts")
    merged = found.where("hot").groupBy("key", "sha", "__norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    columns = ["key", "sha", "keep_id", "group_size"]
    entries = _with_bucket(found.where("not hot").select(columns).unionByName(merged.select(columns)), "key", directory)
    owned = entries.withColumnRenamed("__bucket", "bucket").withColumn("owner", owner.cast("int")).repartitionById(1 << bits, "owner")
    chained = owned.withColumn("chain", F.row_number().over(Window.partitionBy("owner", "bucket", "key").orderBy("sha")))
    path = new_scratch_path(spark, "exact-index")
    chained.select("bucket", "key", "chain", "sha", "keep_id", "group_size").write.parquet(path)
    return Index(spark.read.schema("bucket long, key long, chain int, sha binary, keep_id long, group_size long").parquet(path), directory)


def look_up(rows: DataFrame, index: Index) -> DataFrame:
    """rows(``__key``, ``__sha``, ...) with the ``keep_id`` and ``group_size`` of their text, as ``__keep`` and ``__size``.

    An inner join with nothing above it that needs its partitioning, so Spark can split the rows of a hot key.
    """
    entries = index.entries.select(
        F.col("bucket").alias("__bucket"),
        F.col("key").alias("__key"),
        F.col("sha").alias("__sha"),
        F.col("keep_id").alias("__keep"),
        F.col("group_size").alias("__size"),
    )
    return _with_bucket(rows, "__key", index.directory).join(entries, ["__bucket", "__key", "__sha"])


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    index = build_index(docs, capacity, key_bits, hot_rows)
    rows = fingerprints(docs.select("doc_id", "text"), key_bits=key_bits).select("doc_id", "__key", _sha().alias("__sha"))
    return look_up(rows, index).select(
        "doc_id",
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The documents that stay, with all their columns."""
    index = build_index(docs, capacity, key_bits, hot_rows)
    # Whole rows travel as one struct, so their names cannot clash with these.
    rows = fingerprints(docs.select(F.struct("*").alias("__row")), "__row.text", key_bits).withColumn("__sha", _sha()).drop("__norm")
    kept = look_up(rows, index).where(F.col("__row.doc_id").eqNullSafe(F.col("__keep")))
    once = kept.where("__size = 1").unionByName(kept.where("__size > 1").dropDuplicates(["__key", "__sha"]))
    return once.select("__row.*")
