"""Merging partial results to the k best per query."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Rows of a query that one task may number; more are numbered in ranges.
MAX_NUMBERED = 50_000


def merge_groups(df: DataFrame) -> int:
    """How many groups the partial results of one query are first merged in.

    The square root of the shuffle width the session was sized for: a wide cluster merges each
    query in two levels of about equal size, a small one in a single level.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return math.isqrt(width) if width >= 64 else 1


def top_k(scored: DataFrame, k: int, groups: int | None = None) -> DataFrame:
    """The k rows of each ``qid`` smallest by ``(dist, id)``, numbered from 1 as ``rank``.

    ``row_number() <= k`` lets Spark drop all but k rows per query inside every task before the
    shuffle.  With ``groups > 1`` the tasks' survivors meet in that many groups first, so that no
    single task receives k rows from every other task of a large job.  Where k is large the rows
    are numbered in ranges instead, at once.
    """
    if k > MAX_NUMBERED:
        return _numbered_in_ranges(scored, k)
    groups = merge_groups(scored) if groups is None else groups
    order = [F.col("dist"), F.col("id")]
    if groups > 1:
        spread = Window.partitionBy("qid", "__group").orderBy(*order)
        scored = (
            scored.withColumn("__group", F.spark_partition_id() % groups)
            .withColumn("__place", F.row_number().over(spread))
            .filter(F.col("__place") <= k)
            .drop("__group", "__place")
        )
    per_query = Window.partitionBy("qid").orderBy(*order)
    return (
        scored.withColumn("rank", F.row_number().over(per_query))
        .filter(F.col("rank") <= k)
        .select("qid", "rank", "id", "dist")
    )


def _numbered_in_ranges(scored: DataFrame, k: int) -> DataFrame:
    """The same for any k: rows are dealt by ranges of ``(qid, dist, id)`` and numbered inside each range.

    A checkpoint freezes the ranges.  A row's rank is its place in its range and the rows of its query in the ranges
    before; there is one such count for each query and range.
    """
    ensure_checkpoint_dir(scored.sparkSession)
    order = ["qid", "dist", "id"]
    ranges = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id is the partition number times 2^33 plus the position inside it
    placed = ranges.withColumn("place", F.monotonically_increasing_id()).checkpoint().withColumn("part", F.shiftright("place", 33))
    before = Window.partitionBy("qid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("qid", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    runs = runs.select("qid", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    ranked = placed.join(F.broadcast(runs), ["qid", "part"]).withColumn("rank", (F.col("place") + F.col("shift")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("qid", "rank", "id", "dist")
