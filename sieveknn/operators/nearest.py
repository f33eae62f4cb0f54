"""Exact nearest neighbours by cosine distance (K1-K4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import distance_to_unit
from ..session import ensure_checkpoint_dir, new_scratch_path
from .kernel import everything, list_column_to_matrix, scan_vectors, score_rows
from .topk import top_k

# More queries than these are stored first, or stay a table where the search allows it.
QUERIES_PER_FETCH = 5_000
# Bytes of query vectors, and of running results per task, that one pass over the data may hold.
QUERY_BYTES_PER_PASS = 16 * 1024 * 1024
RESULT_BYTES_PER_PASS = 256 * 1024 * 1024
# Rows that may travel from every task to the final merge of a single query.
SINGLE_MERGE_ROWS = 1000
# From this width on, the Arrow kernel beats Spark's array functions even for a single query
# (128 wide, a million vectors: 1.3 s against 5.6 s).
KERNEL_WIDTH = 64


@dataclass
class QueryBatch:
    """Query vectors of one pass, held by the driver and shipped to every task."""

    qids: pa.Array
    vectors: np.ndarray
    qid_type: T.DataType
    clauses: list[str] | None = None  # the WHERE clause of each query, where they differ

    def __len__(self) -> int:
        return len(self.qids)

    def result_schema(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField("qid", self.qid_type),
                T.StructField("id", T.LongType()),
                T.StructField("dist", T.DoubleType()),
            ]
        )

    def count_schema(self) -> T.StructType:
        fields = [("mark", T.IntegerType()), ("n", T.LongType())]
        return T.StructType([T.StructField("qid", self.qid_type), *[T.StructField(name, kind) for name, kind in fields]])


def _pass_limit(width: int, k: int, query_bytes: int) -> int:
    """Queries of one pass: bounded by their vectors, their running results and what else each brings."""
    return max(1, min(QUERY_BYTES_PER_PASS // (8 * max(width, 1) + query_bytes), RESULT_BYTES_PER_PASS // (16 * k)))


def _batches_of(table: pa.Table, limit: int, qid_type: T.DataType, clause: str | None) -> Iterator[QueryBatch]:
    if not table.num_rows:
        return
    column = table.column("qvec").combine_chunks()
    if column.null_count:
        raise ValueError("a query has no vector")
    qids = table.column("qid")
    if qids.null_count or len(qids.unique()) != len(qids):
        raise ValueError("every query needs a qid of its own")
    vectors = list_column_to_matrix(column, len(column[0]), np.float64)
    for start in range(0, len(vectors), limit):
        part = table.slice(start, limit)
        yield QueryBatch(
            part.column("qid").combine_chunks(),
            vectors[start : start + limit],
            qid_type,
            part.column(clause).to_pylist() if clause else None,
        )


def _head(queries: DataFrame) -> pa.Table:
    return queries.limit(QUERIES_PER_FETCH + 1).toArrow()


def _stored_passes(queries: DataFrame, limit: int) -> Iterator[pa.Table]:
    """Query rows, stored once, as Arrow tables of about ``limit`` rows, one in memory at a time."""
    spark = queries.sparkSession
    plain, path = new_scratch_path(spark, "queries"), new_scratch_path(spark, "queries")
    queries.write.parquet(plain)  # what makes the queries, perhaps an encoder, runs once
    queries = spark.read.schema(queries.schema).parquet(plain)
    slices = -(-queries.count() // limit)
    if slices <= 1:
        yield queries.toArrow()
        return
    queries.withColumn("__slice", F.pmod(F.xxhash64("qid"), F.lit(slices))).hint("rebalance", "__slice").write.partitionBy(
        "__slice"
    ).parquet(path)
    stored = spark.read.parquet(path)
    for number in range(slices):
        yield stored.filter(F.col("__slice") == number).select(*queries.columns).toArrow()


def query_passes(queries: DataFrame, k: int, clause: str | None = None, query_bytes: int = 0, head: pa.Table | None = None) -> Iterator[QueryBatch]:
    """Split ``(qid, qvec)`` into batches small enough to hold in every task.

    A batch is limited in bytes, by its vectors and by its ``queries * k`` running results: 32,768 queries
    of 64 numbers make one pass over the data, more queries mean more passes.  ``clause`` names a column carried along
    per query, ``query_bytes`` is what a search needs besides.
    """
    columns = ["qid", "qvec"] + ([clause] if clause else [])
    queries = queries.select(*columns)
    qid_type = queries.schema["qid"].dataType
    head = _head(queries) if head is None else head
    if not head.num_rows:
        return
    limit = _pass_limit(len(head.column("qvec")[0].as_py() or ()), k, query_bytes)
    tables = [head] if head.num_rows <= QUERIES_PER_FETCH else _stored_passes(queries, limit)
    for table in tables:
        yield from _batches_of(table, limit, qid_type, clause)


def empty_hits(queries: DataFrame) -> DataFrame:
    qid = T.StructField("qid", queries.schema["qid"].dataType)
    fields = [("rank", T.IntegerType()), ("id", T.LongType()), ("dist", T.DoubleType())]
    schema = T.StructType([qid, *[T.StructField(name, kind) for name, kind in fields]])
    return queries.sparkSession.createDataFrame([], schema)


def search_in_passes(
    queries: DataFrame,
    k: int,
    one_pass: Callable[[QueryBatch], DataFrame],
    clause: str | None = None,
    query_bytes: int = 0,
    at_once: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run ``one_pass`` for every query batch and put the hits together.

    A single pass stays lazy.  Of several, each is run and its hits stored before the next is
    planned, so that the driver never holds the vectors of more than one.  A search that can take queries as a table
    passes ``at_once``, which gets them when the driver should not fetch them.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    head = _head(queries.select("qid", "qvec", *([clause] if clause else [])))
    if at_once is not None and head.num_rows > QUERIES_PER_FETCH:
        return at_once(queries)
    pending: DataFrame | None = None
    stored: str | None = None
    for batch in query_passes(queries, k, clause, query_bytes, head):
        part = one_pass(batch)
        if pending is None:
            pending = part
            continue
        if stored is None:
            stored = new_scratch_path(queries.sparkSession, "hits")
            pending.write.parquet(stored)
        part.write.mode("append").parquet(stored)
    if pending is None:
        return empty_hits(queries)
    return pending if stored is None else queries.sparkSession.read.schema(pending.schema).parquet(stored)


def scan_exact(emb: DataFrame, batch: QueryBatch, k: int) -> DataFrame:
    """Partial hits of one pass: at most k per query from each task."""
    rows = emb.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    scan = scan_vectors(batch.vectors, batch.qids, k, everything(len(batch)))
    return rows.mapInArrow(scan, batch.result_schema())


def knn(
    emb: DataFrame, qvec: Sequence[float], k: int, normalized: bool = False, use_kernel: bool | None = None
) -> DataFrame:
    """K1/K2: the k vectors nearest to one query, as ``(id, dist)`` in order.

    Every task keeps its own k best and only those travel.  Narrow vectors are scored with Spark's
    array functions, others with the Arrow kernel; ``normalized=True`` tells the former to skip the
    norms of unit-length vectors.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if use_kernel is None:
        use_kernel = k > SINGLE_MERGE_ROWS or len(qvec) >= KERNEL_WIDTH
    if use_kernel:
        batch = QueryBatch(pa.array([0], pa.int64()), np.asarray([qvec], dtype=np.float64), T.LongType())
        hits = top_k(scan_exact(emb, batch, k), k)
        return hits.orderBy("rank").select("id", "dist")
    query = np.asarray(qvec, dtype=np.float64)
    length = float(np.sqrt(query @ query)) or 1.0
    distance = F.when(
        F.size("embedding") == len(query), distance_to_unit("embedding", (query / length).tolist(), normalized)
    ).otherwise(F.raise_error(F.lit(f"every vector must have {len(query)} elements")))
    return (
        emb.filter(F.col("embedding").isNotNull())
        .select("id", distance.alias("dist"))
        .orderBy("dist", "id")
        .limit(k)
    )


def knn_pass(emb: DataFrame, batch: QueryBatch, k: int) -> DataFrame:
    """The k nearest of each query of one pass, as ``(qid, rank, id, dist)``."""
    return top_k(scan_exact(emb, batch, k), k)


def knn_batch(emb: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """K3: the k nearest vectors of every query ``(qid, qvec)``, as ``(qid, rank, id, dist)``.

    One scan of the vectors serves a whole batch of queries, and no (query, vector) pair leaves a
    task unless it is among that task's k best.
    """
    return search_in_passes(queries, k, lambda batch: knn_pass(emb, batch, k))


def rank_all(
    emb: DataFrame, qvec: Sequence[float], captions: DataFrame | None = None, partitions: int | None = None
) -> DataFrame:
    """K4: every row ranked by squared Euclidean distance of the normalised vectors.

    Returns ``(rank, id, dist)`` plus ``caption``.  Rows are range-partitioned by ``(dist, id)`` so
    that even a huge group of equal distances spreads over tasks, and numbered inside each partition;
    a checkpoint freezes that layout, because recomputing the sampled range bounds could move rows.
    Only the per-partition counts are gathered.
    """
    spark = emb.sparkSession
    score = score_rows(np.asarray([qvec], dtype=np.float64), squared_l2=True)
    vectors = emb.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    scored = vectors.mapInArrow(score, "id bigint, dists array<double>").select("id", F.get("dists", F.lit(0)).alias("dist"))
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    # monotonically_increasing_id is the partition number times 2^33 plus the position inside it
    placed = (
        scored.repartitionByRange(partitions, "dist", "id")
        .sortWithinPartitions("dist", "id")
        .withColumn("place", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("place", 33)
    position = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).count().collect()  # one row per partition
    starts, total = [], 0
    for row in sorted(counts):
        starts.append((row.part, total))
        total += row["count"]
    offsets = spark.createDataFrame(starts, "part bigint, start bigint")
    ranked = (
        placed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .select((F.col("start") + position + 1).alias("rank"), "id", "dist")
    )
    if captions is not None:
        ranked = ranked.join(captions.select("id", "caption"), "id", "left").select("rank", "id", "dist", "caption")
    return ranked
