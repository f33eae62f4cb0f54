"""Product quantisation of the residuals in each inverted list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import LOOKUP_BYTES, QUERIES_PER_CELL, ROWS_PER_CELL, checked, probe_table, score_by_codes, search_cells
from .ivf import (
    NPROBE,
    ZERO_CLUSTER,
    added,
    list_split,
    lists_and_zero,
    nearest_centroid,
    probe_lists,
    prune_lists,
    spread,
    to_matrix,
    unit_rows,
)
from .kernel import Marks, by_value, code_distances, count_closer_codes, list_column_to_matrix, scan_codes
from .nearest import QueryBatch, search_in_passes
from .topk import merge_groups, top_k

# Parts tried in this order when the wanted number does not divide the width.
FALLBACK_PARTS = (16, 12, 8, 4)
# Residuals that the first codewords are drawn from: some for each, and so many at most.
SEEDS_PER_WORD = 32
MAX_SEEDS = 20_000
# Allowance for the rounding of single-precision sums in a looked-up distance.
ROUNDING = 1e-4


def choose_m(d: int, m: int = 8) -> int:
    """A number of parts that divides the vector width."""
    for parts in (m, *FALLBACK_PARTS):
        if d % parts == 0:
            return parts
    raise ValueError(f"no part count among {(m, *FALLBACK_PARTS)} divides a width of {d}")


def residual_column(centroids: np.ndarray, sample: DataFrame):
    """A pandas UDF: a unit vector minus the centroid of its list."""
    shared = sample.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def residual(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows, _ = unit_rows(to_matrix(batch))
            yield pd.Series(list(rows - shared.value[nearest_centroid(rows, shared.value)]))

    return residual


def nearest_words(piece: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Number of the codeword nearest to each row."""
    # |r - c|^2 without the term |r|^2, which is the same for every codeword
    return ((words**2).sum(axis=1) - 2.0 * (piece @ words.T)).argmin(axis=1)


def spread_words(rows: np.ndarray, size: int, seed: int) -> np.ndarray:
    """``size`` of the rows, each drawn with a probability that grows with its squared distance to those drawn before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(rows)))]
    away = ((rows - rows[chosen[0]]) ** 2).sum(axis=1).astype(np.float64)
    for _ in range(size - 1):
        total = away.sum()
        chosen.append(int(rng.choice(len(rows), p=away / total)) if total > 0 else chosen[-1])
        away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _member_sums(shared, m: int, size: int, width: int):
    """A ``mapInArrow`` function: for each part the sums and numbers of the members of all codewords, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((m, size, width + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list_column_to_matrix(batch.column(0), m * width, np.float32)
            for part in range(m):
                piece = rows[:, part * width : (part + 1) * width]
                code = nearest_words(piece, shared.value[part])
                for j in range(width):
                    sums[part, :, j] += np.bincount(code, weights=piece[:, j], minlength=size)
                sums[part, :, width] += np.bincount(code, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(range(m), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["part", "sums"])

    return run


def train_pq(
    sample: DataFrame,
    centroids: np.ndarray,
    scratch: str,
    m: int = 8,
    bits: int = 8,
    seed: int = 42,
    max_iter: int = 25,
    tolerance: float = 1e-4,
) -> np.ndarray:
    """A5: codebooks of ``2**bits`` codewords for each of ``m`` parts, as ``[m, code, width / m]``.

    K-means of all parts together: the residuals are written to ``scratch`` once, and an iteration is one scan of them in
    which each task sums the members of every codeword of every part; Spark adds the sums in two levels, and the driver
    holds the codebooks only.  It starts from residuals far apart, out of at most ``MAX_SEEDS`` with the smallest hashes of
    their ids, and ends when no codeword moves by ``tolerance``.  A codeword without members stays where it is.
    """
    if not 1 <= bits <= 12:
        raise ValueError("bits must be between 1 and 12")
    d = centroids.shape[1]
    if d % m:
        raise ValueError(f"{m} parts do not divide a width of {d}")
    spark, size, width = sample.sparkSession, 2**bits, d // m
    sample.select("id", residual_column(centroids, sample)("embedding").alias("residual")).write.parquet(scratch)
    residuals = spread(spark.read.parquet(scratch))
    some = residuals.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(SEEDS_PER_WORD * size, MAX_SEEDS))
    rows = list_column_to_matrix(some.select("residual").toArrow().column(0).combine_chunks(), d, np.float32)
    books = np.stack([spread_words(piece, size, seed) for piece in np.split(rows, m, axis=1)])
    groups = merge_groups(sample)
    for _ in range(max_iter):
        shared = spark.sparkContext.broadcast(books)
        partial = residuals.select("residual").mapInArrow(_member_sums(shared, m, size, width), "part int, sums binary")
        if groups > 1:
            partial = added(partial.withColumn("level", F.spark_partition_id() % groups), "part", "level")
        sums = np.stack([np.frombuffer(row.sums).reshape(size, width + 1) for row in added(partial, "part").orderBy("part").collect()])
        number = sums[:, :, width :]
        means = np.where(number > 0, sums[:, :, :width] / np.maximum(number, 1), books).astype(np.float32)
        moved = float(np.abs(means - books).max())
        books = means
        shared.unpersist()
        if moved < tolerance:
            break
    return books


def encode_rows(rows: np.ndarray, centroids: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List number and code of each vector, and how far its looked-up distances can be off.

    That is the length of what the code leaves out, since a unit query's inner product with it is no larger. It is infinite
    for zero, tiny, huge and broken vectors, whose single-precision length says nothing.
    """
    m, _, part_width = codebooks.shape
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = np.linalg.norm(rows, axis=1)
        rows, zero = unit_rows(rows)
        clusters = nearest_centroid(rows, centroids)
        residuals = rows - centroids[clusters]
    residuals[zero] = 0.0
    codes = np.empty((len(rows), m), dtype=np.int16)
    left_out = np.zeros(len(rows))
    for part in range(m):
        piece = residuals[:, part * part_width : (part + 1) * part_width]
        codes[:, part] = nearest_words(piece, codebooks[part])
        left_out += ((piece - codebooks[part][codes[:, part]]).astype(np.float64) ** 2).sum(axis=1)
    clusters[zero] = ZERO_CLUSTER
    off = np.where((lengths > 1e-15) & (lengths < 1e15), np.sqrt(left_out) + ROUNDING, np.inf)
    return clusters, codes, off.astype(np.float32)


def pq_encode(emb: DataFrame, centroids: np.ndarray, codebooks: np.ndarray) -> DataFrame:
    """``(id, cluster_id, code, off)``; list, code and how far it is off are found in one trip through Python."""
    shared = emb.sparkSession.sparkContext.broadcast((centroids, codebooks))
    result = T.StructType(
        [
            T.StructField("cluster_id", T.IntegerType()),
            T.StructField("code", T.ArrayType(T.ShortType())),
            T.StructField("off", T.FloatType()),
        ]
    )

    @F.pandas_udf(result)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        centers, books = shared.value
        for batch in batches:
            clusters, codes, off = encode_rows(to_matrix(batch), centers, books)
            yield pd.DataFrame({"cluster_id": clusters, "code": list(codes), "off": off})

    vectors = emb.filter(F.col("embedding").isNotNull())
    return vectors.select("id", encode("embedding").alias("e")).select("id", "e.cluster_id", "e.code", "e.off")


def query_tables(vectors: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit queries, and the inner products of their parts with all codewords."""
    unit, _ = unit_rows(vectors.astype(np.float32))
    parts = unit.reshape(len(unit), codebooks.shape[0], codebooks.shape[2])
    return unit, np.einsum("qmw,mcw->qmc", parts, codebooks)


def _base(unit: np.ndarray, cluster: int, centroids: np.ndarray) -> np.ndarray:
    return np.zeros(len(unit), np.float32) if cluster == ZERO_CLUSTER else np.einsum("qd,d->q", unit, centroids[cluster])


def lookup_tables(
    batch: QueryBatch, members: dict[int, np.ndarray], centroids: np.ndarray, codebooks: np.ndarray
) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Inner products of query parts with codewords, and of queries with the centroids they probe."""
    unit, tables = query_tables(batch.vectors, codebooks)
    return tables, {cluster: (queries, _base(unit[queries], cluster, centroids)) for cluster, queries in members.items()}


def lookup_bytes(codebooks: np.ndarray) -> int:
    """Bytes of one query's lookup table."""
    return 4 * codebooks.shape[0] * codebooks.shape[1]


def ivfpq_pass(
    codes: DataFrame,
    centroids: np.ndarray,
    codebooks: np.ndarray,
    batch: QueryBatch,
    k: int,
    nprobe: int,
    flags: dict[str, np.ndarray] | None = None,
) -> DataFrame:
    members = probe_lists(batch, centroids, nprobe)
    tables, bases = lookup_tables(batch, members, centroids, codebooks)
    rows = prune_lists(codes, members, len(centroids)).select("id", "cluster_id", "code", *(flags or ()))
    scan = scan_codes(tables, bases, batch.qids, k, list_split(members, flags))
    return top_k(rows.mapInArrow(scan, batch.result_schema()), k)


def ivfpq_counts(
    codes: DataFrame, centroids: np.ndarray, codebooks: np.ndarray, batch: QueryBatch, marks: Marks, nprobe: int
) -> DataFrame:
    """Partial counts of the rows in the probed lists that come before each mark, by looked-up distances."""
    members = probe_lists(batch, centroids, nprobe)
    tables, bases = lookup_tables(batch, members, centroids, codebooks)
    rows = prune_lists(codes, members, len(centroids)).select("id", "cluster_id", "code")
    scan = count_closer_codes(tables, bases, batch.qids, marks, by_value("cluster_id", members))
    return rows.mapInArrow(scan, batch.count_schema())


def ivfpq_within(
    codes: DataFrame, centroids: np.ndarray, codebooks: np.ndarray, batch: QueryBatch, limits: np.ndarray, nprobe: int
) -> DataFrame:
    """``(id, cluster_id)`` of the rows whose exact distance may be within the limit of a query that probes their list.

    A looked-up distance is off by ``off`` at most, so no other row can be; rows stored without ``off`` stay in.
    """
    members = probe_lists(batch, centroids, nprobe)
    tables, bases = lookup_tables(batch, members, centroids, codebooks)
    distances = code_distances(tables, bases, by_value("cluster_id", members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            off = rows.column("off").to_numpy(zero_copy_only=False)
            near = np.zeros(rows.num_rows, dtype=bool)
            # positions take the place of ids, so that the rows found can be told
            places = pa.array(np.arange(rows.num_rows))
            numbered = pa.RecordBatch.from_arrays(
                [places, rows.column("cluster_id"), rows.column("code")], names=["id", "cluster_id", "code"]
            )
            for query, found, at in distances(numbered) if rows.num_rows else ():
                near[at] |= ~(found - off[at] > limits[query])
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("cluster_id")], names=["id", "cluster_id"]).filter(pa.array(near))

    rows = prune_lists(codes, members, len(centroids))
    off = F.coalesce("off", F.lit(float("inf")).cast("float")).alias("off")
    return rows.select("id", "cluster_id", "code", off).mapInArrow(run, "id bigint, cluster_id int")


def ivfpq_cells(codes: DataFrame, centroids: np.ndarray, codebooks: np.ndarray, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """The same for a table of queries of any size, in one pass; a cell builds the lookup tables of its queries."""
    probes = probe_table(checked(queries), lists_and_zero(centroids, nprobe))
    shared = queries.sparkSession.sparkContext.broadcast((centroids, codebooks))

    def tables_of(vectors: np.ndarray, cluster: int) -> tuple[np.ndarray, np.ndarray]:
        centers, books = shared.value
        unit, tables = query_tables(vectors, books)
        return tables, _base(unit, cluster, centers)

    per_cell = max(1, min(QUERIES_PER_CELL, LOOKUP_BYTES // lookup_bytes(codebooks)))
    rows = codes.select("cluster_id", "id", "code")
    return search_cells(rows, probes, k, score_by_codes(k, tables_of), len(centroids), ROWS_PER_CELL, per_cell)


def ivfpq_search(
    codes: DataFrame,
    centroids: np.ndarray,
    codebooks: np.ndarray,
    queries: DataFrame,
    k: int,
    nprobe: int = NPROBE,
) -> DataFrame:
    """The k nearest by looked-up (approximate) distances, as ``(qid, rank, id, dist)``; many queries as in A4."""
    return search_in_passes(
        queries,
        k,
        lambda batch: ivfpq_pass(codes, centroids, codebooks, batch, k, nprobe),
        query_bytes=lookup_bytes(codebooks),
        at_once=lambda many: ivfpq_cells(codes, centroids, codebooks, many, k, nprobe),
    )
