"""Inverted lists: sampling, training, assignment and search (A1-A4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_norm, l2_normalize
from .cells import QUERIES_PER_CELL, ROWS_PER_CELL, checked, probe_everything, probe_table, score_exactly, search_cells
from .kernel import Marks, Split, by_value, by_value_and_flag, count_closer, list_column_to_matrix, scan_vectors
from .nearest import QueryBatch, search_in_passes
from .topk import merge_groups, top_k

# Fixed values.
NPROBE = 10
# List of the zero vectors, which have no direction; every search probes it.
ZERO_CLUSTER = -1
# Sample rows that are worth a task of their own.
ROWS_PER_TASK = 500
# Lists whose sums travel in one row while centroids are trained.
LISTS_PER_BLOCK = 256
# Runs of lists that a scan's filter names, and bytes of a row group of stored lists.
MAX_RUNS = 200
ROW_GROUP_BYTES = 16 * 1024 * 1024
# Floats in the score matrix of one assignment step.
SCORE_CELLS = 8_000_000


def train_sample(emb: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """A1: all rows with a vector, or ``n`` of them drawn without replacement, normalised; the same rows for the same seed.

    Rows are ordered by a hash of their id, and the n-th smallest hash is found from the id column
    alone.  Only hashes below a generous guess of that value are compared, so the search for it
    moves about n numbers whatever the size of the table.
    """
    emb = emb.filter(F.col("embedding").isNotNull())
    total = emb.count() if n is not None else 0
    chosen = emb
    if n is not None and n < total:
        draw = F.xxhash64("id", F.lit(seed))
        spare = 6 * n**0.5 + 20
        while True:
            guess = min(int(-(2**63) + (n + spare) / total * 2**64), 2**63 - 1)
            low = emb.select(draw.alias("draw")).filter(F.col("draw") <= guess)
            found = low.orderBy("draw").limit(n).agg(F.count(F.lit(1)).alias("n"), F.max("draw").alias("cut")).first()
            if found.n == n or guess == 2**63 - 1:
                break
            spare *= 4
        chosen = emb.filter(draw <= found.cut)
    unit = l2_normalize("embedding").cast("array<float>").alias("embedding")
    return chosen.select("id", unit)


def spread(sample: DataFrame) -> DataFrame:
    """A stored sample dealt out over the cluster: it is small on disk, but training on it is not.

    Sorted, so that sums are added in the same order.
    """
    tasks = min(sample.sparkSession.sparkContext.defaultParallelism, -(-sample.count() // ROWS_PER_TASK))
    return sample.repartition(max(1, tasks), "id").sortWithinPartitions("id")


def default_nlist(n: int) -> int:
    """The number of lists when none is given."""
    return max(1, int(n**0.5))


def _list_sums(shared, d: int):
    """A ``mapInArrow`` function: the sums and numbers of the members of all lists, a row for each block of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        sums = np.zeros((len(centroids), d + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list_column_to_matrix(batch.column(0), d, np.float32)
            clusters = nearest_centroid(rows, centroids)
            order = np.argsort(clusters, kind="stable")
            present, starts = np.unique(clusters[order], return_index=True)
            sums[present, :d] += np.add.reduceat(rows[order].astype(np.float64), starts, axis=0)
            sums[:, d] += np.bincount(clusters, minlength=len(centroids))
        blocks = [sums[i : i + LISTS_PER_BLOCK] for i in range(0, len(sums), LISTS_PER_BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["part", "sums"]
        )

    return run


def added(groups: DataFrame, *keys: str) -> DataFrame:
    """The sums of each group of rows."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(blob) for blob in table.column("sums").to_pylist()], axis=0)
        return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    return groups.groupBy(*keys).applyInArrow(add, "part int, sums binary")


def train_ivf(sample: DataFrame, nlist: int, seed: int = 42, max_iter: int = 10, tolerance: float = 1e-4) -> np.ndarray:
    """A2: unit-length centroids by cosine k-means of a sample ``(id, embedding)`` of unit vectors, one row each.

    It starts from the different vectors among the ``nlist`` with the smallest hashes of their ids.  An iteration is one
    scan in which each task sums the members of every list; Spark adds the sums, and the driver gets one sum a
    list, ``nlist x d`` numbers.  (Spark's k-means sends it the distances of all pairs of centroids, as many as there are
    vectors where ``nlist`` is the root of their number.)  A list without members keeps its centroid.
    """
    spark = sample.sparkSession
    points = sample.filter(l2_norm("embedding") > 0)
    start = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(nlist).select("embedding").toArrow().column(0).combine_chunks()
    if not len(start):
        raise ValueError("no vector of the sample has a direction")
    d = len(start[0])
    centroids = list_column_to_matrix(start, d, np.float32)
    centroids = centroids[np.sort(np.unique(centroids, axis=0, return_index=True)[1])]
    groups = merge_groups(sample)
    for _ in range(max_iter):
        shared = spark.sparkContext.broadcast(centroids)
        partial = points.select("embedding").mapInArrow(_list_sums(shared, d), "part int, sums binary")
        if groups > 1:
            partial = added(partial.withColumn("level", F.spark_partition_id() % groups), "part", "level")
        rows = added(partial, "part").orderBy("part").collect()
        sums = np.concatenate([np.frombuffer(row.sums).reshape(-1, d + 1)[:, :d] for row in rows])
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(lengths > 0, sums / np.where(lengths == 0, 1, lengths), centroids).astype(np.float32)
        moved = float(np.abs(means - centroids).max())
        centroids = means
        shared.unpersist()
        if moved < tolerance:
            break
    return centroids


def to_matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float32, copy=False)


def unit_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to unit length, and which rows are zero."""
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    zero = lengths[:, 0] == 0
    return rows / np.where(lengths == 0, 1, lengths), zero


def nearest_centroid(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Position of the most similar centroid of each unit row."""
    step = max(1, SCORE_CELLS // len(centroids))
    parts = [(rows[i : i + step] @ centroids.T).argmax(axis=1) for i in range(0, len(rows), step)]
    return np.concatenate(parts).astype(np.int32)


def assign_clusters(emb: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A3: the list of each vector, as ``(id, embedding, cluster_id)``.

    Only the list number comes back from Python; the vectors stay in their rows.
    """
    shared = emb.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf(T.IntegerType())
    def cluster_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows, zero = unit_rows(to_matrix(batch))
            clusters = nearest_centroid(rows, shared.value)
            clusters[zero] = ZERO_CLUSTER
            yield pd.Series(clusters)

    vectors = emb.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    return vectors.withColumn("cluster_id", cluster_of("embedding"))


def write_lists(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A3: store rows in order of their list, as ranges inside large files.

    The number of files follows from the data, not from the number of lists; a search skips the row groups and
    pages that hold none of its lists.  Ranges of (list, id) split a list that holds a large share of the rows.
    """
    ordered = rows.repartitionByRange("cluster_id", F.xxhash64("id")).sortWithinPartitions("cluster_id")
    ordered.write.mode(mode).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def nearest_lists(queries: np.ndarray, centroids: np.ndarray, nprobe: int) -> np.ndarray:
    """The ``nprobe`` most similar centroids of each query, one row each."""
    unit, _ = unit_rows(queries.astype(np.float32))
    nprobe = min(nprobe, len(centroids))
    step = max(1, SCORE_CELLS // len(centroids))
    parts = [
        np.argpartition(-(unit[i : i + step] @ centroids.T), nprobe - 1, axis=1)[:, :nprobe] for i in range(0, len(unit), step)
    ]
    return np.concatenate(parts)


def probe_lists(batch: QueryBatch, centroids: np.ndarray, nprobe: int) -> dict[int, np.ndarray]:
    """Which queries read which list, in order.

    Bounded by queries x lists, both of which the driver already holds.
    """
    chosen = nearest_lists(batch.vectors, centroids, nprobe)
    owner = np.repeat(np.arange(len(chosen)), chosen.shape[1])
    order = np.argsort(chosen.ravel(), kind="stable")
    clusters, starts = np.unique(chosen.ravel()[order], return_index=True)
    members = dict(zip(clusters.tolist(), np.split(owner[order], starts[1:]), strict=True))
    members[ZERO_CLUSTER] = np.arange(len(batch))
    return members


def lists_and_zero(centroids: np.ndarray, nprobe: int):
    """For a table of queries: the lists that each probes, the one of the zero vectors among them."""

    def run(queries: np.ndarray) -> np.ndarray:
        chosen = nearest_lists(queries, centroids, nprobe)
        return np.concatenate([chosen, np.full((len(chosen), 1), ZERO_CLUSTER)], axis=1)

    return run


def prune_lists(lists: DataFrame, members: dict[int, np.ndarray], n_lists: int) -> DataFrame:
    """Read only the probed lists.

    The constant filter prunes row groups when files are read; a join with the probes would
    read every list first.  It names runs of neighbouring lists, because Parquet gets equalities and ranges as
    they are, but of a long IN list only its ends.  Beyond ``MAX_RUNS`` the nearest runs become one.
    """
    if len(members) > n_lists:  # all lists and the zero list
        return lists
    numbers = np.array(sorted(members))
    gaps = np.diff(numbers)
    cuts = np.flatnonzero(gaps > 1)
    if len(cuts) >= MAX_RUNS:
        cuts = np.sort(cuts[np.argsort(-gaps[cuts], kind="stable")[: MAX_RUNS - 1]])
    runs = [(int(run[0]), int(run[-1])) for run in np.split(numbers, cuts + 1)]
    return lists.filter(" OR ".join(f"cluster_id = {a}" if a == b else f"cluster_id BETWEEN {a} AND {b}" for a, b in runs))


def list_split(members: dict[int, np.ndarray], flags: dict[str, np.ndarray] | None) -> Split:
    """Rows meet the queries that probe their list and, with ``flags``, use a filter that they satisfy."""
    return by_value("cluster_id", members) if flags is None else by_value_and_flag("cluster_id", members, flags)


def ivf_pass(
    lists: DataFrame, centroids: np.ndarray, batch: QueryBatch, k: int, nprobe: int, flags: dict[str, np.ndarray] | None = None
) -> DataFrame:
    members = probe_lists(batch, centroids, nprobe)
    rows = prune_lists(lists, members, len(centroids)).select("id", "embedding", "cluster_id", *(flags or ()))
    scan = scan_vectors(batch.vectors, batch.qids, k, list_split(members, flags))
    return top_k(rows.mapInArrow(scan, batch.result_schema()), k)


def ivf_counts(lists: DataFrame, centroids: np.ndarray, batch: QueryBatch, marks: Marks, nprobe: int) -> DataFrame:
    """Partial counts of the rows in the probed lists that come before each mark."""
    members = probe_lists(batch, centroids, nprobe)
    rows = prune_lists(lists, members, len(centroids)).select("id", "embedding", "cluster_id")
    return rows.mapInArrow(count_closer(batch.vectors, batch.qids, marks, by_value("cluster_id", members)), batch.count_schema())


def ivf_cells(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """The same for a table of queries of any size, in one pass.

    Where all lists are probed they are not told apart: a query would become a row for each of them, and have k hits in each.
    """
    if nprobe >= len(centroids):
        rows = lists.select(F.lit(0).alias("cluster_id"), "id", "embedding")
        return search_cells(rows, probe_everything(checked(queries)), k, score_exactly(k), 1, ROWS_PER_CELL, 4 * QUERIES_PER_CELL)
    probes = probe_table(checked(queries), lists_and_zero(centroids, nprobe))
    rows = lists.select("cluster_id", "id", "embedding")
    return search_cells(rows, probes, k, score_exactly(k), len(centroids), ROWS_PER_CELL, QUERIES_PER_CELL)


def ivf_search(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, nprobe: int = NPROBE) -> DataFrame:
    """A4: the k nearest vectors within the probed lists, as ``(qid, rank, id, dist)``.

    Distances are exact.  Probing every list gives the exact answer.  Few queries go to every task; many stay a
    table that meets the lists cell by cell, so that the lists are read once either way.
    """
    return search_in_passes(
        queries,
        k,
        lambda batch: ivf_pass(lists, centroids, batch, k, nprobe),
        at_once=lambda many: ivf_cells(lists, centroids, many, k, nprobe),
    )
