"""Any number of queries against inverted lists in one pass: query and list rows meet in cells.

The queries stay a table. Each becomes one row for every list that it probes; a list is cut into parts of bounded size, and
so are the queries that probe it. A cell is one part of a list with one part of its queries: both fit one Arrow group,
whatever the size of the list or the number of queries. A cell sends the k best rows of each of its queries,
and Spark merges those once. Every list row is read once; it moves as often as its list has parts of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import by_value, everything, list_column_to_matrix, scan_codes, scan_vectors
from .topk import top_k

# Rows of a list, and queries that probe it, in one cell.
ROWS_PER_CELL = 65_536
QUERIES_PER_CELL = 4_096
# Bytes of lookup tables, and of running results, that a cell may hold.
LOOKUP_BYTES = 64 * 1024 * 1024
RESULT_BYTES_PER_CELL = 64 * 1024 * 1024
# Bytes of query vectors that the table of probes hands back to Spark at a time.
PROBE_BYTES = 8 * 1024 * 1024
# Lists whose cells are planned by a broadcast table.
MAX_BROADCAST_LISTS = 1_000_000

# (queries of a cell, their ids, list number, rows of the cell) -> hits
Score = Callable[[np.ndarray, pa.Array, int, pa.RecordBatch], Iterator[pa.RecordBatch]]


def checked(queries: DataFrame) -> DataFrame:
    """The queries; a missing vector or a qid that several queries share raises."""
    several = queries.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("qvec").isNull()).alias("missing"))
    wrong = several.filter((F.col("n") > 1) | (F.col("missing") > 0) | F.col("qid").isNull()).first()
    if wrong is not None:
        raise ValueError("a query has no vector" if wrong.missing else "every query needs a qid of its own")
    return queries


def probes_of(nearest: Callable[[np.ndarray], np.ndarray]):
    """A ``mapInArrow`` function: a row for each list of each query, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("qvec")
            width = len(column[0])
            lists = nearest(list_column_to_matrix(column, width, np.float64))
            step = max(1, PROBE_BYTES // (8 * max(1, width)))
            for start in range(0, lists.size, step):
                probes = np.arange(start, min(start + step, lists.size))
                owner = pa.array(probes // lists.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.ravel()[probes].astype(np.int32)), batch.column("qid").take(owner), column.take(owner)],
                    names=["cluster_id", "qid", "qvec"],
                )

    return run


def probe_table(queries: DataFrame, nearest: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(cluster_id, qid, qvec)``: a row for each list that a query probes; ``nearest`` gives the lists of unit vectors."""
    qid_type = queries.schema["qid"].dataType
    schema = T.StructType(
        [T.StructField("cluster_id", T.IntegerType()), T.StructField("qid", qid_type), T.StructField("qvec", T.ArrayType(T.DoubleType()))]
    )
    return queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).mapInArrow(probes_of(nearest), schema)


def probe_everything(queries: DataFrame) -> DataFrame:
    """The same where all rows count as one list: a row for each query."""
    return queries.select(F.lit(0).alias("cluster_id"), "qid", F.col("qvec").cast("array<double>").alias("qvec"))


def search_cells(
    lists: DataFrame, probes: DataFrame, k: int, score: Score, n_lists: int, rows_per_cell: int, queries_per_cell: int
) -> DataFrame:
    """The k nearest of every query among the rows of the lists it probes, as ``(qid, rank, id, dist)``."""
    queries_per_cell = max(1, min(queries_per_cell, RESULT_BYTES_PER_CELL // (16 * min(k, rows_per_cell))))
    sizes = lists.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    demand = probes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m"))
    grid = sizes.join(demand, "cluster_id").select(
        "cluster_id",
        F.ceil(F.col("n") / rows_per_cell).cast("int").alias("row_parts"),
        F.ceil(F.col("m") / queries_per_cell).cast("int").alias("query_parts"),
    )
    grid = F.broadcast(grid) if n_lists <= MAX_BROADCAST_LISTS else grid
    own = lambda column, parts: F.pmod(F.xxhash64(column), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    payload = [c for c in lists.columns if c not in ("cluster_id", "id")]
    rows = lists.join(grid, "cluster_id").select(
        "cluster_id", own("id", "row_parts").alias("row_part"), every("query_parts").alias("query_part"), "id", *payload
    )
    asked = probes.join(grid, "cluster_id").select(
        "cluster_id", every("row_parts").alias("row_part"), own("qid", "query_parts").alias("query_part"), "qid", "qvec"
    )
    schema = T.StructType([probes.schema["qid"], T.StructField("id", T.LongType()), T.StructField("dist", T.DoubleType())])

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and rows.num_rows:
            column = asked.column("qvec").combine_chunks()
            vectors = list_column_to_matrix(column, len(column[0]), np.float64)
            batch = rows.combine_chunks().to_batches()[0]
            found = list(score(vectors, asked.column("qid").combine_chunks(), asked.column("cluster_id")[0].as_py(), batch))
        if not found:
            return pa.table({"qid": asked.column("qid").slice(0, 0), "id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        return pa.Table.from_batches(found)

    cell = ["cluster_id", "row_part", "query_part"]
    return top_k(asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(meet, schema), k)


def score_exactly(k: int) -> Score:
    """Cells of stored vectors."""

    def score(queries, qids, cluster, batch):
        return scan_vectors(queries, qids, k, everything(len(queries)))(iter([batch]))

    return score


def score_by_codes(k: int, tables_of: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> Score:
    """Cells of product codes; ``tables_of`` gives the lookup tables of queries and their products with a list's centroid."""

    def score(queries, qids, cluster, batch):
        tables, base = tables_of(queries, cluster)
        members = {cluster: np.arange(len(queries))}
        return scan_codes(tables, {cluster: (members[cluster], base)}, qids, k, by_value("cluster_id", members))(iter([batch]))

    return score
