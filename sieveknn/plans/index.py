"""Vector indexes stored as Parquet tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..operators.ivf import (
    NPROBE,
    assign_clusters,
    default_nlist,
    ivf_counts,
    ivf_pass,
    ivf_search,
    spread,
    train_ivf,
    train_sample,
    write_lists,
)
from ..operators.kernel import Marks, by_flag, count_closer, everything, list_column_to_matrix, scan_vectors
from ..operators.nearest import QueryBatch, knn_pass, search_in_passes
from ..operators.pq import choose_m, ivfpq_counts, ivfpq_pass, ivfpq_search, lookup_bytes, pq_encode, train_pq
from ..operators.topk import top_k

KINDS = ("Flat", "IVF", "IVFPQ")
VERSION_SCHEMA = (
    "kind string, path string, n bigint, d int, nlist int, m int, bits int, seed bigint, built_at string"
)
ROW_SCHEMAS = {
    "Flat": "id bigint, embedding array<float>",
    "IVF": "id bigint, embedding array<float>, cluster_id int",
    "IVFPQ": "id bigint, code array<smallint>, cluster_id int, off float",
}


@dataclass
class VectorIndex:
    """Tables of one index version: vectors or codes by list, centroids, codebooks."""

    kind: str
    path: str
    n: int
    d: int
    nlist: int = 0
    m: int = 0
    bits: int = 0
    seed: int = 0
    centroids: np.ndarray | None = field(default=None, repr=False)
    codebooks: np.ndarray | None = field(default=None, repr=False)
    _rows: DataFrame | None = field(default=None, repr=False, compare=False)

    @property
    def exact(self) -> bool:
        """Whether the distances it returns are exact."""
        return self.kind != "IVFPQ"

    def rows(self, spark: SparkSession) -> DataFrame:
        """The stored vectors or codes.

        The files are listed once and the listing kept.
        """
        if self._rows is None or self._rows.sparkSession is not spark:
            self._rows = spark.read.schema(ROW_SCHEMAS[self.kind]).parquet(f"{self.path}/rows")
        return self._rows

    def search_pass(
        self,
        spark: SparkSession,
        batch: QueryBatch,
        k: int,
        nprobe: int = NPROBE,
        rows: DataFrame | None = None,
        flags: dict[str, np.ndarray] | None = None,
    ) -> DataFrame:
        """The k nearest of one pass; ``rows`` with boolean columns named in ``flags`` take the place of all stored rows."""
        rows = self.rows(spark) if rows is None else rows
        if self.kind == "Flat":
            split = everything(len(batch)) if flags is None else by_flag(flags)
            found = rows.select("id", "embedding", *(flags or ())).mapInArrow(scan_vectors(batch.vectors, batch.qids, k, split), batch.result_schema())
            return top_k(found, k)
        if self.kind == "IVF":
            return ivf_pass(rows, self.centroids, batch, k, nprobe, flags)
        return ivfpq_pass(rows, self.centroids, self.codebooks, batch, k, nprobe, flags)

    def count_pass(self, spark: SparkSession, batch: QueryBatch, marks: Marks, nprobe: int = NPROBE) -> DataFrame:
        """Partial counts ``(qid, mark, n)`` of the rows that a search would read and that come before each mark."""
        rows = self.rows(spark)
        if self.kind == "Flat":
            return rows.select("id", "embedding").mapInArrow(count_closer(batch.vectors, batch.qids, marks), batch.count_schema())
        if self.kind == "IVF":
            return ivf_counts(rows, self.centroids, batch, marks, nprobe)
        return ivfpq_counts(rows, self.centroids, self.codebooks, batch, marks, nprobe)

    @property
    def query_bytes(self) -> int:
        """What a query needs in every task besides its vector."""
        return lookup_bytes(self.codebooks) if self.kind == "IVFPQ" else 0

    def search(self, queries: DataFrame, k: int, nprobe: int = NPROBE) -> DataFrame:
        """The k nearest found for every query, as ``(qid, rank, id, dist)``; the lists are read once, whatever the number of queries."""
        rows = self.rows(queries.sparkSession)
        if self.kind == "Flat":
            return search_in_passes(queries, k, lambda batch: knn_pass(rows, batch, k))
        if self.kind == "IVF":
            return ivf_search(rows, self.centroids, queries, k, nprobe)
        return ivfpq_search(rows, self.centroids, self.codebooks, queries, k, nprobe)

    def add(self, emb: DataFrame) -> None:
        """Append vectors, assigned to the existing lists (the index is not trained again)."""
        self._write(emb, "append")
        self._rows = None
        self.n = self.rows(emb.sparkSession).count()
        self.record(emb.sparkSession)

    def compact(self, spark: SparkSession) -> None:
        """After many ``add``: the lists as one set of ranges again, as a new version; searches under way keep theirs."""
        rows = self.rows(spark)
        old, self.path = self.path, f"{self.path.rpartition('/')[0]}/{uuid.uuid4().hex}"
        if self.kind == "Flat":
            rows.write.parquet(f"{self.path}/rows")
        else:
            write_lists(rows, f"{self.path}/rows")
        for table in ("centroids", "codebook") if self.kind == "IVFPQ" else ("centroids",) if self.kind == "IVF" else ():
            spark.read.parquet(f"{old}/{table}").write.parquet(f"{self.path}/{table}")
        self._rows = None
        self.record(spark)

    def record(self, spark: SparkSession) -> None:
        """List this version, as it is now, as the newest."""
        values = (self.kind, self.path, self.n, self.d, self.nlist, self.m, self.bits, self.seed)
        row = spark.createDataFrame([(*values, datetime.now(timezone.utc).isoformat())], VERSION_SCHEMA)
        folder = self.path.rpartition("/")[0]
        row.coalesce(1).write.mode("append").parquet(f"{folder}/versions")

    def _write(self, emb: DataFrame, mode: str) -> None:
        path = f"{self.path}/rows"
        if self.kind == "Flat":
            unit = l2_normalize("embedding").cast("array<float>").alias("embedding")
            emb.filter(F.col("embedding").isNotNull()).select("id", unit).write.mode(mode).parquet(path)
        elif self.kind == "IVF":
            write_lists(assign_clusters(emb, self.centroids), path, mode)
        else:
            write_lists(pq_encode(emb, self.centroids, self.codebooks), path, mode)


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_index(spark: SparkSession, path: str) -> VectorIndex | None:
    """The newest complete version stored below ``path``, or None."""
    versions = _versions(spark, path)
    newest = versions.orderBy(F.desc("built_at")).first() if versions is not None else None
    if newest is None:
        return None
    index = VectorIndex(
        newest.kind, newest.path, newest.n, newest.d, newest.nlist, newest.m, newest.bits, newest.seed
    )
    if index.kind != "Flat":
        stored = spark.read.parquet(f"{index.path}/centroids").orderBy("cluster_id").toArrow()
        index.centroids = _matrix(stored.column("centroid"))
    if index.kind == "IVFPQ":
        words = _matrix(spark.read.parquet(f"{index.path}/codebook").orderBy("m", "code").toArrow().column("subvec"))
        index.codebooks = words.reshape(index.m, -1, words.shape[1])
    return index


def build_or_load(
    spark: SparkSession,
    path: str,
    emb: DataFrame,
    kind: str = "IVFPQ",
    nlist: int | None = None,
    m: int = 8,
    bits: int = 8,
    rebuild: bool = False,
    seed: int = 42,
    train_size: int | None = None,
) -> VectorIndex:
    """Load the index at ``path``, or build and store it.

    Training reads every vector; ``train_size`` draws a sample instead.  A build writes a new version folder and lists it last, so a build that dies leaves the previous
    version in force, and searches running during a rebuild keep their tables.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown index type {kind!r}; expected one of {KINDS}")
    if not rebuild:
        existing = load_index(spark, path)
        if existing is not None:
            if existing.kind != kind:
                raise ValueError(f"{path} holds an index of type {existing.kind}, not {kind}")
            return existing
    vectors = emb.select("id", "embedding")
    first = vectors.filter(F.col("embedding").isNotNull()).select(F.size("embedding").alias("d")).first()
    if first is None:
        raise ValueError("no vectors to index")
    version = f"{path}/{uuid.uuid4().hex}"
    index = VectorIndex(kind, version, vectors.count(), first.d, seed=seed)
    if kind != "Flat":
        index.nlist = default_nlist(index.n) if nlist is None else nlist
        # the sample is stored once: k-means reads it many times
        train_sample(vectors, train_size, seed).write.parquet(f"{version}/sample")
        sample = spark.read.parquet(f"{version}/sample")
        index.centroids = train_ivf(spread(sample), index.nlist, seed)
        index.nlist = len(index.centroids)
        if kind == "IVFPQ":
            index.m, index.bits = choose_m(index.d, m), bits
            index.codebooks = train_pq(sample, index.centroids, f"{version}/residuals", index.m, bits, seed)
        _store_centroids(spark, index)
    index._write(vectors, "errorifexists")
    index.n = index.rows(spark).count()  # rows without a vector are not stored
    index.record(spark)
    return index


def _vectors(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.astype(np.float32).ravel()), matrix.shape[1]).cast(pa.list_(pa.float32()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return list_column_to_matrix(column, len(column[0]), np.float32)


def _store_centroids(spark: SparkSession, index: VectorIndex) -> None:
    numbers = pa.array(np.arange(len(index.centroids), dtype=np.int32))
    spark.createDataFrame(pa.table({"cluster_id": numbers, "centroid": _vectors(index.centroids)})).write.parquet(f"{index.path}/centroids")
    if index.codebooks is not None:
        m, size, width = index.codebooks.shape
        part, code = np.divmod(np.arange(m * size, dtype=np.int32), size)
        words = pa.table({"m": pa.array(part), "code": pa.array(code), "subvec": _vectors(index.codebooks.reshape(-1, width))})
        spark.createDataFrame(words).write.parquet(f"{index.path}/codebook")
