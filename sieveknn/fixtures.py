"""The item table and workloads that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import pool_query

# Attributes and vectors derived from the given tables; the same text runs in other SQL engines.
ITEMS_SQL = """
SELECT e.vec_id AS id, e.embedding, e.label,
  CASE WHEN o.o_orderpriority = '1-URGENT' AND l.quality IS NOT NULL THEN 'NSFW'
       WHEN o.o_orderpriority = '1-URGENT' THEN 'UNSURE' ELSE 'UNLIKELY' END AS NSFW,
  CASE WHEN l.quality = 1 THEN 'CC-BY' WHEN l.quality = 0 THEN 'PUBLIC-DOMAIN' END AS LICENSE,
  CASE WHEN e.vec_id % 20 = 7 THEN NULL ELSE v.value / 1000 END AS similarity,
  CAST(o.o_custkey % 8 AS BIGINT) * 256 + 256 AS original_width,
  CAST(v.user_id % 8 AS BIGINT) * 256 + 256 AS original_height,
  v.event_type AS kind,
  concat('item ', CAST(e.vec_id AS STRING)) AS caption
FROM {embeddings} e
LEFT JOIN {orders} o ON o.o_orderkey = e.vec_id
LEFT JOIN {events} v ON v.event_id = e.vec_id
LEFT JOIN {labels} l ON l.doc_id = e.vec_id
"""

# (qid, ids of the stored vectors that are pooled into the query, WHERE clause)
WORKLOADS = [
    (1, [3], "nsfw = 'UNSURE'"),
    (2, [10, 11], "original_width > original_height and license is NULL"),
    (3, [42], "original_width = original_height and license is not NULL and nsfw='NSFW'"),
    (4, [77], "license is NULL"),
    (5, [123], "original_width > 1024 and original_height > 1024"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item table.  Its sides grow with the data, and Spark takes them for small by the size of their files: none is broadcast."""
    tables = {name: table(spark, sf_dir, name).hint("merge") for name in ("orders", "events", "labels")}
    return spark.sql(ITEMS_SQL, embeddings=table(spark, sf_dir, "embeddings"), **tables)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item attributes; the vectors are pruned from the scan."""
    return items(spark, sf_dir).drop("embedding")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def workloads(spark: SparkSession, sf_dir: str, qids: list[int] | None = None) -> DataFrame:
    """``(qid, qvec, where_sql)``: stored vectors, pooled per workload."""
    chosen = [w for w in WORKLOADS if qids is None or w[0] in qids]
    members = spark.createDataFrame(
        [(qid, vector_id, where) for qid, vector_ids, where in chosen for vector_id in vector_ids],
        "qid bigint, id bigint, where_sql string",
    )
    wanted = sorted({vector_id for _, vector_ids, _ in chosen for vector_id in vector_ids})
    stored = embeddings(spark, sf_dir).filter(F.col("id").isin(wanted))
    vectors = stored.join(F.broadcast(members), "id").select("qid", F.col("embedding").alias("vec"))
    clauses = members.select("qid", "where_sql").distinct()
    return pool_query(vectors).join(F.broadcast(clauses), "qid")
