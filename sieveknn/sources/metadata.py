"""Reading, numbering, checking and writing the metadata and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Files listed in the offset table that may still be broadcast (about 100 bytes each).
MAX_BROADCAST_FILES = 200_000


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in floating columns, so that "missing" is always NULL.

    Spark orders NaN above every number and equates it with itself, which would let missing values
    pass range and equality filters.
    """
    floating = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(floating) if floating else df


def read_metadata(spark: SparkSession, path: str | list[str], nan_as_null: bool = True) -> DataFrame:
    """All Parquet shards matching a glob as one table; no match raises ``AnalysisException``.

    The NaN clean-up hides floating columns from Parquet push-down.  Tables written by
    ``write_metadata`` are already clean: read those with ``nan_as_null=False``.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return nan_to_null(df) if nan_as_null else df


def describe(df: DataFrame) -> DataFrame:
    """Column names and types as ``(name, type)``."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string")


def row_count(df: DataFrame) -> DataFrame:
    """S3: total number of rows as ``(n_rows)``; no column is read."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def with_global_id(df: DataFrame, id_column: str = "id") -> DataFrame:
    """Contiguous ids 0..N-1 over Parquet files in sorted path order.

    A row's id is its position in its file plus the rows of all earlier files.  Positions come from
    the scan itself, so there is no sort and no shuffle of the rows; only the small per-file table is
    aggregated.  ``df`` must come straight from a Parquet scan.
    """
    located = df.withColumns({"__path": F.col("_metadata.file_path"), "__pos": F.col("_metadata.row_index")})
    sizes = located.groupBy("__path").agg((F.max("__pos") + 1).alias("__rows"))
    earlier = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__path", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"))
    if len(df.inputFiles()) <= MAX_BROADCAST_FILES:
        starts = F.broadcast(starts)
    numbered = located.join(starts, "__path")
    return numbered.select((F.col("__start") + F.col("__pos")).alias(id_column), *df.columns)


def write_metadata(
    df: DataFrame, path: str, sort_by: list[str] | None = None, partition_by: list[str] | None = None
) -> None:
    """Clean metadata to Parquet.

    ``sort_by`` sorts inside each written file, which tightens the min/max statistics that later
    range filters skip by; ``partition_by`` suits low-cardinality categories.
    """
    clean = nan_to_null(df)
    if partition_by:
        clean = clean.hint("rebalance", *partition_by)
    if sort_by:
        clean = clean.sortWithinPartitions(*(partition_by or []), *sort_by)
    writer = clean.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "id") -> None:
    """Store a table bucketed and sorted by id.

    Metadata and embeddings stored with the same bucket count join on id without a shuffle, which
    is what keeps a broad pre-filter cheap when the vectors are far larger than the metadata.
    """
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def read_embeddings(
    spark: SparkSession, path: str, id_column: str = "id", vector_column: str = "embedding"
) -> DataFrame:
    """The embedding table as ``(id, embedding)``; only these two columns are read."""
    return spark.read.parquet(path).select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(vector_column).cast("array<float>").alias("embedding"),
    )


def check_alignment(meta: DataFrame, emb: DataFrame, dim: int | None = None) -> DataFrame:
    """Compare ids and vector widths of the two data sets in one aggregation.

    Returns ``(n_meta, n_emb, only_meta, only_emb, n_bad_dim)``.  Both sides are tagged and grouped
    by id instead of joined, so an id repeated very often cannot multiply rows.
    """
    if dim is None:
        first = emb.filter(F.col("embedding").isNotNull()).select(F.size("embedding").alias("dim")).first()
        dim = first.dim if first else 0
    width = F.coalesce(F.size("embedding"), F.lit(-1))
    tagged = meta.select("id", F.lit(1).alias("m"), F.lit(0).alias("e"), F.lit(0).alias("bad")).unionAll(
        emb.select("id", F.lit(0), F.lit(1), (width != dim).cast("int"))
    )
    per_id = tagged.groupBy("id").agg(F.sum("m").alias("m"), F.sum("e").alias("e"), F.sum("bad").alias("bad"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_id.agg(
        total("m").alias("n_meta"),
        total("e").alias("n_emb"),
        F.count_if(F.col("e") == 0).alias("only_meta"),
        F.count_if(F.col("m") == 0).alias("only_emb"),
        total("bad").alias("n_bad_dim"),
    )


def require_alignment(meta: DataFrame, emb: DataFrame, dim: int | None = None) -> None:
    """Raise ``ValueError`` unless every id has one metadata row and one vector of the same width."""
    row = check_alignment(meta, emb, dim).first()
    if row.n_meta != row.n_emb or row.only_meta or row.only_emb or row.n_bad_dim:
        raise ValueError(f"metadata and embeddings do not align: {row.asDict()}")


def write_report(df: DataFrame, path: str) -> None:
    """A results table as CSV part files, each with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)
