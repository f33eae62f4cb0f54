"""Structured filters over the metadata.

A filter is any Spark SQL boolean expression (F2-F6 and F8-F12 are such expressions), or keyword
conditions.  Results stay DataFrames of ids; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword condition -> metadata column.
EQUALITY_FIELDS = {"nsfw": "NSFW", "license": "LICENSE"}
RANGE_FIELDS = {"similarity": "similarity", "width": "original_width", "height": "original_height"}


def similarity_null_as_zero(df: DataFrame) -> DataFrame:
    """treat a missing similarity as 0."""
    return df.withColumn("similarity", F.coalesce(F.col("similarity"), F.lit(0.0)))


def filter_where(df: DataFrame, where: str | Column, null_as_zero: bool = False) -> DataFrame:
    """ids of the rows satisfying a WHERE clause.  A malformed clause raises."""
    source = similarity_null_as_zero(df) if null_as_zero else df
    return source.filter(where).select("id")


def keyword_condition(**conditions) -> Column | None:
    """The conjunction behind ``filter_by``; None without conditions."""
    parts: list[Column] = []
    for key, value in conditions.items():
        field, _, bound = key.rpartition("_")
        if key in EQUALITY_FIELDS:
            parts.append(F.col(EQUALITY_FIELDS[key]) == F.lit(value))
        elif field in RANGE_FIELDS and bound == "min":
            parts.append(F.col(RANGE_FIELDS[field]) >= F.lit(value))
        elif field in RANGE_FIELDS and bound == "max":
            parts.append(F.col(RANGE_FIELDS[field]) <= F.lit(value))
        else:
            raise ValueError(f"unknown condition: {key}")
    return reduce(and_, parts) if parts else None


def filter_by(df: DataFrame, null_as_zero: bool = False, **conditions) -> DataFrame:
    """ids matching all of ``nsfw=``, ``license=`` and ``{similarity,width,height}_{min,max}=``.

    Bounds are inclusive, a bound left out is open, and no conditions at all select nothing.
    """
    condition = keyword_condition(**conditions)
    return filter_where(df, F.lit(False) if condition is None else condition, null_as_zero)


def conjunct_profile(df: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """how many rows match each predicate, fewest first, all counted in one scan."""
    if not predicates:
        raise ValueError("no predicates to profile")
    counts = df.agg(*[F.count_if(F.expr(p)).alias(f"c{i}") for i, p in enumerate(predicates)])
    entries = [
        F.struct(F.lit(p).alias("predicate"), F.col(f"c{i}").alias("n_rows")) for i, p in enumerate(predicates)
    ]
    return counts.select(F.inline(F.array(*entries))).orderBy("n_rows", "predicate")


def rows_with_license(df: DataFrame, value: str) -> DataFrame:
    """ids of the rows carrying a licence."""
    return df.filter(F.col("LICENSE") == F.lit(value)).select("id")


def distinct_values(df: DataFrame, column: str = "LICENSE") -> DataFrame:
    """F16: the distinct non-null values of a column."""
    return df.filter(F.col(column).isNotNull()).select(column).distinct()


def fetch_rows(df: DataFrame, result: DataFrame, max_rows: int | None = None) -> DataFrame:
    """full rows for search results ``(qid, rank, id, ...)`` in result order.

    A search result has at most ``queries * k`` rows: pass that product as ``max_rows`` and a result
    small enough is broadcast, so that the wide table is scanned without a shuffle.
    """
    hits = bounded_broadcast(result, max_rows)
    extra = [c for c in df.columns if c not in result.columns]
    return df.join(hits, "id").select(*result.columns, *extra).orderBy("qid", "rank")


# Rows of two or three numbers that may be broadcast: about 100 MB in an executor's hash table.
MAX_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Hint a broadcast only when a proven row bound allows it; otherwise leave the join to Spark."""
    if max_rows is not None and max_rows <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def count_matches(df: DataFrame, wheres: Sequence[str | Column]) -> tuple[int, list[int]]:
    """Total rows and matching rows of each clause, from one scan and one row brought to the driver."""
    condition = lambda w: F.expr(w) if isinstance(w, str) else w
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(condition(w)).alias(f"c{i}") for i, w in enumerate(wheres)],
    ).first()
    return row[0], list(row[1:])


def selectivity(df: DataFrame, where: str) -> DataFrame:
    """``(n_filtered, n_total, selectivity)`` of a clause; an empty table has selectivity 0."""
    counts = df.agg(F.count_if(F.expr(where)).alias("n_filtered"), F.count(F.lit(1)).alias("n_total"))
    share = F.when(F.col("n_total") == 0, F.lit(0.0)).otherwise(F.col("n_filtered") / F.col("n_total"))
    return counts.withColumn("selectivity", share)
