"""Vector expressions (V1-V6) built from Spark's own array functions.

Everything accumulates in double precision, also over ``array<float>`` columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VectorLike = Column | str | Sequence[float]

# Distances are settled to this many steps per unit, so that the rounding noise of a sum never
# decides an order: equal distances stay equal whichever way they were computed, and ids break the tie.
STEPS_PER_UNIT = 1e12


def settle(distance: Column) -> Column:
    return F.rint(distance * F.lit(STEPS_PER_UNIT)) / F.lit(STEPS_PER_UNIT)


def as_vector(value: VectorLike) -> Column:
    """A column from a column, a column name or a plain sequence of numbers."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    numbers = [float(x) for x in value]
    if all(math.isfinite(x) for x in numbers):
        # one constant, folded when the query is optimised; an array of single literals would be
        # analysed element by element
        return F.from_json(F.lit(str(numbers)), "array<double>")
    return F.lit(numbers)


def dot(a: VectorLike, b: VectorLike) -> Column:
    """V2: inner product."""
    products = F.zip_with(as_vector(a), as_vector(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(v: VectorLike) -> Column:
    squares = F.aggregate(
        as_vector(v), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def _safe_norm(v: VectorLike) -> Column:
    """The norm, or 1 for a zero vector, so that dividing leaves a zero vector unchanged."""
    norm = l2_norm(v)
    return F.when(norm == 0.0, F.lit(1.0)).otherwise(norm)


def l2_normalize(v: VectorLike) -> Column:
    """V1: scale to unit length; a zero vector comes back unchanged."""
    vector = as_vector(v)
    norm = _safe_norm(vector)
    # the norm is wrapped in a one-element array so that it is computed once per vector
    return F.flatten(
        F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: x.cast("double") / n))
    )


def cosine_similarity(a: VectorLike, b: VectorLike, normalized: bool = False) -> Column:
    """V2: cosine of the angle; ``normalized=True`` skips the norms of unit-length input."""
    if normalized:
        return dot(a, b)
    return dot(a, b) / (_safe_norm(a) * _safe_norm(b))


def distance_to_unit(vector: VectorLike, unit_query: Sequence[float], normalized: bool = False) -> Column:
    """Cosine distance to a query that already has unit length."""
    similarity = dot(vector, unit_query)
    return settle(F.lit(1.0) - (similarity if normalized else similarity / _safe_norm(vector)))


def cosine_distance(a: VectorLike, b: VectorLike, normalized: bool = False) -> Column:
    """V3: one minus the cosine similarity."""
    return settle(F.lit(1.0) - cosine_similarity(a, b, normalized))


def l2_sq_distance(a: VectorLike, b: VectorLike) -> Column:
    """V4: squared Euclidean distance."""
    gaps = F.zip_with(as_vector(a), as_vector(b), lambda x, y: x.cast("double") - y.cast("double"))
    return settle(F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g))


def pool_query(vectors: DataFrame, qid: str = "qid", vector: str = "vec") -> DataFrame:
    """V5: one query per ``qid``: normalise each vector, average, normalise again.

    ``Summarizer.mean`` combines on the map side, so a query with very many vectors costs one
    partial mean per task and never a collected list.  A ``qid`` without any vector is an error.
    """
    named = vectors.select(F.col(qid).alias("qid"), F.col(vector).alias("vec"))
    means = (
        named.filter(F.col("vec").isNotNull())
        .select("qid", array_to_vector(l2_normalize("vec")).alias("unit"))
        .groupBy("qid")
        .agg(vector_to_array(Summarizer.mean(F.col("unit"))).alias("mean"))
    )
    checked = F.coalesce("mean", F.raise_error(F.lit("pool_query: a query has no vectors")).cast("array<double>"))
    every = named.select("qid").distinct().join(means, "qid", "left")
    return every.select("qid", l2_normalize(checked).alias("qvec"))


def query_by_id(emb: DataFrame, vector_id: int, qid: int | None = None) -> DataFrame:
    """V6: a stored vector as a one-row query frame ``(qid, qvec)``."""
    return emb.filter(F.col("id") == F.lit(vector_id)).select(
        F.lit(vector_id if qid is None else qid).cast("bigint").alias("qid"),
        l2_normalize("embedding").alias("qvec"),
    )
