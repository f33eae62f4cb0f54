"""Column predicates that plain SQL comparison does not cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tolerances of float equality.
RELATIVE_TOLERANCE = 1e-9
ABSOLUTE_TOLERANCE = 1e-9

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def approx_eq(df: DataFrame, a: str, b: str) -> Column:
    """exact equality of integral columns, closeness of floating ones; false on NULL or NaN.

    Only the right-hand value scales the relative tolerance.
    """
    left, right = F.col(a), F.col(b)
    types = {field.name.lower(): field.dataType for field in df.schema.fields}
    if isinstance(types[a.lower()], _INTEGRAL) and isinstance(types[b.lower()], _INTEGRAL):
        equal = left == right
    else:
        left, right = left.cast("double"), right.cast("double")
        close = F.abs(left - right) <= ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * F.abs(right)
        # NaN compares as equal to itself in Spark, and infinities differ by NaN: settle both first
        equal = (
            F.when(F.isnan(left) | F.isnan(right), F.lit(False))
            .when(left == right, F.lit(True))
            .when(F.abs(right) == F.lit(float("inf")), F.lit(False))
            .otherwise(close)
        )
    return F.coalesce(equal, F.lit(False))
