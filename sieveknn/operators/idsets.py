"""Sets of matching ids as bitmaps: 4 KB for 32,768 neighbouring ids, however many of them match.

A filter's matches meet the vectors through these bitmaps at every size. An id that is NULL is in no set, one that the
metadata repeats is in it once. The set is joined by bucket and the id's own bit is tested inside the JVM,
so neither lists of ids nor hash tables of ids are made.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: ids of one bucket in Spark's bitmap functions.
BUCKET_IDS = 32_768
# Bitmaps that may be broadcast together: 4 KB each, 128 MB.
MAX_BROADCAST_BITMAPS = 32_768


@dataclass
class Matches:
    """What one scan of the metadata says about a filter: rows, matching rows, least and greatest matching id."""

    n_total: int
    n_filtered: int
    low: int | None = None
    high: int | None = None

    @property
    def most_buckets(self) -> int:
        """An upper bound of the buckets that hold a match."""
        if self.low is None or self.high is None:
            return 0
        return min(self.n_filtered, (self.high - self.low) // BUCKET_IDS + 3)


def as_condition(where: str | Column) -> Column:
    return F.expr(where) if isinstance(where, str) else where


def measure(meta: DataFrame, wheres: Sequence[str | Column]) -> list[Matches]:
    """``Matches`` of each filter, from one scan and one row brought to the driver."""
    columns = [F.count(F.lit(1))]
    for where in wheres:
        matching = F.when(as_condition(where), F.col("id"))
        columns += [F.count_if(as_condition(where)), F.min(matching), F.max(matching)]
    row = meta.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [Matches(row[0], *row[i : i + 3]) for i in range(1, len(row), 3)]


def together(matches: Sequence[Matches]) -> Matches:
    """A bound for the rows that match any of several filters."""
    lows, highs = ([getattr(m, side) for m in matches if getattr(m, side) is not None] for side in ("low", "high"))
    total = matches[0].n_total if matches else 0
    return Matches(total, sum(m.n_filtered for m in matches), min(lows, default=None), max(highs, default=None))


def any_of(wheres: Sequence[str | Column]) -> Column:
    return reduce(or_, [as_condition(where) for where in wheres])


def id_bitmaps(meta: DataFrame, wheres: Sequence[str | Column]) -> DataFrame:
    """``(bucket, f0, f1, ...)``: of each bucket with any match, the bitmap of each filter's ids.

    Of several filters ``any`` holds the ids that match one at least. Rows are kept by the filters and by ``any``, not by the
    flags: over conditions of many aliased flags Spark's inference of constraints grows as two to their number.
    """
    flags = [F.coalesce(as_condition(where), F.lit(False)).alias(f"f{i}") for i, where in enumerate(wheres)]
    names = [f"f{i}" for i in range(len(flags))]
    rows = meta.filter(F.col("id").isNotNull()).filter(any_of(wheres)).select("id", *flags)
    place = rows.select(F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"), *names)
    maps = [F.expr(f"bitmap_construct_agg(bit) FILTER (WHERE {name})").alias(name) for name in names]
    if len(names) > 1:
        maps.append(F.bitmap_construct_agg("bit").alias("any"))
    return place.groupBy("bucket").agg(*maps)


def is_member(bits: Column | str, id_: Column | str = "id") -> Column:
    """Whether the bit of an id is set in the bitmap of its bucket."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    position = F.bitmap_bit_position(id_)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, position.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))
    return F.coalesce(bit == 1, F.lit(False))


def with_flags(rows: DataFrame, bitmaps: DataFrame, matches: Matches, small: bool | None = None) -> DataFrame:
    """The rows that are in any set, with a boolean for each in place of its bitmap.

    Bitmaps of a bounded number of buckets are broadcast and the rows stay where they are; beyond that both are dealt by bucket.
    The least and greatest matching id limit the scan.
    """
    names = [c for c in bitmaps.columns if c not in ("bucket", "any")]
    if small is None:
        small = fits_broadcast(matches, len(bitmaps.columns) - 1)
    rows = rows.filter(F.col("id").between(F.lit(matches.low), F.lit(matches.high)))
    sets = (F.broadcast(bitmaps) if small else bitmaps).alias("sets")
    joined = rows.join(sets, F.bitmap_bucket_number(rows["id"]) == F.col("sets.bucket"))
    members = joined.filter(is_member(F.col("sets.any") if len(names) > 1 else F.col("sets.f0"), rows["id"]))
    return members.select(*[rows[c] for c in rows.columns], *[is_member(F.col(f"sets.{name}"), rows["id"]).alias(name) for name in names])


def fits_broadcast(matches: Matches, n_sets: int = 1) -> bool:
    return matches.most_buckets * n_sets <= MAX_BROADCAST_BITMAPS
