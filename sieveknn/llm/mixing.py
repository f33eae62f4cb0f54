"""Mixing sources: temperature weights, realised as budgeted block permutations.

A source's share of all tokens, raised to an exponent between 0 and 1 and normalised, is its weight:
1 keeps the natural mixture, 0 gives all sources the same weight. The exponent is the largest whose
weights reach the target entropy, unless repetition would exceed its limit; then it is the
smallest that stays within the limit. The budget is such that every source is used whole at least
once; a source whose weight asks for more is read again, in a permutation of its blocks and of the
documents within a block, up to its budget of tokens.

* A null source is a source of its own, a null text is empty. Sources without any token have weight 0
  and each document once.
* Rows with the same id share their place in the permutation, and are taken or left together.
* No documents give no rows. Further columns are ignored by ``mix_plan`` and kept by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveknn.llm.common import WORD, stored, whole_text

BLOCK_DOCS = 256
TARGET_ENTROPY = 0.95  # of the entropy that equal weights would have
MAX_REPETITION = 2.0
SEED = "mix-1"
_POINTS = 33  # exponents tried in one pass over the sources
_DIGITS = 6


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts).cast("binary"))


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def count_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, source_key, n_tokens, place``: words of each document and its place in any permutation."""
    return docs.select(
        "doc_id",
        _source().alias("source_key"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("n_tokens"),
        _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("place"),
    )


def _narrow(evaluate, reached, rounds: int = 6) -> float:
    """The largest exponent in [0, 1] for which ``reached`` holds (it holds at 0), one job for each round.

    Plain bisection halves; a pass over the sources costs a job, so each halves five times at once.
    """
    low, high = 0.0, 1.0
    for _ in range(rounds):
        points = [low + (high - low) * i / (_POINTS - 1) for i in range(_POINTS)]
        good = [reached(value) for value in evaluate(points)]
        if good[-1]:
            return points[-1]
        last = max((i for i, ok in enumerate(good) if ok), default=0)
        low, high = points[last], points[last + 1]
    return low


def find_exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION) -> float:
    """The exponent for ``sources(source_key, tokens)``, to six digits; only sums reach the driver."""
    used = sources.where("tokens > 0")
    n, top, low = used.agg(F.count("*"), F.max("tokens"), F.min("tokens")).first()
    if not n or n == 1:
        return 1.0

    def entropies(points: list[float]) -> list[float]:
        # With x = share relative to the largest: H = log(sum x^a) - a * sum(x^a log x) / sum(x^a).
        x = F.col("tokens") / F.lit(float(top))
        row = used.agg(
            *[F.sum(F.pow(x, F.lit(a))).alias(f"s{i}") for i, a in enumerate(points)],
            *[F.sum(F.pow(x, F.lit(a)) * F.log(x)).alias(f"t{i}") for i, a in enumerate(points)],
        ).first()
        return [math.log(row[f"s{i}"]) - a * row[f"t{i}"] / row[f"s{i}"] for i, a in enumerate(points)]

    goal = target_entropy * math.log(n)
    exponent = _narrow(entropies, lambda value: value >= goal - 1e-12)
    # Repetition of the smallest source is (top / low) ** (1 - exponent), the largest one's is 1.
    spread = math.log(top / low)
    if spread > 0:
        exponent = max(exponent, 1 - math.log(max_repetition) / spread)
    return round(min(1.0, max(0.0, exponent)), _DIGITS)


def mix_cuts(sized: DataFrame, target_entropy: float, max_repetition: float, block_docs: int) -> DataFrame:
    """One row per source: its weight, blocks, whole passes, and where its last pass ends."""
    totals = stored(sized.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    exponent = find_exponent(totals, target_entropy, max_repetition)
    top = totals.agg(F.max("tokens").alias("t")).first()["t"] or 1
    x = F.col("tokens") / F.lit(float(top))
    norm = totals.where("tokens > 0").agg(F.sum(F.pow(x, F.lit(exponent))).alias("s")).first()["s"] or 1.0
    plan = totals.select(
        "source_key",
        "tokens",
        F.ceil(F.col("docs") / F.lit(block_docs)).cast("long").alias("blocks"),
        F.when(F.col("tokens") > 0, F.round(F.pow(x, F.lit(exponent)) / F.lit(norm), _DIGITS)).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, F.round(F.pow(x, F.lit(exponent - 1.0)), _DIGITS)).otherwise(1.0).alias("repetition"),
    )
    plan = plan.withColumn("passes", F.floor("repetition").cast("int")).withColumn(
        "rest", F.floor((F.col("repetition") - F.col("passes")) * F.col("tokens")).cast("long")
    )
    # Only sources with a last, partial pass need its end. Blocks first, then the documents of one block.
    placed = place(sized.join(plan.where("rest > 0").select("source_key", "blocks", "rest"), "source_key"))
    by_block = placed.groupBy("source_key", "block_place", "rest").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("source_key").orderBy("block_place")
    ends = (
        by_block.withColumn("upto", F.sum("n").over(order))
        .where("upto > rest")
        .groupBy("source_key")
        .agg(F.min_by(F.struct("block_place", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")), "block_place").alias("e"))
        .select("source_key", F.col("e.block_place").alias("end_block"), F.col("e.left").alias("left"))
    )
    inside = placed.withColumnRenamed("block_place", "end_block").join(ends, ["source_key", "end_block"])
    peers = Window.partitionBy("source_key").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.sum("n_tokens").over(peers)).where("upto <= left").groupBy("source_key").agg(F.max("place").alias("end_place"))
    return (
        plan.join(ends.drop("left"), "source_key", "left")
        .join(last, "source_key", "left")
        .select("source_key", "weight", "repetition", "blocks", "passes", "end_block", "end_place")
    )


def place(frame: DataFrame) -> DataFrame:
    """Adds ``block`` and ``block_place``, the block's place in its source's permutation."""
    number = F.conv(F.substring("place", 1, 12), 16, 10).cast("long")
    return frame.withColumn("block", number % F.col("blocks")).withColumn(
        "block_place", _hash(F.col("source_key"), F.col("block").cast("string"))
    )


def _copies() -> Column:
    taken = (F.col("block_place") < F.col("end_block")) | (
        (F.col("block_place") == F.col("end_block")) & (F.col("place") <= F.col("end_place"))
    )
    return F.col("passes") + F.coalesce(taken, F.lit(False)).cast("int")


def mix_plan(
    docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """One row per document: ``doc_id, source, n_tokens, weight, repetition, block, copies``."""
    sized = stored(count_tokens(docs), "mix-sized")
    cuts = stored(mix_cuts(sized, target_entropy, max_repetition, block_docs), "mix-cuts")
    return place(sized.join(cuts, "source_key")).select(
        "doc_id",
        F.when(F.col("source_key") != "null", F.substring("source_key", 2, 1 << 30)).alias("source"),
        "n_tokens",
        "weight",
        "repetition",
        "block",
        _copies().alias("copies"),
    )


def mix(
    docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """The mixture itself: every document as often as its source's budget says, with all its columns."""
    sized = stored(count_tokens(docs), "mix-sized")
    cuts = stored(mix_cuts(sized, target_entropy, max_repetition, block_docs), "mix-cuts")
    names = {name: f"__in{i}" for i, name in enumerate(docs.columns)}
    keyed = docs.select(
        *[F.col(f"`{name}`").alias(alias) for name, alias in names.items()],
        _source().alias("source_key"),
        _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("place"),
    )
    placed = place(keyed.join(cuts, "source_key"))
    repeated = placed.withColumn("__pass", F.explode(F.sequence(F.lit(1), _copies())))
    return repeated.select(*[F.col(alias).alias(name) for name, alias in names.items()])
