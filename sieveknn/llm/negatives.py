"""Hard negatives: rows of another label that score clearly below a positive, yet high.

Components are integers, ``floor(scale * x)``, and so are scores; they are computed exactly by float32 products in a
residue number system (``residues.py``). The number of primes follows from the longest vector (Cauchy-Schwarz).

Anchors are a stated query set. They are taken in blocks of bounded size; a block goes to every task, which scans its
rows in tiles twice: once for the best positives of each anchor, once for the best negatives in the window below each
positive. A task holds one tile of scores and its running best, and sends at most ``positives`` (``positives *
negatives``) rows for an anchor; Spark merges them. Nothing else moves, and no pair that cannot win leaves a task.

* A row without id, label or vector, or with a null or non-finite component, takes no part. Vectors shorter
  than the longest one count as ending in zeros; a zero or empty vector scores 0 with all.
* Rows that are equal in id, label and vector count once. Rows that share an id but differ are rows of their own; an
  anchor's other rows are all rows but itself. Equal scores come in the order of ids, then of a hash of label and vector.
* An anchor without positives, or a positive without negatives in its window, gives no rows; neither does an empty table.
  A positive score below zero has an empty window.
* Scores beyond 9e16, which windows could not be computed for, raise ValueError.
* Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveknn.llm.common import stored
from sieveknn.llm.residues import primes_for, product, split
from sieveknn.session import new_scratch_path, ship_package

POSITIVES = 5
NEGATIVES = 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
SCALE = 256
ANCHOR_BYTES = 64 * 1024 * 1024  # of an anchor block, with its running best, in every task
TILE = 1024  # rows and anchors whose scores are computed together
NONE = -(1 << 62)  # below every score


def components(rows: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, q, mark, anchor``: the rows that take part, equal ones once; ``mark`` tells rows of one id apart."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~broken)
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    ready = usable.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"), "anchor"
    ).withColumn("mark", F.xxhash64("label", "q"))
    ready = stored(ready, "components")
    # Vectors move only where an id is on several rows.
    several = stored(ready.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    if several.isEmpty():
        return ready
    again = ready.join(several, "vec_id", "left_semi").dropDuplicates(["vec_id", "label", "q"])
    return stored(ready.join(several, "vec_id", "left_anti").unionByName(again), "components")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = values[ends[0] : ends[-1]]
    return out


class Best:
    """The running best ``(score, id, mark)`` of each slot, in order."""

    def __init__(self, slots: int, k: int):
        self.score = np.full((slots, k), NONE, np.int64)
        self.id = np.zeros((slots, k), np.int64)
        self.mark = np.zeros((slots, k), np.int64)
        self.k = k

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> None:
        """``scores[i, j]`` of slot ``at[i]`` with row j, ``NONE`` where they don't meet; rows come by id and mark. Overwrites scores."""
        live = np.flatnonzero(scores.max(axis=1) >= np.maximum(self.score[at, -1], NONE + 1))
        if not len(live):
            return
        at, scores = at[live], scores[live]
        line = np.arange(len(at))
        found = [[self.score[at]], [self.id[at]], [self.mark[at]]]
        for _ in range(min(self.k, scores.shape[1])):
            j = scores.argmax(axis=1)  # of equal scores the first, that is the smallest id
            for column, values in zip(found, (scores[line, j], ids[j], marks[j]), strict=True):
                column.append(values[:, None])
            scores[line, j] = NONE
        score, number, mark = (np.concatenate(c, axis=1) for c in found)
        order = np.lexsort((mark, number, -score), axis=-1)[:, : self.k]
        for own, values in ((self.score, score), (self.id, number), (self.mark, mark)):
            own[at] = np.take_along_axis(values, order, axis=1)


def _tiles(batches: Iterator[pa.RecordBatch], width: int, primes: list[int]):
    for batch in batches:
        ids, marks, labels = (batch.column(c).to_numpy() for c in ("vec_id", "mark", "label"))
        order = np.lexsort((marks, ids))
        q = _matrix(batch.column("q"), width)
        for at in range(0, len(order), TILE):
            rows = order[at : at + TILE]
            yield ids[rows], marks[rows], labels[rows], split(q[rows], primes)


class AnchorBlock:
    """Anchors of one pass."""

    def __init__(self, table: pa.Table, width: int, primes: list[int]):
        self.id, self.mark, self.label = (table.column(c).to_numpy() for c in ("vec_id", "mark", "label"))
        self.parts = split(_matrix(table.column("q").combine_chunks(), width), primes)
        self.width, self.primes = width, primes

    def __len__(self) -> int:
        return len(self.id)

    def scored(self, batches: Iterator[pa.RecordBatch]):
        """(anchors, scores, ids, marks, same label) of every tile of anchors and rows; an anchor's own row has the score ``NONE``."""
        for ids, marks, labels, parts in _tiles(batches, self.width, self.primes):
            for at in range(0, len(self), TILE):
                own = np.arange(at, min(at + TILE, len(self)))
                scores = product(self.parts[:, own], parts, self.primes)
                scores[(self.id[own, None] == ids) & (self.mark[own, None] == marks)] = NONE
                yield own, scores, ids, marks, self.label[own, None] == labels


def _emit(best: Best, per_anchor: int):
    slot, place = np.nonzero(best.score > NONE)
    columns = [slot // per_anchor, slot % per_anchor, *(x[slot, place] for x in (best.score, best.id, best.mark))]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "slot", "score", "id", "mark"])


_PARTIAL = "anchor long, slot long, score long, id long, mark long"


def _find_positives(shared, k: int):
    def run(batches):
        block = shared.value
        best = Best(len(block), k)
        for own, scores, ids, marks, same in block.scored(batches):
            scores[~same] = NONE
            best.offer(own, scores, ids, marks)
        yield from _emit(best, 1)

    return run


def _find_negatives(shared, limits: np.ndarray, k: int):
    """``limits[anchor, slot]``: the least and the greatest score of the window below a positive."""
    slots = limits.shape[1]

    def run(batches):
        block = shared.value
        best = Best(len(block) * slots, k)
        for own, scores, ids, marks, same in block.scored(batches):
            scores[same] = NONE
            for slot in range(slots):
                low, high = limits[own, slot, 0, None], limits[own, slot, 1, None]
                best.offer(own * slots + slot, np.where((scores >= low) & (scores <= high), scores, NONE), ids, marks)
        yield from _emit(best, slots)

    return run


def _best(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "mark")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    scale: int = SCALE,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows (vec_id, label, embedding)``.

    ``anchor`` is the condition that makes a row an anchor. Its positives are the ``positives`` best other rows
    of its label; for each, the ``negatives`` best rows of other labels whose score is ``low_percent`` to
    ``high_percent`` of the positive's.
    """
    spark = rows.sparkSession
    ship_package(spark)
    ready = components(rows.select("vec_id", "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor")), scale)
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    seen = ready.agg(F.max(norm).alias("norm"), F.max(F.size("q")).alias("width"), F.count_if("anchor").alias("anchors")).first()
    width = seen.width or 0
    primes = primes_for(int((seen.norm or 0.0) * (1 + 1e-9)) + 1)
    weight = 8 * width + 4 * width * len(primes) + 24 * positives * (1 + negatives)
    blocks = -(-seen.anchors * weight // anchor_bytes)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = new_scratch_path(spark, "negatives")
    anchors = ready.where("anchor").drop("anchor")
    scan = ready.select("vec_id", "mark", "label", "q")
    result = spark.createDataFrame([], schema)
    for number in range(blocks):
        mine = anchors.where(F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)) == number)
        block = AnchorBlock(mine.toArrow(), width, primes)
        shared = spark.sparkContext.broadcast(block)
        near = _best(scan.mapInArrow(_find_positives(shared, positives), _PARTIAL), positives).toArrow()
        limits = np.tile(np.array([1, 0], np.int64), (len(block), positives, 1))
        at, place, score = (near.column(c).to_numpy() for c in ("anchor", "rank", "score"))
        limits[at, place - 1] = np.stack([-(-low_percent * score // 100), high_percent * score // 100], axis=1)
        found = _best(scan.mapInArrow(_find_negatives(shared, limits, negatives), _PARTIAL), negatives)
        # The positives of a block are bounded as the block is.
        pairs = pa.table({"anchor": at, "slot": (place - 1).astype(np.int64), "anchor_id": block.id[at], "positive_id": near.column("id"), "positive_score": score})
        part = found.join(F.broadcast(spark.createDataFrame(pairs)), ["anchor", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        if blocks == 1:
            return part
        part.write.mode("append").parquet(path)
        shared.unpersist()
        result = spark.read.schema(schema).parquet(path)
    return result
