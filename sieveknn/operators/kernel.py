"""The part of a search that runs inside one task: score Arrow batches, keep the k best per query.

Spark decides what each task reads; a task holds one batch plus ``queries * k`` running results,
never a partition, and emits at most k rows per query.  Distances order first, ids break ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.vectors import STEPS_PER_UNIT

# Queries scored against one batch at a time; bounds the score matrix, not the result.
QUERY_BLOCK = 256
# Rows of results handed back to Spark at a time.
ROWS_OUT = 65_536

# Splits a batch into (row positions or None for all, query positions).
Split = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray | None, np.ndarray]]]


def own_type(column: pa.Array):
    """Vectors are scored in the precision they are stored in."""
    return np.float64 if column.type.value_type == pa.float64() else np.float32


def list_column_to_matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    # every row is checked: a short and a long row could make up for each other in the total
    if len(column) and pc.min_max(pc.list_value_length(column)).as_py() != {"min": width, "max": width}:
        raise ValueError(f"every vector must have {width} elements")
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(len(column), width).astype(dtype, copy=False)


def settle(distances: np.ndarray) -> np.ndarray:
    """The same settling of rounding noise as the column functions apply."""
    return np.rint(distances * STEPS_PER_UNIT) / STEPS_PER_UNIT


class Nearest:
    """Running k best ``(distance, id)`` of every query."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.distances = [np.empty(0) for _ in range(n_queries)]
        self.ids = [np.empty(0, dtype=np.int64) for _ in range(n_queries)]
        self.worst = np.full(n_queries, np.inf)

    def offer(self, query: int, distances: np.ndarray, ids: np.ndarray) -> None:
        all_distances = np.concatenate([self.distances[query], distances])
        all_ids = np.concatenate([self.ids[query], ids])
        best = np.lexsort((all_ids, all_distances))[: self.k]
        self.distances[query], self.ids[query] = all_distances[best], all_ids[best]
        if len(best) == self.k:
            last = self.distances[query][-1]
            self.worst[query] = np.inf if np.isnan(last) else last

    def offer_near(self, query: int, distances: np.ndarray, ids: np.ndarray) -> None:
        """Offer only what can still enter the k best."""
        near = np.flatnonzero(~(distances > self.worst[query]))
        if len(near) > self.k:
            kth = np.partition(distances[near], self.k - 1)[self.k - 1]
            near = near[~(distances[near] > kth)]
        if len(near):
            self.offer(query, distances[near], ids[near])

    def batches(self, qids: pa.Array) -> Iterator[pa.RecordBatch]:
        counts = np.array([len(d) for d in self.distances], dtype=np.int64)
        if not counts.sum():
            return
        query = np.repeat(np.arange(len(counts)), counts)
        distances, ids = np.concatenate(self.distances), np.concatenate(self.ids)
        for start in range(0, len(query), ROWS_OUT):
            part = slice(start, start + ROWS_OUT)
            yield pa.RecordBatch.from_arrays(
                [qids.take(pa.array(query[part])), pa.array(ids[part]), pa.array(distances[part])],
                names=["qid", "id", "dist"],
            )


def everything(n_queries: int) -> Split:
    """Every row meets every query."""
    queries = np.arange(n_queries)

    def split(batch: pa.RecordBatch):
        yield None, queries

    return split


def by_value(column: str, members: dict[int, np.ndarray]) -> Split:
    """A row meets the queries listed for its value of ``column`` (e.g. the lists a query probes)."""

    def split(batch: pa.RecordBatch):
        values = batch.column(column).to_numpy(zero_copy_only=False)
        for value in np.unique(values):
            queries = members.get(int(value))
            if queries is not None and len(queries):
                yield np.flatnonzero(values == value), queries

    return split


def by_flag(columns: dict[str, np.ndarray]) -> Split:
    """A row meets the queries of every boolean column that is true for it."""

    def split(batch: pa.RecordBatch):
        for column, queries in columns.items():
            flags = batch.column(column).to_numpy(zero_copy_only=False).astype(bool)
            if flags.any():
                yield np.flatnonzero(flags), queries

    return split


def by_value_and_flag(column: str, members: dict[int, np.ndarray], flags: dict[str, np.ndarray]) -> Split:
    """Both: a row meets the queries listed for its value that also use a flag which is true for it."""
    both = {
        value: {flag: np.intersect1d(queries, using, assume_unique=True) for flag, using in flags.items()} for value, queries in members.items()
    }

    def split(batch: pa.RecordBatch):
        values = batch.column(column).to_numpy(zero_copy_only=False)
        marked = {flag: batch.column(flag).to_numpy(zero_copy_only=False).astype(bool) for flag in flags}
        for value in np.unique(values):
            for flag, queries in both.get(int(value), {}).items():
                rows = np.flatnonzero((values == value) & marked[flag])
                if len(rows) and len(queries):
                    yield rows, queries

    return split


def scan_vectors(queries: np.ndarray, qids: pa.Array, k: int, split: Split):
    """A ``mapInArrow`` function: k nearest by cosine distance per query among a task's vectors.

    A float32 matrix product screens each batch; rows that could still enter a query's k best, with
    the product's rounding error allowed for, are scored again in double precision.  That second
    sum runs row by row in a fixed order and is settled, so equal vectors always get equal distances.
    """
    n_queries, width = queries.shape
    lengths = np.sqrt(np.einsum("qd,qd->q", queries, queries))
    unit_queries = queries / np.where(lengths == 0, 1.0, lengths)[:, None]
    coarse_queries = unit_queries.astype(np.float32)
    slack = (width + 8) * 2.4e-7

    def exact_distances(vectors: np.ndarray, query: int) -> np.ndarray:
        rows = vectors.astype(np.float64)
        norms = np.sqrt(np.einsum("nd,nd->n", rows, rows))
        norms[norms == 0] = 1.0
        return settle(1.0 - np.einsum("nd,d->n", rows, unit_queries[query]) / norms)

    def screen_and_offer(best: Nearest, vectors: np.ndarray, ids: np.ndarray, members: np.ndarray) -> None:
        norms = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
        # zero, tiny, huge and broken vectors, whose float32 norm says nothing, skip the screening
        odd = ~((norms > 1e-15) & (norms < 1e15))
        if odd.any():
            for query in members:
                best.offer_near(int(query), exact_distances(vectors[odd], query), ids[odd])
            vectors, norms, ids = vectors[~odd], norms[~odd], ids[~odd]
            if not len(ids):
                return
        for start in range(0, len(members), QUERY_BLOCK):
            block = members[start : start + QUERY_BLOCK]
            coarse = vectors @ coarse_queries[block].T
            coarse /= norms[:, None]
            floor = 1.0 - best.worst[block] - slack
            for column in np.flatnonzero(coarse.max(axis=0) >= floor):
                scores = coarse[:, column]
                rows = np.flatnonzero(scores >= floor[column])
                if len(rows) > best.k:
                    kept = scores[rows]
                    kth = np.partition(kept, len(kept) - best.k)[len(kept) - best.k]
                    rows = rows[kept >= kth - slack]
                query = int(block[column])
                best.offer_near(query, exact_distances(vectors[rows], query), ids[rows])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(n_queries, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            all_ids = batch.column("id").to_numpy(zero_copy_only=False)
            column = batch.column("embedding")
            matrix = list_column_to_matrix(column, width, own_type(column))
            for rows, members in split(batch):
                if rows is None or len(rows) == batch.num_rows:
                    screen_and_offer(best, matrix, all_ids, members)
                else:
                    screen_and_offer(best, matrix[rows], all_ids[rows], members)
        yield from best.batches(qids)

    return scan


Bases = dict[int, tuple[np.ndarray, np.ndarray]]


def code_distances(tables: np.ndarray, bases: Bases, split: Split):
    """A function that gives ``(query, distances, ids)`` for the rows of a batch of product codes and the queries they meet.

    ``tables[q, m, code]`` is the inner product of a query's m-th part with a codeword, and
    ``bases[cluster]`` the queries that read a list, in order, with their inner products with its centroid;
    their sum approximates the cosine.  ``split`` must divide the rows by ``cluster_id``.
    """
    _, parts, _ = tables.shape
    positions = np.arange(parts)

    def distances(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        all_ids = batch.column("id").to_numpy(zero_copy_only=False)
        codes = list_column_to_matrix(batch.column("code"), parts, np.int64)
        clusters = batch.column("cluster_id").to_numpy(zero_copy_only=False)
        for rows, members in split(batch):
            ids, row_codes = all_ids[rows], codes[rows]
            readers, products = bases[int(clusters[rows[0]])]
            for query, base in zip(members, products[np.searchsorted(readers, members)], strict=True):
                similarity = base + tables[query][positions, row_codes].sum(axis=1)
                yield int(query), settle(1.0 - similarity.astype(np.float64)), ids

    return distances


def scan_codes(tables: np.ndarray, bases: Bases, qids: pa.Array, k: int, split: Split):
    """A ``mapInArrow`` function: k nearest per query by looked-up distances of product codes."""
    distances = code_distances(tables, bases, split)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(len(tables), k)
        for batch in batches:
            if batch.num_rows:
                for query, found, ids in distances(batch):
                    best.offer_near(query, found, ids)
        yield from best.batches(qids)

    return scan


def score_rows(queries: np.ndarray, squared_l2: bool = False):
    """A ``mapInArrow`` function: the distances of each vector to all queries, ``(id, dists)``.

    For joins and sorts that would otherwise move the vectors themselves.  ``squared_l2`` gives the
    squared Euclidean distance of the normalised vectors in place of the cosine distance.
    """
    width = queries.shape[1]
    lengths = np.sqrt(np.einsum("qd,qd->q", queries, queries))
    unit_queries = queries / np.where(lengths == 0, 1.0, lengths)[:, None]

    def distances_to(vectors: np.ndarray, norms: np.ndarray, query: int) -> np.ndarray:
        cosines = np.einsum("nd,d->n", vectors, unit_queries[query]) / np.where(norms == 0, 1.0, norms)
        if squared_l2:
            # |u - q|^2 = |u|^2 + |q|^2 - 2 u.q, where a length is 1, or 0 for a zero vector
            return settle(np.sign(norms) + np.sign(lengths[query]) - 2.0 * cosines)
        return settle(1.0 - cosines)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = list_column_to_matrix(batch.column("embedding"), width, np.float64)
            norms = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
            distances = np.stack([distances_to(vectors, norms, q) for q in range(len(queries))], axis=1)
            starts = np.arange(len(vectors) + 1, dtype=np.int32) * len(queries)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(distances.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "dists"])

    return scan


def scan_scores(n_queries: int, qids: pa.Array, k: int, split: Split):
    """A ``mapInArrow`` function: k nearest per query from rows of ``score_rows``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(n_queries, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            all_ids = batch.column("id").to_numpy(zero_copy_only=False)
            all_distances = list_column_to_matrix(batch.column("dists"), n_queries, np.float64)
            for rows, members in split(batch):
                ids = all_ids if rows is None else all_ids[rows]
                for query in members:
                    distances = all_distances[:, query] if rows is None else all_distances[rows, query]
                    best.offer_near(int(query), distances, ids)
        yield from best.batches(qids)

    return scan


Marks = list[tuple[np.ndarray, np.ndarray]]


class Tally:
    """How many rows come before each mark of each query.

    ``marks[q]`` are a query's ``(distances, ids)`` in order; a row comes before a mark if its
    distance is smaller, or equal with a smaller id.
    """

    def __init__(self, marks: Marks):
        self.marks = marks
        # landed[q][j]: rows that come before mark j but not before mark j - 1
        self.landed = [np.zeros(len(distances) + 1, dtype=np.int64) for distances, _ in marks]

    def add(self, query: int, passed: np.ndarray) -> None:
        """``passed``: for each row the number of marks that it does not come before."""
        self.landed[query] += np.bincount(passed, minlength=len(self.landed[query]))

    def passed(self, query: int, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        distances, mark_ids = self.marks[query]
        low, high = np.searchsorted(distances, own), np.searchsorted(distances, own, side="right")
        # among the marks at its own distance, a row comes before those with a larger id
        for row in np.flatnonzero(low < high):
            low[row] += np.searchsorted(mark_ids[low[row] : high[row]], ids[row], side="right")
        return low

    def batches(self, qids: pa.Array) -> Iterator[pa.RecordBatch]:
        for query, counts in enumerate(self.landed):
            places = len(counts) - 1
            if places:
                yield pa.RecordBatch.from_arrays(
                    [
                        qids.take(pa.array(np.full(places, query))),
                        pa.array(np.arange(places, dtype=np.int32)),
                        pa.array(np.cumsum(counts)[:-1]),
                    ],
                    names=["qid", "mark", "n"],
                )


def count_closer(queries: np.ndarray, qids: pa.Array, marks: Marks, split: Split | None = None):
    """A ``mapInArrow`` function: how many rows come before each mark, ``(qid, mark, n)``.

    Float32 products settle the rows that are clearly between two marks, the others are scored exactly.
    """
    n_queries, width = queries.shape
    split = everything(n_queries) if split is None else split
    lengths = np.sqrt(np.einsum("qd,qd->q", queries, queries))
    unit_queries = queries / np.where(lengths == 0, 1.0, lengths)[:, None]
    coarse_queries = unit_queries.astype(np.float32)
    slack = (width + 8) * 2.4e-7

    def exact_distances(vectors: np.ndarray, query: int) -> np.ndarray:
        rows = vectors.astype(np.float64)
        norms = np.sqrt(np.einsum("nd,nd->n", rows, rows))
        norms[norms == 0] = 1.0
        return settle(1.0 - np.einsum("nd,d->n", rows, unit_queries[query]) / norms)

    def count(tally: Tally, vectors: np.ndarray, ids: np.ndarray, members: np.ndarray) -> None:
        norms = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
        odd = ~((norms > 1e-15) & (norms < 1e15))
        norms[odd] = 1.0
        for start in range(0, len(members), QUERY_BLOCK):
            block = members[start : start + QUERY_BLOCK]
            coarse = vectors @ coarse_queries[block].T / norms[:, None]
            for column, query in enumerate(block.tolist()):
                distances = tally.marks[query][0]
                own = 1.0 - coarse[:, column].astype(np.float64)
                passed = np.searchsorted(distances, own - slack)
                unclear = np.flatnonzero((passed != np.searchsorted(distances, own + slack)) | odd)
                if len(unclear):
                    passed[unclear] = tally.passed(query, exact_distances(vectors[unclear], query), ids[unclear])
                tally.add(query, passed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(marks)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            column = batch.column("embedding")
            vectors = list_column_to_matrix(column, width, own_type(column))
            for rows, members in split(batch):
                if rows is None:
                    count(tally, vectors, ids, members)
                else:
                    count(tally, vectors[rows], ids[rows], members)
        yield from tally.batches(qids)

    return scan


def count_closer_codes(tables: np.ndarray, bases: Bases, qids: pa.Array, marks: Marks, split: Split):
    """The same among product codes, by looked-up distances."""
    distances = code_distances(tables, bases, split)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(marks)
        for batch in batches:
            if batch.num_rows:
                for query, found, ids in distances(batch):
                    tally.add(query, tally.passed(query, found, ids))
        yield from tally.batches(qids)

    return scan
