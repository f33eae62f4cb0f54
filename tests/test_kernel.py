"""The in-task kernel against brute force, without Spark."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveknn.operators.kernel import (
    by_flag,
    by_value,
    count_closer,
    everything,
    scan_codes,
    scan_scores,
    scan_vectors,
    score_rows,
    settle,
)


def lists(matrix, kind):
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.astype(kind).ravel()))


def batches(matrix, size, **columns):
    ids = np.arange(len(matrix))
    for start in range(0, len(matrix), size):
        part = slice(start, start + size)
        arrays = [pa.array(ids[part]), lists(matrix[part], np.float32)]
        arrays += [pa.array(column[part]) for column in columns.values()]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "embedding", *columns])


def brute(matrix, queries, k, allowed=None):
    hits = set()
    for number, query in enumerate(queries):
        q = query / (np.linalg.norm(query) or 1)
        norms = np.array([np.linalg.norm(v) or 1 for v in matrix])
        distances = settle(1 - (matrix * q).sum(axis=1) / norms)
        order = [i for i in np.lexsort((np.arange(len(matrix)), distances)) if allowed is None or allowed(number, i)]
        hits |= {(number, int(i), float(distances[i])) for i in order[:k]}
    return hits


def collect(results):
    rows = set()
    for batch in results:
        rows |= set(zip(*(column.to_pylist() for column in batch.columns), strict=True))
    return rows


def same(got, want):
    assert {(q, i) for q, i, _ in got} == {(q, i) for q, i, _ in want}
    distance = {(q, i): d for q, i, d in want}
    assert all(abs(distance[q, i] - d) < 1e-11 for q, i, d in got)


# few distinct small integers: plenty of equal vectors, zero vectors and tied distances
vectors = st.integers(1, 60).flatmap(
    lambda n: st.lists(st.lists(st.integers(-2, 2), min_size=3, max_size=3), min_size=n, max_size=n)
)


@settings(max_examples=80, deadline=None)
@given(vectors, st.integers(1, 9), st.integers(1, 17), st.integers(1, 4))
def test_vectors_match_brute_force(rows, k, batch_size, n_queries):
    matrix = np.array(rows, dtype=np.float64)
    queries = np.array([[1, 2, -1], [0, 1, 0], [2, 2, 1], [-1, 0, 1]], dtype=np.float64)[:n_queries]
    scan = scan_vectors(queries, pa.array(range(n_queries)), k, everything(n_queries))
    same(collect(scan(batches(matrix, batch_size))), brute(matrix, queries, k))


@settings(max_examples=40, deadline=None)
@given(vectors, st.integers(1, 5), st.integers(1, 17))
def test_rows_meet_only_their_queries(rows, k, batch_size):
    matrix = np.array(rows, dtype=np.float64)
    queries = np.array([[1, 2, -1], [0, 1, 0], [2, 2, 1]], dtype=np.float64)
    qids = pa.array([0, 1, 2])
    cluster = np.arange(len(matrix)) % 4
    members = {0: np.array([0, 1]), 1: np.array([2]), 2: np.array([0, 2])}
    scan = scan_vectors(queries, qids, k, by_value("cluster", members))
    got = collect(scan(batches(matrix, batch_size, cluster=cluster)))
    same(got, brute(matrix, queries, k, lambda q, i: q in members.get(i % 4, ())))

    even, third = np.arange(len(matrix)) % 2 == 0, np.arange(len(matrix)) % 3 == 0
    flags = {"even": np.array([0, 2]), "third": np.array([1])}
    allowed = lambda q, i: i % 3 == 0 if q == 1 else i % 2 == 0
    scan = scan_vectors(queries, qids, k, by_flag(flags))
    same(collect(scan(batches(matrix, batch_size, even=even, third=third))), brute(matrix, queries, k, allowed))


@settings(max_examples=40, deadline=None)
@given(vectors, st.integers(1, 5))
def test_scores_first_gives_the_same(rows, k):
    matrix = np.array(rows, dtype=np.float64)
    queries = np.array([[1, 2, -1], [0, 1, 0]], dtype=np.float64)
    scored = score_rows(queries)(batches(matrix, 7))
    got = collect(scan_scores(2, pa.array([0, 1]), k, everything(2))(scored))
    same(got, brute(matrix, queries, k))


@settings(max_examples=80, deadline=None)
@given(vectors, st.integers(1, 6), st.integers(1, 17))
def test_counting_finds_the_rank(rows, step, batch_size):
    matrix = np.array(rows, dtype=np.float64)
    queries = np.array([[1, 2, -1], [0, 1, 0]], dtype=np.float64)
    marks, want = [], set()
    for number in range(2):
        order = sorted((d, i) for q, i, d in brute(matrix, queries, len(matrix)) if q == number)
        chosen = list(range(0, len(order), step))
        marks.append((np.array([order[c][0] for c in chosen]), np.array([order[c][1] for c in chosen])))
        want |= {(number, place, rank) for place, rank in enumerate(chosen)}
    scan = count_closer(queries, pa.array([0, 1]), marks)
    got = [row for batch in scan(batches(matrix, batch_size)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert set(got) == want and len(got) == len(want)


def test_many_equal_vectors_keep_the_lowest_ids():
    matrix = np.tile(np.array([[0.3, -0.7, 0.1, 0.9]]), (5000, 1))
    scan = scan_vectors(matrix[:1], pa.array([7]), 4, everything(1))
    assert sorted(i for _, i, _ in collect(scan(batches(matrix, 999)))) == [0, 1, 2, 3]


def test_large_wide_data():
    rng = np.random.default_rng(1)
    matrix, queries = rng.standard_normal((3000, 96)), rng.standard_normal((300, 96))
    scan = scan_vectors(queries, pa.array(range(300)), 12, everything(300))
    same(collect(scan(batches(matrix.astype(np.float32).astype(np.float64), 700))),
         brute(matrix.astype(np.float32).astype(np.float64), queries, 12))


def test_broken_vectors_come_last():
    matrix = np.array([[np.nan, 0.0], [np.nan, 1.0], [0.0, 1.0], [1.0, 0.0]])
    scan = scan_vectors(np.array([[1.0, 0.0]]), pa.array([0]), 2, everything(1))
    assert {i for _, i, _ in collect(scan(batches(matrix, 2)))} == {2, 3}


def test_extreme_lengths():
    matrix = np.array([[1e25, 0.0], [1e-25, 1e-25], [0.0, 0.0], [0.0, 3.0], [1.0, 0.1]])
    scan = scan_vectors(np.array([[2.0, 0.0]]), pa.array([0]), 3, everything(1))
    got = sorted((round(d, 6), i) for _, i, d in collect(scan(batches(matrix, 2))))
    assert [i for _, i in got] == [0, 4, 1]


def test_squared_l2():
    matrix = np.array([[3.0, 4.0], [0.0, 0.0], [-2.0, 0.0]])
    (batch,) = score_rows(np.array([[5.0, 0.0]]), squared_l2=True)(batches(matrix, 5))
    assert batch.column("dists").to_pylist() == [[0.8], [1.0], [4.0]]


def test_codes_are_looked_up():
    tables = np.array([[[0.1, 0.2], [0.0, 0.5]]], dtype=np.float32)  # one query, two parts, two codewords
    batch = pa.RecordBatch.from_arrays(
        [pa.array([5, 6, 7]), pa.array([3, 3, 4], pa.int32()), lists(np.array([[0, 1], [1, 0], [1, 1]]), np.int16)],
        names=["id", "cluster_id", "code"],
    )
    members = {3: np.array([0])}
    scan = scan_codes(tables, {3: (np.array([0]), np.array([0.25]))}, pa.array([0]), 5, by_value("cluster_id", members))
    got = {i: round(d, 6) for _, i, d in collect(scan([batch]))}
    assert got == {5: round(1 - 0.85, 6), 6: round(1 - 0.45, 6)}
