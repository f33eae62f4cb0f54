"""One answer on every path: repeated ids, odd widths, stored precision, repeated queries."""

import numpy as np
import pytest

from sieveknn.functions import encode_workloads
from sieveknn.operators import idsets
from sieveknn.operators.ivf import train_sample
from sieveknn.operators.nearest import knn, knn_batch
from sieveknn.plans import hybrid
from sieveknn.sources import check_alignment

QUERY = [1.0, 0.25]


@pytest.fixture(scope="module")
def emb(spark):
    return spark.createDataFrame([(i, [1.0, i * 0.1]) for i in range(4)], "id long, embedding array<float>")


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([(0, 5), (0, 5), (1, 5), (2, 5), (3, 0)], "id long, width int")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, QUERY)], "qid long, qvec array<double>")


@pytest.mark.parametrize("limits", [{}, {"MAX_LISTED_IDS": 0}, {"MAX_LISTED_IDS": 0, "MAX_BROADCAST_BITMAPS": 0}])
def test_ids_that_the_metadata_repeats_match_once(emb, meta, queries, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(idsets if name == "MAX_BROADCAST_BITMAPS" else hybrid, name, value)
    found = [hybrid.search_prefilter(emb, meta, queries, "width = 5", 3), hybrid.search_postfilter(emb, meta, queries, "width = 5", 3)]
    workloads = queries.selectExpr("qid", "qvec", "'width = 5' as where_sql").unionAll(queries.selectExpr("qid + 1", "qvec", "'width < 9'"))
    for strategy in ("prefilter", "postfilter"):
        found.append(hybrid.run_workloads(emb, meta, workloads, 3, strategy).filter("qid = 1"))
    for hits in found:
        assert sorted(r.id for r in hits.collect()) == [0, 1, 2]


def test_attributes_beside_the_vectors(emb, queries):
    both = emb.selectExpr("*", "id * 2 as width")
    for search in (hybrid.search_prefilter, hybrid.search_postfilter, hybrid.search_hybrid):
        assert [r.id for r in search(both, None, queries, "width > 2", 2).orderBy("rank").collect()] == [3, 2]


@pytest.mark.parametrize("use_kernel", [None, True, False])
@pytest.mark.parametrize("lengths", [(2, 2, 3), (3, 1, 2), (1, 1, 1)])
def test_odd_widths_raise(spark, use_kernel, lengths):
    rows = spark.createDataFrame([(i, [1.0] * n) for i, n in enumerate(lengths)], "id long, embedding array<float>")
    with pytest.raises(Exception, match="must have 2 elements"):
        knn(rows, QUERY, 2, use_kernel=use_kernel).collect()


def test_doubles_are_scored_as_doubles(spark, queries):
    rows = spark.createDataFrame([(i, [1.0, 0.25 + i * 1e-9]) for i in range(1, 5)], "id long, embedding array<double>")
    one, two = (knn(rows, QUERY, 4, use_kernel=k).collect() for k in (True, False))
    assert one == two and [r.id for r in knn_batch(rows, queries, 4).orderBy("rank").collect()] == [r.id for r in one]


def test_queries_need_ids_of_their_own(spark, emb, queries):
    for bad in (queries.unionAll(queries), spark.createDataFrame([(None, QUERY)], "qid long, qvec array<double>")):
        with pytest.raises(ValueError, match="qid"):
            knn_batch(emb, bad, 2).collect()


def test_alignment_with_a_missing_first_vector(spark, meta):
    rows = spark.createDataFrame([(0, None), (1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<float>").coalesce(1)
    assert check_alignment(meta.filter("id < 3").dropDuplicates(["id"]), rows).first().n_bad_dim == 2


def test_training_takes_every_vector(spark, emb):
    rows = emb.unionAll(spark.createDataFrame([(9, None)], emb.schema))
    assert train_sample(rows).count() == 4 and train_sample(rows, 3).count() == 3


def test_workloads_of_images_and_texts(spark):
    def make():
        return lambda values: np.array([[len(v), 1.0] for v in values])

    images = spark.createDataFrame([("a", b"xyz"), ("b", b"")], "path string, content binary")
    rows = [(1, ["a", "b"], ["hello"], "true"), (2, None, ["hello", "hello"], "id > 3"), (3, ["a"], [], None)]
    workloads = spark.createDataFrame(rows, "qid long, images array<string>, texts array<string>, where_sql string")
    found = {r.qid: r for r in encode_workloads(workloads, images, make, make).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {1: unit(unit([3, 1]) + unit([0, 1]) + unit([5, 1])), 2: unit([5, 1]), 3: unit([3, 1])}
    for qid, vector in want.items():
        assert found[qid].qvec == pytest.approx(list(vector), abs=1e-6)
    assert found[2].where_sql == "id > 3"
    for bad in ([(1, ["none"], [], "true")], [(1, [], None, "true")]):
        with pytest.raises(Exception, match="no image none|no vectors"):
            encode_workloads(spark.createDataFrame(bad, workloads.schema), images, make, make).collect()
