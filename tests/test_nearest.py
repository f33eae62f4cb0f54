import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveknn import fixtures as fx
from sieveknn.operators import nearest, topk
from sieveknn.operators.nearest import knn, knn_batch, query_passes, rank_all
from sieveknn.operators.topk import merge_groups, top_k


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(partitions)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def emb(spark, sf_dir):
    return fx.embeddings(spark, sf_dir).repartition(5).cache()


@pytest.fixture(scope="module")
def queries(emb):
    return emb.filter("id < 7").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec")).cache()


@pytest.mark.parametrize("use_kernel", [True, False])
def test_ties_go_to_the_lowest_id(spark, use_kernel):
    df = frame(spark, [(9, [1.0, 0.0]), (3, [2.0, 0.0]), (5, [1.0, 0.0]), (1, [0.0, 1.0]), (7, [0.0, 0.0]), (8, None)])
    hits = knn(df, [3.0, 0.0], 4, use_kernel=use_kernel).collect()
    assert [(r.id, r.dist) for r in hits] == [(3, 0.0), (5, 0.0), (9, 0.0), (1, 1.0)]


@pytest.mark.parametrize("use_kernel", [True, False])
def test_k_beyond_the_table(spark, use_kernel):
    df = frame(spark, [(i, [1.0, float(i)]) for i in range(6)])
    assert [r.id for r in knn(df, [1.0, 0.0], 50, use_kernel=use_kernel).collect()] == list(range(6))
    with pytest.raises(ValueError):
        knn(df, [1.0, 0.0], 0)


def test_zero_query(spark):
    df = frame(spark, [(i, [1.0, float(i)]) for i in range(6)])
    for use_kernel in (True, False):
        hits = knn(df, [0.0, 0.0], 2, use_kernel=use_kernel).collect()
        assert [(r.id, r.dist) for r in hits] == [(0, 1.0), (1, 1.0)]


def test_both_ways_agree(emb, queries):
    for row in queries.limit(2).collect():
        jvm = [(r.id, r.dist) for r in knn(emb, row.qvec, 40, use_kernel=False).collect()]
        kernel = [(r.id, r.dist) for r in knn(emb, row.qvec, 40, use_kernel=True).collect()]
        batch = knn_batch(emb, queries.filter(F.col("qid") == row.qid), 40).orderBy("rank").collect()
        assert jvm == kernel == [(r.id, r.dist) for r in batch]


def test_batch_equals_single_queries(emb, queries):
    hits = knn_batch(emb, queries, 5).collect()
    for row in queries.collect():
        mine = sorted((r.rank, r.id, r.dist) for r in hits if r.qid == row.qid)
        single = [(n + 1, r.id, r.dist) for n, r in enumerate(knn(emb, row.qvec, 5).collect())]
        assert mine == single


def test_more_queries_than_fit_one_pass(emb, queries, monkeypatch):
    want = sorted(knn_batch(emb, queries, 3).collect())
    monkeypatch.setattr(nearest, "QUERY_BYTES_PER_PASS", 64 * 8 * 2)  # two queries of 64 numbers
    assert [len(b) for b in query_passes(queries, 3)] == [2, 2, 2, 1]
    assert sorted(knn_batch(emb, queries, 3).collect()) == want
    monkeypatch.setattr(nearest, "QUERIES_PER_FETCH", 3)  # stored and fetched slice by slice
    assert sorted(knn_batch(emb, queries, 3).collect()) == want
    monkeypatch.setattr(nearest, "RESULT_BYTES_PER_PASS", 1)
    assert sorted(knn_batch(emb, queries, 3).collect()) == want


def test_a_pass_holds_a_small_part_of_a_task():
    """The vectors stand in a task as they came, as unit vectors and in single precision, beside the running results."""
    queries = nearest._pass_limit(64, 5, 0)
    assert queries >= 20_000 and queries * (3 * 64 * 8 + 2 * 200) < 100e6


def test_text_query_ids_and_no_queries(emb, queries):
    named = queries.select(F.concat(F.lit("q"), F.col("qid")).alias("qid"), "qvec")
    hits = knn_batch(emb, named, 1).collect()
    assert sorted((r.qid, r.id) for r in hits) == [(f"q{i}", i) for i in range(7)]
    nothing = knn_batch(emb, named.limit(0), 1)
    assert nothing.collect() == [] and nothing.columns == ["qid", "rank", "id", "dist"]
    with pytest.raises(ValueError, match="no vector"):
        knn_batch(emb, named.withColumn("qvec", F.lit(None).cast("array<double>")), 1)


def test_vectors_of_another_width_fail(emb, queries):
    with pytest.raises(Exception, match="must have 3 elements"):
        knn_batch(emb, queries.withColumn("qvec", F.slice("qvec", 1, 3)), 1).collect()


def test_merging_in_groups_changes_nothing(spark):
    scored = spark.range(0, 5000, 1, 16).select(
        (F.col("id") % 3).alias("qid"), "id", F.lit(0.5).alias("dist")  # everything ties
    )
    assert sorted(top_k(scored, 7, groups=4).collect()) == sorted(top_k(scored, 7, groups=1).collect())
    assert [r.id for r in top_k(scored, 3, groups=5).filter("qid = 0").orderBy("rank").collect()] == [0, 3, 6]


def test_large_k_is_numbered_in_ranges(spark, emb, queries, monkeypatch):
    scored = spark.range(0, 5000, 1, 16).select((F.col("id") % 3).alias("qid"), "id", (F.col("id") % 7 / 10).alias("dist"))
    few, all_rows = sorted(top_k(scored, 700).collect()), sorted(top_k(scored, 9000).collect())
    whole = sorted(knn_batch(emb, queries, 501).collect())
    monkeypatch.setattr(topk, "MAX_NUMBERED", 100)
    ranges = top_k(scored, 9000)
    assert "WindowGroupLimit" not in plan(ranges) and ranges.dtypes == top_k(scored, 7).dtypes
    assert sorted(ranges.collect()) == all_rows and sorted(top_k(scored, 700).collect()) == few
    assert sorted(knn_batch(emb, queries, 501).collect()) == whole and len(whole) == 7 * 500


def test_merge_groups_follow_the_shuffle_width(spark, emb):
    assert merge_groups(emb) == 1
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        assert merge_groups(emb) == 44
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_plans(spark, sf_dir, queries):
    emb = fx.embeddings(spark, sf_dir)
    single = plan(knn(emb, [1.0] * 64, 10, use_kernel=False))
    assert "TakeOrderedAndProject" in single and "Exchange" not in single
    assert "from_json" not in single  # the query is a constant
    batch = plan(knn_batch(emb, queries, 10))
    assert "WindowGroupLimit" in batch and "MapInArrow" in batch
    assert "CartesianProduct" not in batch and "NestedLoop" not in batch


def test_rank_all(spark):
    # a third of the rows are copies of one vector
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [1.0, float(i)]) for i in range(600)]
    df = frame(spark, rows, 6)
    captions = spark.createDataFrame([(i, f"c{i}") for i in range(600)], "id long, caption string")
    ranked = rank_all(df, [2.0, 0.0], captions, partitions=5).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 601))
    assert [(r.dist, r.id) for r in ranked] == sorted((r.dist, r.id) for r in ranked)
    assert [r.id for r in ranked[:200]] == list(range(0, 600, 3))
    assert all(r.caption == f"c{r.id}" for r in ranked)
    zero = rank_all(frame(spark, [(1, [0.0, 0.0]), (2, [0.0, 2.0])]), [1.0, 0.0]).orderBy("rank").collect()
    assert [(r.id, r.dist) for r in zero] == [(1, 1.0), (2, 2.0)]
    assert np.isclose(ranked[-1].dist, 2 - 2 * (1 / np.hypot(1, 599 if 599 % 3 else 598)))


def test_rank_all_spreads_equal_distances(spark):
    df = frame(spark, [(i, [1.0, 0.0]) for i in range(400)], 4)
    ranked = rank_all(df, [1.0, 0.0], partitions=4)
    assert [r.id for r in ranked.orderBy("rank").collect()] == list(range(400))
