import pytest
from pyspark.sql import functions as F

from sieveknn import fixtures as fx
from sieveknn.operators import filters, idsets
from sieveknn.operators.nearest import knn_batch
from sieveknn.plans import hybrid
from sieveknn.plans.index import VectorIndex, build_or_load
from sieveknn.sources import write_bucketed

K = 10


@pytest.fixture(scope="module")
def emb(spark, sf_dir):
    return fx.embeddings(spark, sf_dir).repartition(4).cache()


@pytest.fixture(scope="module")
def meta(spark, sf_dir):
    return fx.metadata(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def workloads(spark, sf_dir):
    return fx.workloads(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def queries(workloads):
    return workloads.select("qid", "qvec").cache()


@pytest.fixture(scope="module")
def truth(emb, meta, queries):
    """Pre-filter hits of every workload's own clause."""
    hits = []
    for qid, _, where in fx.WORKLOADS:
        hits += hybrid.search_prefilter(emb, meta, queries.filter(F.col("qid") == qid), where, K).collect()
    return sorted(hits)


@pytest.fixture(scope="module")
def indexes(spark, emb, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hybrid"))
    return {kind: build_or_load(spark, f"{folder}/{kind}", emb, kind, nlist=20, bits=4) for kind in ("Flat", "IVF", "IVFPQ")}


def one(queries, qid):
    return queries.filter(F.col("qid") == qid)


def test_fixture_counts(meta):
    total, counts = filters.count_matches(meta, [w for _, _, w in fx.WORKLOADS])
    assert (total, counts) == (500, [74, 202, 4, 413, 137])


def test_hits_are_well_formed(meta, truth):
    allowed = {qid: {r.id for r in filters.filter_where(meta, where).collect()} for qid, _, where in fx.WORKLOADS}
    for qid in allowed:
        mine = [r for r in truth if r.qid == qid]
        assert [r.rank for r in mine] == list(range(1, min(K, len(allowed[qid])) + 1))
        assert [(r.dist, r.id) for r in mine] == sorted((r.dist, r.id) for r in mine)
        assert {r.id for r in mine} <= allowed[qid]


@pytest.mark.parametrize("way", ["broadcast", "shuffled scores", "shuffled vectors", "own attributes"])
def test_every_way_of_joining_agrees(spark, sf_dir, emb, meta, queries, truth, monkeypatch, way):
    where = fx.WORKLOADS[3][2]
    both = queries.filter("qid in (4, 5)")
    want = sorted(hybrid.search_prefilter(emb, meta, both, where, K).collect())
    assert [r for r in want if r.qid == 4] == [r for r in truth if r.qid == 4]
    if way == "own attributes":
        items = fx.items(spark, sf_dir)
        got = hybrid.search_prefilter(items, None, both, where, K)
        single = hybrid.search_prefilter(items, None, one(queries, 4), where, K)
    else:
        monkeypatch.setattr(hybrid, "MAX_LISTED_IDS", 0)
        if way != "broadcast":
            monkeypatch.setattr(idsets, "MAX_BROADCAST_BITMAPS", 0)
        aside = way == "shuffled vectors"
        got = hybrid.search_prefilter(emb, meta, both, where, K, colocated=aside)
        single = hybrid.search_prefilter(emb, meta, one(queries, 4), where, K, colocated=aside)
    assert sorted(got.collect()) == want
    assert sorted(single.collect()) == [r for r in want if r.qid == 4]


def test_selective_filter_skips_buckets(spark, emb, meta, queries, truth):
    write_bucketed(emb, "hy_few", 64)
    try:
        hits = hybrid.search_prefilter(spark.table("hy_few"), meta, one(queries, 3), fx.WORKLOADS[2][2], K)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 4 out of 64" in plan or "SelectedBucketsCount: 3 out of 64" in plan
        assert sorted(hits.collect()) == [r for r in truth if r.qid == 3]
    finally:
        spark.sql("DROP TABLE hy_few")


def test_broad_filter_shuffles_scores_not_vectors(emb, meta, queries, monkeypatch):
    monkeypatch.setattr(hybrid, "MAX_LISTED_IDS", 0)
    monkeypatch.setattr(idsets, "MAX_BROADCAST_BITMAPS", 0)
    hits = hybrid.search_prefilter(emb, meta, queries, "license is null", K)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    below_first_join = plan.index("SortMergeJoin") if "SortMergeJoin" in plan else plan.index("HashJoin")
    assert plan.count("MapInArrow") == 2
    assert plan.index("MapInArrow") < below_first_join < plan.rindex("MapInArrow")


def test_bucketed_tables_need_no_shuffle_of_vectors(spark, emb, meta, queries, monkeypatch):
    monkeypatch.setattr(hybrid, "MAX_LISTED_IDS", 0)
    monkeypatch.setattr(idsets, "MAX_BROADCAST_BITMAPS", 0)
    write_bucketed(emb, "hy_emb", 4)
    write_bucketed(meta, "hy_meta", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored_emb, stored_meta = spark.table("hy_emb"), spark.table("hy_meta")
        hits = hybrid.search_prefilter(stored_emb, stored_meta, queries, "license is null", K, colocated=True)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(qid" in plan
        want = hybrid.search_prefilter(emb, meta, queries, "license is null", K)
        assert sorted(hits.collect()) == sorted(want.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE hy_emb")
        spark.sql("DROP TABLE hy_meta")


def test_postfilter_with_all_candidates_is_prefilter(emb, meta, queries, truth):
    for qid, _, where in fx.WORKLOADS:
        hits = hybrid.search_postfilter(emb, meta, one(queries, qid), where, K, oversample=50)
        assert sorted(hits.collect()) == [r for r in truth if r.qid == qid]


def test_postfilter_may_fall_short(emb, meta, queries, truth):
    hits = hybrid.search_postfilter(emb, meta, one(queries, 1), fx.WORKLOADS[0][2], K, oversample=2).collect()
    assert 0 < len(hits) < K
    assert {r.id for r in hits} <= {r.id for r in truth if r.qid == 1}


@pytest.mark.parametrize("oversample", [1, 4, 2000])
def test_many_candidates_are_counted_not_collected(emb, meta, queries, workloads, monkeypatch, oversample):
    where = fx.WORKLOADS[1][2]
    want = sorted(hybrid.search_postfilter(emb, meta, queries, where, K, oversample=oversample).collect())
    together = sorted(hybrid.run_workloads(emb, meta, workloads, K, "postfilter", oversample=oversample).collect())
    monkeypatch.setattr(idsets, "MAX_BROADCAST_BITMAPS", 0)
    assert sorted(hybrid.search_postfilter(emb, meta, queries, where, K, oversample=oversample).collect()) == want
    counted = hybrid.run_workloads(emb, meta, workloads, K, "postfilter", oversample=oversample)
    assert sorted(counted.collect()) == together
    none = hybrid.search_postfilter(emb, meta, queries, "nsfw = 'NOPE'", K, oversample=oversample)
    assert none.collect() == []


def test_large_candidate_set_is_joined_by_shuffle(emb, meta, queries, monkeypatch):
    ids = filters.filter_where(meta, fx.WORKLOADS[1][2])
    cands = knn_batch(emb, queries, 40)
    want = sorted(hybrid.filter_candidates(cands, ids, K, 40 * 5).collect())
    monkeypatch.setattr(filters, "MAX_BROADCAST_ROWS", 0)
    assert sorted(hybrid.filter_candidates(cands, ids, K, 40 * 5).collect()) == want


@pytest.mark.parametrize("kind", ["Flat", "IVF", "IVFPQ"])
@pytest.mark.parametrize("oversample", [1, 3, 60])
def test_index_hits_are_those_among_the_candidates(spark, emb, meta, workloads, indexes, monkeypatch, kind, oversample):
    """Counting the rank of each hit gives what fetching all candidates and filtering them would."""
    index, queries = indexes[kind], workloads.select("qid", "qvec")
    wanted = min(oversample * K, index.n)
    cands = index.search(queries, wanted, 5)
    for where in ("license is null", fx.WORKLOADS[1][2]):
        want = hybrid.filter_candidates(cands, filters.filter_where(meta, where), K)
        got = hybrid.search_ann_postfilter(index, emb, meta, queries, where, K, 5, oversample)
        assert "FlatMapCoGroups" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(got.collect()) == sorted(want.collect())
    together = hybrid.run_workloads(emb, meta, workloads, K, "hybrid", index, 5, 0.0, oversample).collect()
    monkeypatch.setattr(hybrid, "CLAUSES_PER_SCAN", 2)
    assert sorted(hybrid.run_workloads(emb, meta, workloads, K, "hybrid", index, 5, 0.0, oversample).collect()) == sorted(together)
    for qid, _, where in fx.WORKLOADS:
        alone = hybrid.filter_candidates(cands.filter(F.col("qid") == qid), filters.filter_where(meta, where), K)
        assert sorted(alone.collect()) == sorted(r for r in together if r.qid == qid)


@pytest.mark.parametrize("oversample", [3, 2000])
@pytest.mark.parametrize("nprobe", [5, 20])
def test_reranked_hits_are_exact_however_coarse_the_codes(spark, emb, meta, queries, indexes, tmp_path, oversample, nprobe):
    """The same as lists with exact distances, although two codewords a part tell little."""
    spark_index = build_or_load(spark, str(tmp_path / "coarse"), emb, "IVFPQ", nlist=20, m=2, bits=1)
    lists = spark_index.rows(spark).select("id", "cluster_id").join(emb, "id")
    exact = VectorIndex("IVF", "", 500, 64, 20, centroids=spark_index.centroids, _rows=lists)
    found = [
        hybrid.search_ann_postfilter(index, emb, meta, queries, "license is NULL", K, nprobe, oversample, rerank=True).collect()
        for index in (spark_index, exact)
    ]
    assert sorted(found[0]) == sorted(found[1]) and found[0]


def test_codes_tell_how_far_they_are_off(spark, emb, queries, indexes):
    pq = indexes["IVFPQ"]
    looked_up = {(r.qid, r.id): r.dist for r in pq.search(queries, 500, pq.nlist).collect()}
    exact = {(r.qid, r.id): r.dist for r in knn_batch(emb, queries, 500).collect()}
    off = {r.id: r.off for r in pq.rows(spark).collect()}
    assert all(abs(dist - exact[pair]) <= off[pair[1]] for pair, dist in looked_up.items()) and max(off.values()) < 1.5


def test_nothing_matches(emb, meta, queries):
    where = "nsfw = 'NOPE'"
    for search in (hybrid.search_prefilter, hybrid.search_postfilter, hybrid.search_hybrid):
        hits = search(emb, meta, queries, where, K)
        assert hits.columns == ["qid", "rank", "id", "dist"] and hits.collect() == []
    assert {r.strategy for r in hybrid.plan_info(meta, queries, where).collect()} == {"none"}


def test_strategy_threshold_is_strict():
    assert hybrid.choose_strategy(0, 100) == "none"
    assert hybrid.choose_strategy(7, 100) == "pre-filtering"
    assert hybrid.choose_strategy(8, 100) == "post-filtering"
    assert hybrid.choose_strategy(9, 100, 0.1) == "pre-filtering"


def test_plan_info(meta, queries):
    row = hybrid.plan_info(meta, one(queries, 3), fx.WORKLOADS[2][2]).first()
    assert tuple(row) == (3, 500, 4, 0.008, "pre-filtering")


@pytest.mark.parametrize("strategy", ["prefilter", "postfilter", "hybrid"])
def test_workloads_together_equal_one_by_one(emb, meta, workloads, truth, strategy):
    assert sorted(hybrid.run_workloads(emb, meta, workloads, K, strategy).collect()) == truth


def test_workloads_in_several_groups(emb, meta, workloads, truth, monkeypatch):
    monkeypatch.setattr(hybrid, "CLAUSES_PER_SCAN", 2)
    named = workloads.withColumn("qid", F.col("qid").cast("string"))
    hits = hybrid.run_workloads(emb, meta, named, K, "hybrid").collect()
    assert sorted((int(r.qid), r.rank, r.id) for r in hits) == [(r.qid, r.rank, r.id) for r in truth]
    with pytest.raises(ValueError, match="unknown strategy"):
        hybrid.run_workloads(emb, meta, workloads, K, "sideways")


def test_a_hundred_clauses_make_a_plan_of_constant_size(spark, emb, meta, queries):
    one = queries.filter("qid = 1").select("qvec")
    many = spark.range(100).join(one).select("id", "qvec", F.concat(F.lit("original_width * 0 + id >= "), F.col("id") * 5).alias("where_sql")).withColumnRenamed("id", "qid")
    hits = hybrid.run_workloads(emb, meta, many, 1, "prefilter")
    assert len(hits._jdf.queryExecution().executedPlan().toString()) < 2_000
    nearest = {r.id: r.dist for r in knn_batch(emb, queries.filter("qid = 1"), 500).collect()}
    want = {q: min((d, i) for i, d in nearest.items() if i >= 5 * q)[1] for q in range(100)}
    assert {r.qid: r.id for r in hits.collect()} == want


def test_workloads_sharing_a_clause(emb, meta, workloads, truth):
    same = workloads.withColumn("where_sql", F.lit("license is NULL"))
    hits = hybrid.run_workloads(emb, meta, same, K, "prefilter")
    assert [r for r in sorted(hits.collect()) if r.qid == 4] == [r for r in truth if r.qid == 4]
    assert hits.select("qid").distinct().count() == 5


def test_candidates_keep_their_order(spark):
    cands = spark.createDataFrame([(1, 5, 0.1), (1, 2, 0.1), (1, 9, 0.05), (1, 7, 0.3), (2, 7, 0.2)], "qid long, id long, dist double")
    ids = spark.createDataFrame([(2,), (5,), (7,), (7,)], "id long")
    for max_rows in (None, 10):
        hits = hybrid.filter_candidates(cands, ids, 2, max_rows).orderBy("qid", "rank").collect()
        assert [(r.qid, r.rank, r.id) for r in hits] == [(1, 1, 2), (1, 2, 5), (2, 1, 7)]


def test_candidates_not_ids_are_broadcast(emb, meta, queries):
    hits = hybrid.search_postfilter(emb, meta, queries, "license is null", K)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan


def test_counters(emb, meta, queries):
    counters = hybrid.WorkCounters()
    hybrid.search_prefilter(emb, meta, queries, "license is null", K, counters=counters).collect()
    assert counters.as_dict() == {"rows_filtered": 413, "rows_scored": 413, "rows_returned": 50}
    nothing = hybrid.WorkCounters()
    hybrid.search_prefilter(emb, meta, queries, "nsfw = 'NOPE'", K, counters=nothing).collect()
    assert nothing.as_dict() == {"rows_filtered": 0, "rows_scored": 0, "rows_returned": 0}


@pytest.mark.parametrize("strategy", ["postfilter", "hybrid", "index"])
def test_counters_of_the_other_strategies(emb, meta, queries, indexes, strategy):
    counters = hybrid.WorkCounters()
    if strategy == "postfilter":
        hits = hybrid.search_postfilter(emb, meta, queries, "license is null", K, counters=counters)
    else:
        hits = hybrid.search_hybrid(emb, meta, queries, "license is null", K, indexes["IVF"] if strategy == "index" else None, 20, counters=counters)
    hits.collect()
    assert counters.as_dict() == {"rows_filtered": 413, "rows_scored": 413, "rows_returned": 50}


def test_skewed_copies(spark, queries, emb):
    """A third of the rows are copies of one vector and share one attribute value."""
    base = emb.filter("id < 200").select("id", "embedding")
    hot = emb.filter("id = 0").select("embedding")
    copies = spark.range(1000, 1100).crossJoin(hot)
    vectors = base.unionAll(copies.select("id", "embedding"))
    meta = vectors.select("id", F.when(F.col("id") >= 1000, "hot").otherwise("cold").alias("kind"))
    query = emb.filter("id = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    hits = hybrid.search_prefilter(vectors, meta, query, "kind = 'hot'", 5).orderBy("rank").collect()
    assert [r.id for r in hits] == [1000, 1001, 1002, 1003, 1004]
    top = knn_batch(vectors, query, 4).orderBy("rank").collect()
    assert [r.id for r in top] == [0, 1000, 1001, 1002]
