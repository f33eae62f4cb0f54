import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveknn import fixtures as fx
from sieveknn.operators import ivf as ivf_module
from sieveknn.operators.ivf import ZERO_CLUSTER, train_sample
from sieveknn.operators.nearest import knn_batch
from sieveknn.operators.pq import choose_m
from sieveknn.plans import hybrid
from sieveknn.plans.evaluate import recall
from sieveknn.plans.index import build_or_load, load_index


@pytest.fixture(scope="module")
def emb(spark, sf_dir):
    return fx.embeddings(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def queries(emb):
    return emb.filter("id < 40").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec")).cache()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("indexes"))


@pytest.fixture(scope="module")
def ivf(spark, emb, folder):
    return build_or_load(spark, f"{folder}/ivf", emb, "IVF")


@pytest.fixture(scope="module")
def pq(spark, emb, folder):
    return build_or_load(spark, f"{folder}/pq", emb, "IVFPQ", bits=4)


def mean_recall(found, truth, queries):
    return recall(found, truth, queries).agg(F.avg("recall")).first()[0]


def test_choose_m():
    assert choose_m(64) == 8 and choose_m(96, 32) == 32
    assert choose_m(36) == 12 and choose_m(20) == 4 and choose_m(48, 7) == 16
    with pytest.raises(ValueError):
        choose_m(30, 4)


def test_sample_is_exact_and_repeatable(spark, emb):
    first = sorted(r.id for r in train_sample(emb, 60).collect())
    assert len(set(first)) == 60
    assert first == sorted(r.id for r in train_sample(emb.repartition(7), 60).collect())
    assert first != sorted(r.id for r in train_sample(emb, 60, seed=1).collect())
    assert train_sample(emb, 10_000).count() == 500


def test_all_lists_give_the_exact_answer(ivf, emb, queries):
    assert sorted(ivf.search(queries, 10, ivf.nlist).collect()) == sorted(knn_batch(emb, queries, 10).collect())


def test_recall_grows_with_probes(ivf, emb, queries):
    truth = knn_batch(emb, queries, 10).cache()
    shares = [mean_recall(ivf.search(queries, 10, n), truth, queries) for n in (1, 5, 10, ivf.nlist)]
    assert shares == sorted(shares) and shares[-1] == 1.0
    assert shares[2] >= 0.7


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    """Rows that the scans of an executed plan handed on."""
    df.collect()
    node, total = [df._jdf.queryExecution().executedPlan()], 0
    while node:
        one = node.pop()
        name = one.nodeName()
        if name.startswith("Scan parquet"):
            total += one.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            node.append(one.executedPlan())
        elif "QueryStage" in name:
            node.append(one.plan())
        children = one.children()
        node += [children.apply(i) for i in range(children.size())]
    return total


def test_only_probed_lists_are_read(spark, ivf, queries):
    hits = ivf.search(queries.limit(1), 10, 3)
    hits.collect()
    assert "EqualTo(cluster_id," in plan(hits) and "dynamicpruning" not in plan(hits)
    assert "cluster_id" not in plan(ivf.search(queries.limit(1), 10, ivf.nlist)).split("PushedFilters: [")[1].split("]")[0]
    assert ivf.rows(spark).select("cluster_id").distinct().count() == ivf.nlist


def test_row_groups_and_pages_without_a_probed_list_are_skipped(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf_module, "ROW_GROUP_BYTES", 64 * 1024)
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=32).tolist(), int(i % 200)) for i in range(20_000)], "id long, embedding array<float>, cluster_id int")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ivf_module.write_lists(rows, str(tmp_path / "lists"))
    stored = spark.read.parquet(str(tmp_path / "lists"))
    assert len(stored.inputFiles()) <= 4  # not one for each list
    members = {number: np.array([0]) for number in (3, 4, 5, 77, 150)}
    pruned = ivf_module.prune_lists(stored, members, 200)
    assert pruned.count() == 500
    assert rows_read(pruned.select("id", "embedding", "cluster_id").filter("id >= 0")) < 8_000
    monkeypatch.setattr(ivf_module, "MAX_RUNS", 2)  # 3 ... 77 become one run: more is read, nothing lost
    assert set(members) <= {r.cluster_id for r in ivf_module.prune_lists(stored, members, 200).select("cluster_id").distinct().collect()}


def test_compaction_keeps_the_rows(spark, emb, folder):
    index = build_or_load(spark, f"{folder}/parts", emb.filter("id < 100"), "IVFPQ", nlist=5, bits=4)
    for low in (100, 200, 300, 400):
        index.add(emb.filter(F.col("id").between(low, low + 99)))
    before, files = sorted(index.rows(spark).collect()), len(index.rows(spark).inputFiles())
    index.compact(spark)
    loaded = load_index(spark, f"{folder}/parts")
    assert loaded.path == index.path and loaded.n == 500
    assert sorted(loaded.rows(spark).collect()) == before and len(loaded.rows(spark).inputFiles()) < files


def test_centroids_are_the_directions_of_their_members(spark, emb, monkeypatch):
    """Trained to the end, with sums in several blocks and groups; the driver never gets pairs of centroids."""
    monkeypatch.setattr(ivf_module, "LISTS_PER_BLOCK", 4)
    monkeypatch.setattr(ivf_module, "merge_groups", lambda _: 2)
    sample = train_sample(emb).repartition(4).cache()
    centroids = ivf_module.train_ivf(sample, 11, max_iter=60, tolerance=1e-6)
    rows = np.array([r.embedding for r in sample.collect()])
    owner = (rows @ centroids.T).argmax(axis=1)
    sums = np.array([rows[owner == c].sum(axis=0) for c in range(11)])
    assert np.allclose(centroids, sums / np.linalg.norm(sums, axis=1, keepdims=True), atol=1e-4)
    assert not hasattr(ivf_module, "KMeans")
    copies = sample.filter("id = 3").select("embedding").crossJoin(spark.range(9)).select("id", "embedding")
    assert ivf_module.train_ivf(copies, 4).shape == (1, 64)
    with pytest.raises(ValueError, match="direction"):
        ivf_module.train_ivf(sample.select("id", F.transform("embedding", lambda x: x * 0).alias("embedding")), 4)


def test_rows_without_a_vector(spark, emb, folder):
    gaps = emb.filter("id < 60").select("id", F.when(F.col("id") % 3 > 0, F.col("embedding")).alias("embedding"))
    index = build_or_load(spark, f"{folder}/gaps", gaps, "IVF", nlist=4)
    assert index.n == 40 and load_index(spark, f"{folder}/gaps").n == 40
    query = emb.filter("id = 4").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    assert sorted(index.search(query, 50, 4).collect()) == sorted(knn_batch(gaps, query, 50).collect())


def test_every_vector_is_stored_once(spark, emb, ivf, pq):
    for index in (ivf, pq):
        row = index.rows(spark).agg(F.count("*"), F.countDistinct("id"), F.min("cluster_id"), F.max("cluster_id")).first()
        assert row[0] == row[1] == 500 and 0 <= row[2] and row[3] < index.nlist


def test_codes_approximate(spark, pq, emb, queries):
    truth = knn_batch(emb, queries, 10).cache()
    found = pq.search(queries, 10, pq.nlist)
    assert mean_recall(found, truth, queries) > 0.3
    wide = pq.search(queries, 50, pq.nlist)
    reranked = hybrid.rerank_exact(wide, emb, queries, 40 * 50)
    exact = {(r.qid, r.id): r.dist for r in knn_batch(emb, queries, 500).collect()}
    assert all(abs(exact[r.qid, r.id] - r.dist) < 1e-9 for r in reranked.collect())


def test_lookup_equals_decoded_vectors(spark, pq, queries):
    """The looked-up distance is the distance to the vector rebuilt from its code."""
    codes = {r.id: (r.cluster_id, r.code) for r in pq.rows(spark).collect()}
    query = queries.filter("qid = 5").first()
    q = np.array(query.qvec) / np.linalg.norm(query.qvec)
    for hit in pq.search(queries.filter("qid = 5"), 20, pq.nlist).collect():
        cluster, code = codes[hit.id]
        rebuilt = pq.centroids[cluster] + np.concatenate([pq.codebooks[m][c] for m, c in enumerate(code)])
        assert abs((1 - rebuilt @ q) - hit.dist) < 1e-5


def test_load_rebuild_and_errors(spark, emb, folder, ivf):
    loaded = load_index(spark, f"{folder}/ivf")
    assert loaded.path == ivf.path and np.array_equal(loaded.centroids, ivf.centroids)
    assert build_or_load(spark, f"{folder}/ivf", emb, "IVF").path == ivf.path
    assert load_index(spark, f"{folder}/absent") is None
    with pytest.raises(ValueError, match="holds an index of type IVF"):
        build_or_load(spark, f"{folder}/ivf", emb, "IVFPQ")
    with pytest.raises(ValueError, match="unknown index type"):
        build_or_load(spark, f"{folder}/x", emb, "HNSW")
    with pytest.raises(ValueError, match="no vectors"):
        build_or_load(spark, f"{folder}/x", emb.limit(0), "Flat")
    small = emb.filter("id < 50")
    first = build_or_load(spark, f"{folder}/flat", small, "Flat")
    second = build_or_load(spark, f"{folder}/flat", emb, "Flat", rebuild=True)
    assert first.path != second.path and load_index(spark, f"{folder}/flat").n == 500
    assert first.rows(spark).count() == 50  # a search under way keeps its version


def test_loaded_codebooks(spark, folder, pq):
    loaded = load_index(spark, f"{folder}/pq")
    assert loaded.codebooks.shape == (8, 16, 8) and np.array_equal(loaded.codebooks, pq.codebooks)


def test_zero_vectors_are_always_probed(spark, emb, folder):
    zeros = spark.range(900, 903).select("id", F.array_repeat(F.lit(0.0).cast("float"), 64).alias("embedding"))
    both = emb.unionAll(zeros)
    index = build_or_load(spark, f"{folder}/zeros", both, "IVF", nlist=10)
    assert index.rows(spark).filter(F.col("cluster_id") == ZERO_CLUSTER).count() == 3
    query = emb.filter("id = 1").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    assert {900, 901, 902} <= {r.id for r in index.search(query, 600, 1).collect()}
    assert sorted(index.search(query, 600, 10).collect()) == sorted(knn_batch(both, query, 600).collect())


def test_hot_list(spark, emb, folder):
    """A third of all vectors are copies that fall into one list."""
    copies = spark.range(1000, 1250).crossJoin(emb.filter("id = 3").select("embedding"))
    both = emb.unionAll(copies.select("id", "embedding"))
    index = build_or_load(spark, f"{folder}/hot", both, "IVF", nlist=12)
    query = emb.filter("id = 3").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    hits = index.search(query, 5, 1).orderBy("rank").collect()
    assert [r.id for r in hits] == [3, 1000, 1001, 1002, 1003]


def test_add(spark, emb, folder):
    index = build_or_load(spark, f"{folder}/grow", emb.filter("id < 400"), "IVF", nlist=8)
    index.add(emb.filter("id >= 400"))
    assert index.n == load_index(spark, f"{folder}/grow").n == 500
    query = emb.filter("id = 450").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    assert sorted(index.search(query, 10, 8).collect()) == sorted(knn_batch(emb, query, 10).collect())


def test_hybrid_with_indexes(spark, sf_dir, emb, ivf, pq):
    meta, workloads = fx.metadata(spark, sf_dir).cache(), fx.workloads(spark, sf_dir).cache()
    truth = hybrid.run_workloads(emb, meta, workloads, strategy="prefilter").cache()
    exact = hybrid.run_workloads(emb, meta, workloads, index=ivf, nprobe=ivf.nlist)
    assert sorted(exact.collect()) == sorted(truth.collect())
    for index in (ivf, pq):
        found = hybrid.run_workloads(emb, meta, workloads, index=index).cache()
        allowed = {
            (qid, r.id) for qid, _, where in fx.WORKLOADS for r in meta.filter(where).select("id").collect()
        }
        assert {(r.qid, r.id) for r in found.collect()} <= allowed
        # the selective workload filters first and is exact whatever the index
        assert [r.recall for r in recall(found, truth, workloads).filter("qid = 3").collect()] == [1.0]
