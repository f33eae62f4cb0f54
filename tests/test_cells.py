"""Queries as a table: the same hits as queries that go to every task, and one read of the lists."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveknn import fixtures as fx
from sieveknn.operators import cells, ivf, nearest, pq
from sieveknn.operators.nearest import knn_batch
from sieveknn.plans.index import build_or_load


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def emb(spark, sf_dir):
    return fx.embeddings(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def queries(emb):
    return emb.filter("id < 60").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec")).cache()


@pytest.fixture(scope="module")
def indexes(spark, emb, tmp_path_factory):
    """Lists with zero vectors and a hot list: a third of the rows are copies of one vector."""
    folder = str(tmp_path_factory.mktemp("cells"))
    copies = spark.range(1000, 1250).crossJoin(emb.filter("id = 3").select("embedding"))
    zeros = spark.range(900, 903).select("id", F.array_repeat(F.lit(0.0).cast("float"), 64).alias("embedding"))
    both = emb.unionAll(copies.select("id", "embedding")).unionAll(zeros)
    return {kind: build_or_load(spark, f"{folder}/{kind}", both, kind, nlist=12, bits=4) for kind in ("IVF", "IVFPQ")}


def small_cells(monkeypatch):
    for module in (cells, ivf, pq):
        monkeypatch.setattr(module, "ROWS_PER_CELL", 40)
        monkeypatch.setattr(module, "QUERIES_PER_CELL", 7)


@pytest.mark.parametrize("kind", ["IVF", "IVFPQ"])
@pytest.mark.parametrize("nprobe", [1, 4, 12])
def test_a_table_of_queries_finds_the_same(indexes, queries, monkeypatch, kind, nprobe):
    index = indexes[kind]
    want = sorted(index.search(queries, 7, nprobe).collect())
    small_cells(monkeypatch)
    monkeypatch.setattr(nearest, "QUERIES_PER_FETCH", 10)
    found = index.search(queries, 7, nprobe)
    assert "FlatMapCoGroupsInArrow" in plan(found)
    got = sorted(found.collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r.dist for r in got], [r.dist for r in want], atol=1e-6)


def test_all_lists_give_the_exact_answer_for_text_ids(spark, indexes, queries, monkeypatch):
    index = indexes["IVF"]
    named = queries.select(F.concat(F.lit("q"), "qid").alias("qid"), "qvec")
    want = sorted(knn_batch(index.rows(spark), named, 5).collect())
    small_cells(monkeypatch)
    monkeypatch.setattr(nearest, "QUERIES_PER_FETCH", 10)
    assert sorted(index.search(named, 5, 12).collect()) == want


def test_lookup_tables_bound_the_queries_of_a_cell(indexes, queries, monkeypatch):
    index = indexes["IVFPQ"]
    want = sorted(r[:3] for r in index.search(queries, 5, 3).collect())
    monkeypatch.setattr(pq, "LOOKUP_BYTES", 3 * pq.lookup_bytes(index.codebooks))
    monkeypatch.setattr(nearest, "QUERIES_PER_FETCH", 10)
    assert sorted(r[:3] for r in index.search(queries, 5, 3).collect()) == want


def test_wrong_queries_are_refused(indexes, queries, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES_PER_FETCH", 10)
    index = indexes["IVF"]
    with pytest.raises(ValueError, match="no vector"):
        index.search(queries.withColumn("qvec", F.when(F.col("qid") != 4, F.col("qvec"))), 1)
    with pytest.raises(ValueError, match="qid of its own"):
        index.search(queries.unionAll(queries.limit(1)), 1)
    with pytest.raises(Exception, match="must have"):
        index.search(queries.withColumn("qvec", F.when(F.col("qid") == 4, F.slice("qvec", 1, 3)).otherwise(F.col("qvec"))), 1).collect()


def test_twenty_thousand_queries_read_the_rows_once(spark, sf_dir, indexes, emb):
    many = spark.range(20_000).join(emb.withColumnRenamed("id", "of"), F.col("id") % 500 == F.col("of"))
    many = many.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = knn_batch(fx.embeddings(spark, sf_dir), many, 2)
    assert plan(exact).count("FileScan") == 1 and "MapInArrow" in plan(exact)
    found = indexes["IVF"].search(many, 1, 2)
    text = plan(found)
    assert text.count("ReadSchema: struct<id:bigint,embedding:array<float>>") == 1
    assert found.filter("dist > 1e-9").isEmpty() and found.count() == 20_000


def test_probing_all_lists_makes_no_row_for_each_list(indexes, queries, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES_PER_FETCH", 10)
    found = indexes["IVF"].search(queries, 7, 12)
    assert "MapInArrow" not in plan(found) and "FlatMapCoGroupsInArrow" in plan(found)
    assert sorted(found.collect()) == sorted(knn_batch(indexes["IVF"].rows(queries.sparkSession), queries, 7).collect())


def test_probes_leave_a_task_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(cells, "PROBE_BYTES", 8 * 2 * 10)  # ten vectors of two numbers
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([[1.0, i] for i in range(3)])], names=["qid", "qvec"])
    parts = list(cells.probes_of(lambda rows: np.tile(np.arange(9), (len(rows), 1)))(iter([batch])))
    assert [p.num_rows for p in parts] == [10, 10, 7]
    rows = [row for p in parts for row in p.to_pylist()]
    assert [(r["cluster_id"], r["qid"], r["qvec"][1]) for r in rows] == [(c, 7 + i, float(i)) for i in range(3) for c in range(9)]
