"""Every registered query against its SQL at the smallest scale."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from checks.compare import compare, connect  # noqa: E402
from checks import queries as registered  # noqa: E402
from checks.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["qid", "rank", "id", "dist"] and rows.count() == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, sf_dir, name):
    assert compare(spark, connection, sf_dir, name) == ""


def test_fewer_than_k_asks_for_more_than_there_are(spark, sf_dir, monkeypatch):
    class Large:
        n = 200_000

        def search(self, queries, k, nprobe):
            assert k > self.n
            return queries.select("qid", F.lit(1).alias("rank"))

    monkeypatch.setattr(registered, "index", lambda *_: Large())
    assert QUERIES["a10_fewer_than_k"](spark, sf_dir).count() == 2


def test_sides_of_the_item_table_are_never_broadcast(spark, sf_dir):
    text = registered.fx.items(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert text.count("SortMergeJoin") == 3 and "Broadcast" not in text


@pytest.mark.parametrize("name", ["h3_hybrid_ivfpq", "h8_run_workloads_ivfpq"])
def test_checked_hits_read_the_stored_metadata_once(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "o_orderkey" not in text and "caption" not in text
    assert all(r.holds for r in found.collect())


def test_a_wrong_hit_does_not_hold(spark, sf_dir):
    pq = registered.index(spark, sf_dir, "IVFPQ")
    queries = registered.only_queries(registered.fx.workloads(spark, sf_dir))
    hits = pq.search(queries, 10, pq.nlist)
    moved = hits.withColumn("dist", F.when(F.col("rank") == 4, F.col("dist") + 0.01).otherwise(F.col("dist")))
    skipped = hits.filter("rank > 1").withColumn("rank", F.col("rank") - 1)
    for wrong, n in ((hits, 0), (moved, 5), (skipped, 45)):
        rows = registered.holds(spark, sf_dir, wrong, pq).collect()
        assert sum(not r.holds for r in rows) == n
