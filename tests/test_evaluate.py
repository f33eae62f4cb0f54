import pytest
from pyspark.sql import functions as F

from sieveknn import fixtures as fx
from sieveknn.plans import evaluate as ev

RUNS = [
    (1, "prefilter", 0, 1.0, 3.0), (1, "prefilter", 1, 2.0, 2.0), (1, "postfilter", 0, 2.0, 6.0),
    (1, "hybrid", 0, 0.5, 1.5), (2, "prefilter", 0, 1.0, 1.0), (2, "postfilter", 0, 1.0, 1.0), (2, "hybrid", 0, 0.0, 0.0),
    (3, "prefilter", 0, 1.23456, 0.0),
]


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame(RUNS, "workload long, strategy string, run int, filter_time double, search_time double")


def test_recall(spark):
    schema = "qid long, id long"
    found = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 9), (4, 1), (9, 9)], schema)
    truth = spark.createDataFrame([(1, 5), (1, 7), (1, 7), (3, 1), (4, 1)], schema)
    queries = spark.createDataFrame([(q,) for q in (1, 2, 3, 4, 5)], "qid long")
    got = {r.qid: (r.n_found, r.n_truth, r.n_common, r.recall) for r in ev.recall(found, truth, queries).collect()}
    assert got == {
        1: (2, 2, 1, 0.5),
        2: (1, 0, 0, 0.0),  # found something where there was nothing to find
        3: (0, 1, 0, 0.0),
        4: (1, 1, 1, 1.0),
        5: (0, 0, 0, 1.0),
    }


def test_averages_and_ratios(metrics):
    averages = ev.average_runs(metrics)
    row = averages.filter("workload = 1 and strategy = 'prefilter'").first()
    assert (row.n_runs, row.filter_time, row.search_time, row.total_time) == (2, 1.5, 2.5, 4.0)
    got = {r.workload: tuple(r)[1:] for r in ev.speedups(averages).collect()}
    assert got == {1: (2.0, 2.0, 4.0), 2: (1.0, None, None), 3: (None, None, None)}


def test_results_table(spark, metrics):
    recalls = spark.createDataFrame([(1, "postfilter", 0.91234), (1, "hybrid", 0.8)], "workload long, strategy string, recall double")
    rows = ev.results_table(ev.average_runs(metrics), recalls).collect()
    assert [(r.workload, r.strategy) for r in rows][:4] == [(1, "Prefilter"), (1, "Postfilter"), (1, "Hybrid"), (2, "Prefilter")]
    assert [r.recall for r in rows[:3]] == [1.0, 0.9123, 0.8]
    assert rows[-1].filter_time == 1.2346


def test_cost_ratio(spark):
    df = spark.createDataFrame([(3.0, 2.0), (1.0, 0.0), (1.0, -4.0)], "a double, b double")
    assert [r[0] for r in df.select(ev.cost_ratio(F.col("a"), F.col("b"))).collect()] == ["1.50", "inf", "inf"]


def test_evaluation(spark, sf_dir):
    emb, meta = fx.embeddings(spark, sf_dir).cache(), fx.metadata(spark, sf_dir).cache()
    workloads = fx.workloads(spark, sf_dir, [2, 3]).cache()
    metrics, recalls = ev.evaluate(emb, meta, workloads, runs=2)
    assert metrics.count() == 2 * 2 * 3
    assert metrics.filter("filter_time <= 0 or search_time < 0").count() == 0
    assert sorted((r.workload, r.strategy, r.recall) for r in recalls.collect()) == [
        (w, s, 1.0) for w in (2, 3) for s in ("hybrid", "postfilter")
    ]
    assert ev.results_table(ev.average_runs(metrics), recalls).count() == 6
