"""Comparing strategies: recall, timings, ratios and the results table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import filter_where
from ..operators.ivf import NPROBE
from ..session import new_scratch_path
from .hybrid import EVALUATION_THRESHOLD, OVERSAMPLE, plan_clauses, run_workloads
from .index import VectorIndex

# Strategies of the evaluation, their labels in the results table, and its runs.
STRATEGIES = {"prefilter": "Prefilter", "postfilter": "Postfilter", "hybrid": "Hybrid"}
RUNS = 5


def recall(found: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, n_found, n_truth, n_common, recall)`` for every query in ``queries``.

    Both results are sets.  Without any truth the recall is 1 if nothing was found and 0 otherwise.
    Tagged rows are grouped, not joined, so repeated rows cannot multiply.
    """
    tagged = found.select("qid", "id", F.lit(1).alias("f"), F.lit(0).alias("t")).unionAll(
        truth.select("qid", "id", F.lit(0), F.lit(1))
    )
    members = tagged.groupBy("qid", "id").agg(F.max("f").alias("f"), F.max("t").alias("t"))
    sizes = members.groupBy("qid").agg(
        F.sum("f").alias("n_found"), F.sum("t").alias("n_truth"), F.sum(F.col("f") * F.col("t")).alias("n_common")
    )
    sizes = queries.select("qid").distinct().join(sizes, "qid", "left").na.fill(0, ["n_found", "n_truth", "n_common"])
    share = F.when(F.col("n_truth") > 0, F.col("n_common") / F.col("n_truth")).otherwise(
        F.when(F.col("n_found") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return sizes.withColumn("recall", share)


def average_runs(metrics: DataFrame) -> DataFrame:
    """Mean filter, search and total time of each workload and strategy over its runs."""
    return (
        metrics.groupBy("workload", "strategy")
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.avg("filter_time").alias("filter_time"),
            F.avg("search_time").alias("search_time"),
        )
        .withColumn("total_time", F.col("filter_time") + F.col("search_time"))
    )


def speedups(averages: DataFrame) -> DataFrame:
    """Ratios of total times per workload; a zero or missing denominator gives NULL."""
    times = averages.groupBy("workload").pivot("strategy", list(STRATEGIES)).agg(F.first("total_time"))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    return times.select(
        "workload",
        ratio("postfilter", "prefilter").alias("post_over_pre"),
        ratio("prefilter", "hybrid").alias("pre_over_hybrid"),
        ratio("postfilter", "hybrid").alias("post_over_hybrid"),
    )


def cost_ratio(cost: Column, base: Column) -> Column:
    """A cost relative to a base as text with two digits; ``inf`` if the base is not positive."""
    return F.when(base > 0, F.format_string("%.2f", cost / base)).otherwise(F.lit("inf"))


def results_table(averages: DataFrame, recalls: DataFrame) -> DataFrame:
    """One row per workload and strategy, as the report shows it.

    ``recalls`` is ``(workload, strategy, recall)``; the pre-filter is the ground truth, recall 1.
    """
    label = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])
    joined = averages.join(recalls.select("workload", "strategy", "recall"), ["workload", "strategy"], "left")
    shown = F.when(F.col("strategy") == "prefilter", F.lit(1.0)).otherwise(F.col("recall"))
    return joined.select(
        "workload",
        label[F.col("strategy")].alias("strategy"),
        F.round("filter_time", 4).alias("filter_time"),
        F.round("search_time", 4).alias("search_time"),
        F.round("total_time", 4).alias("total_time"),
        F.round(shown, 4).alias("recall"),
    ).orderBy("workload", F.array_position(F.array(*[F.lit(v) for v in STRATEGIES.values()]), F.col("strategy")))


def compare_filters(a: DataFrame, b: DataFrame) -> DataFrame:
    """E5: do two filters select the same ids?  ``(n_a, n_b, only_a, only_b)``."""
    tagged = a.select("id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select("id", F.lit(0), F.lit(1)))
    per_id = tagged.groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    count = lambda condition: F.count_if(condition)
    return per_id.agg(
        count(F.col("a") == 1).alias("n_a"),
        count(F.col("b") == 1).alias("n_b"),
        count(F.col("b") == 0).alias("only_a"),
        count(F.col("a") == 0).alias("only_b"),
    )


def timed(action: Callable[[], object]) -> tuple[float, object]:
    start = time.perf_counter()
    value = action()
    return time.perf_counter() - start, value


def evaluate(
    emb: DataFrame,
    meta: DataFrame,
    workloads: DataFrame,
    index: VectorIndex | None = None,
    k: int = 10,
    runs: int = RUNS,
    nprobe: int = NPROBE,
    threshold: float = EVALUATION_THRESHOLD,
    oversample: int = OVERSAMPLE,
) -> tuple[DataFrame, DataFrame]:
    """Run every workload with each strategy several times.

    Returns ``metrics (workload, strategy, run, filter_time, search_time)`` and
    ``recalls (workload, strategy, recall)``.  Timing needs one action per measurement, so this loops
    over workloads on the driver; ``run_workloads`` answers many workloads at once.  The hits of each run are
    written to the shared folder, and the recalls, averaged over the runs, are computed from these tables.
    """
    spark = emb.sparkSession
    metrics, path = [], new_scratch_path(spark, "evaluation")
    chosen = workloads.select("qid", "where_sql").orderBy("qid").collect()
    for row in chosen:
        one = workloads.filter(F.col("qid") == row.qid)
        for run in range(runs):
            for strategy in STRATEGIES:
                filter_time, plans = timed(lambda: plan_clauses(meta, [row.where_sql], threshold))

                def search() -> None:
                    hits = run_workloads(emb, meta, one, k, strategy, index, nprobe, threshold, oversample, plans=plans)
                    hits.write.mode("append").parquet(f"{path}/strategy={strategy}/run={run}")

                metrics.append((row.qid, strategy, run, filter_time, timed(search)[0]))
    schema = "workload bigint, strategy string, run int, filter_time double, search_time double"
    measured = spark.createDataFrame(metrics, schema)
    if not metrics:
        return measured, spark.createDataFrame([], "workload bigint, strategy string, recall double")
    # one query for each run of each strategy, so that recall compares like with like
    results = spark.read.parquet(path).select("strategy", F.struct("run", "qid").alias("qid"), "id")
    truth = results.filter("strategy = 'prefilter'")
    asked = workloads.select("qid", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    recalls = None
    for strategy in ("postfilter", "hybrid"):
        found = results.filter(F.col("strategy") == strategy)
        each = recall(found, truth, asked.select(F.struct("run", "qid").alias("qid")))
        part = each.groupBy(F.col("qid.qid").alias("workload")).agg(F.avg("recall").alias("recall"))
        part = part.select("workload", F.lit(strategy).alias("strategy"), "recall")
        recalls = part if recalls is None else recalls.unionAll(part)
    return measured, recalls


def same_selection(meta: DataFrame, where: str, by_columns: DataFrame) -> bool:
    """Whether a WHERE clause and a column-API filter agree."""
    row = compare_filters(filter_where(meta, where), by_columns).first()
    return row.only_a == 0 and row.only_b == 0
