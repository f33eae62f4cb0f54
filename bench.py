"""Headline queries, timed; prints one JSON line.

Vectors, metadata and indexes are prepared first, as a user of the library would once per data set;
each query then runs ``RUNS`` times after a warm-up and counts with its mean.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from sieveknn import fixtures as fx  # noqa: E402
from sieveknn.operators import filters  # noqa: E402
from sieveknn.operators.nearest import knn, knn_batch, rank_all  # noqa: E402
from sieveknn.plans import hybrid  # noqa: E402
from sieveknn.plans.index import build_or_load  # noqa: E402
from sieveknn.session import build_session, new_scratch_path, ship_package  # noqa: E402
from sieveknn.sources import write_metadata  # noqa: E402

RUNS = 5


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    setup: dict[str, float] = {}
    queries: dict[str, float] = {}

    def once(name, action):
        start = time.perf_counter()
        result = action()
        setup[name] = round(time.perf_counter() - start, 3)
        return result

    def bench(name, query):
        query().collect()
        start = time.perf_counter()
        for _ in range(RUNS):
            query().collect()
        queries[name] = round((time.perf_counter() - start) / RUNS, 4)

    base = new_scratch_path(spark, "bench")
    once("write_vectors", lambda: fx.embeddings(spark, sf_dir).write.parquet(f"{base}/emb"))
    once("write_metadata", lambda: write_metadata(fx.metadata(spark, sf_dir), f"{base}/meta", sort_by=["id"]))
    emb, meta = spark.read.parquet(f"{base}/emb"), spark.read.parquet(f"{base}/meta")
    once("write_workloads", lambda: fx.workloads(spark, sf_dir).write.parquet(f"{base}/workloads"))
    workloads = spark.read.parquet(f"{base}/workloads")
    ivf = once("build_ivf", lambda: build_or_load(spark, f"{base}/ivf", emb, "IVF"))
    pq = once("build_ivfpq", lambda: build_or_load(spark, f"{base}/ivfpq", emb, "IVFPQ"))

    five = workloads.filter("qid = 5").select("qid", "qvec")
    where = fx.WORKLOADS[4][2]
    vector = five.first().qvec
    everyone = emb.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    pooled = workloads.select("qid", "qvec")

    bench("filter_where", lambda: filters.filter_where(meta, where))
    bench("selectivity", lambda: filters.selectivity(meta, where))
    bench("knn", lambda: knn(emb, vector, 10))
    bench("knn_batch", lambda: knn_batch(emb, pooled, 10))
    bench("knn_graph", lambda: knn_batch(emb, everyone, 10))
    bench("rank_all", lambda: rank_all(emb, vector, meta))
    bench("prefilter", lambda: hybrid.search_prefilter(emb, meta, five, where))
    bench("postfilter", lambda: hybrid.search_postfilter(emb, meta, five, where))
    bench("hybrid_ivf", lambda: hybrid.search_hybrid(emb, meta, five, where, index=ivf))
    bench("hybrid_ivfpq", lambda: hybrid.search_hybrid(emb, meta, five, where, index=pq))
    bench("ivf_search", lambda: ivf.search(pooled, 10))
    bench("ivfpq_search", lambda: pq.search(pooled, 10))
    for strategy in ("prefilter", "postfilter", "hybrid"):
        bench(f"workloads_{strategy}", lambda s=strategy: hybrid.run_workloads(emb, meta, workloads, 10, s, pq))
    spark.stop()

    print(
        json.dumps(
            {
                "metric": "hybrid search, mean seconds per query, summed",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "setup": setup,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    # Spark's own chatter on standard output must not precede the JSON line
    with contextlib.suppress(BrokenPipeError):
        main()
