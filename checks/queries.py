"""One query per operator, each over whole tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveknn import fixtures as fx
from sieveknn.functions import (
    approx_eq,
    byte_histogram_encoder,
    cosine_distance,
    cosine_similarity,
    dot,
    encode_bytes,
    encode_images,
    encode_text,
    encode_workloads,
    l2_norm,
    l2_normalize,
    l2_sq_distance,
    letter_count_encoder,
    pool_query,
    query_by_id,
)
from sieveknn.operators import filters
from sieveknn.operators.ivf import NPROBE, assign_clusters, default_nlist, train_ivf, train_sample
from sieveknn.operators.nearest import knn, knn_batch, rank_all
from sieveknn.operators.pq import pq_encode
from sieveknn.plans import evaluate as ev
from sieveknn.plans import hybrid
from sieveknn.plans.index import VectorIndex, build_or_load
from sieveknn.session import new_scratch_path, ship_package
from sieveknn.sources import (
    check_alignment,
    describe,
    read_embeddings,
    read_metadata,
    read_npy,
    row_count,
    with_global_id,
    write_metadata,
    write_npy,
    write_report,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIGITS = 6
# Oversampling small enough that a post-filter can run out of candidates.
SMALL_OVERSAMPLE = 3
EXHAUSTIVE = 1 << 30


def register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, sf_dir)

        QUERIES[name] = run
        return query

    return add


def rounded(column: str | F.Column) -> F.Column:
    """Six digits, and no negative zero."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, DIGITS) + F.lit(0.0)


def shown(hits: DataFrame) -> DataFrame:
    """Hits with the distance rounded for comparison."""
    return hits.withColumn("dist", rounded("dist"))


def elements(df: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """One row per vector element."""
    return df.select(key, F.posexplode(vector).alias("pos", "x")).select(
        key, "pos", rounded(F.col("x").cast("double")).alias("x")
    )


def query_vector(spark: SparkSession, sf_dir: str, vector_id: int = 123) -> list[float]:
    return query_by_id(fx.embeddings(spark, sf_dir), vector_id).first().qvec


def only_queries(workloads: DataFrame) -> DataFrame:
    return workloads.select("qid", "qvec")


def per_workload(spark: SparkSession, sf_dir: str, search: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Union of one search per workload."""
    parts = [search(only_queries(fx.workloads(spark, sf_dir, [qid])), where) for qid, _, where in fx.WORKLOADS]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


_indexes: dict[tuple[str, str, str], VectorIndex] = {}


def index(spark: SparkSession, sf_dir: str, kind: str) -> VectorIndex:
    """An index over the stored vectors, built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _indexes:
        path = new_scratch_path(spark, f"index-{kind}")
        _indexes[key] = build_or_load(spark, path, fx.embeddings(spark, sf_dir), kind, bits=4)
    return _indexes[key]


_metadata: dict[tuple[str, str], str] = {}


def stored_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' attributes as a table of their own, written once per session: a search reads them several times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _metadata:
        path = new_scratch_path(spark, "metadata")
        fx.metadata(spark, sf_dir).write.parquet(path)
        _metadata[key] = path
    return spark.read.parquet(_metadata[key])


def own_clauses() -> list[tuple[int, str]]:
    return [(qid, where) for qid, _, where in fx.WORKLOADS]


def with_products(queries: DataFrame, pq: VectorIndex) -> DataFrame:
    """Queries with the products of their parts and all codewords: ``products[part * size + code]``."""
    book = queries.sparkSession.read.parquet(f"{pq.path}/codebook")
    part = F.slice("unit", F.col("m") * pq.codebooks.shape[2] + 1, F.lit(pq.codebooks.shape[2]))
    each = queries.crossJoin(book).select("qid", F.struct("m", "code", dot(part, "subvec").alias("x")).alias("s"))
    lists = each.groupBy("qid").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return queries.join(lists.select("qid", F.transform("s", lambda s: s["x"]).alias("products")), "qid")


def looked_up(pq: VectorIndex) -> F.Column:
    """The distance that Spark's array functions make of a unit query and the stored code of a row."""
    again = 1 - F.col("base")
    parts, size, _ = pq.codebooks.shape
    for part in range(parts):
        again = again - F.get("products", F.get("code", F.lit(part)).cast("int") + part * size)
    return again


def probed_lists(queries: DataFrame, used: VectorIndex, nprobe: int | None) -> DataFrame:
    """``(qid, cluster_id, base)``: the lists nearest to each query, with the product of its unit vector and the centroid."""
    centers = queries.sparkSession.read.parquet(f"{used.path}/centroids")
    asked = queries.crossJoin(centers).select("qid", "cluster_id", dot("unit", "centroid").alias("base"))
    if nprobe is None:
        return asked
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("base"), "cluster_id"))
    return asked.withColumn("place", place).filter(F.col("place") <= nprobe).drop("place")


def holds(
    spark: SparkSession,
    sf_dir: str,
    hits: DataFrame,
    used: VectorIndex,
    nprobe: int | None = None,
    clauses: list[tuple[int, str]] | None = None,
    exact: Sequence[int] = (),
) -> DataFrame:
    """``(qid, rank, holds)``: each hit's distance is right, and no row that was to be searched is nearer and left out.

    Every row of the probed lists (all of them without ``nprobe``) that satisfies the query's clause is scored again with array
    functions; the queries named in ``exact`` were searched without the index.  Rows beyond a query's last hit are
    neither nearer nor hits, so only those up to it meet the clauses.
    """
    path = new_scratch_path(spark, "hits")
    hits.select("qid", "rank", F.col("id").alias("hit"), "dist").write.parquet(path)
    found = spark.read.schema("qid bigint, rank int, hit bigint, dist double").parquet(path)
    queries = only_queries(fx.workloads(spark, sf_dir)).withColumn("unit", l2_normalize("qvec"))
    named = F.col("qid").isin(list(exact))
    indexed = queries.filter(~named) if exact else queries
    asked = used.rows(spark).join(F.broadcast(probed_lists(indexed, used, nprobe)), "cluster_id")
    with_tables = with_products(indexed, used) if used.kind == "IVFPQ" else indexed
    again = looked_up(used) if used.kind == "IVFPQ" else cosine_distance("embedding", "qvec")
    scored = asked.join(F.broadcast(with_tables), "qid").select("qid", "id", again.alias("again"))
    if exact:
        pairs = fx.embeddings(spark, sf_dir).filter(F.col("embedding").isNotNull()).crossJoin(F.broadcast(queries.filter(named)))
        scored = scored.unionAll(pairs.select("qid", "id", cosine_distance("embedding", "qvec").alias("again")))
    last = found.groupBy("qid").agg(F.max("dist").alias("last"))
    scored = scored.join(F.broadcast(last), "qid").filter(F.col("again") <= F.col("last") + 1e-3).drop("last")
    if clauses:
        own = F.array(*[F.when(F.expr(where), F.lit(qid).cast("bigint")) for qid, where in clauses])
        allowed = stored_metadata(spark, sf_dir).select("id", F.explode(F.array_compact(own)).alias("qid"))
        scored = scored.join(allowed, ["qid", "id"], "left_semi")
    both = scored.join(F.broadcast(found), "qid").groupBy("qid", "rank").agg(
        F.count_if(F.col("again") < F.col("dist") - 1e-5).alias("nearer"),
        F.min(F.when(F.col("id") == F.col("hit"), F.abs(F.col("again") - F.col("dist")))).alias("off"),
    )
    right = (F.col("nearer") < F.col("rank")) & (F.coalesce("off", F.lit(1.0)) < 1e-4)
    return both.select("qid", "rank", right.alias("holds"))


def searched_exactly(spark: SparkSession, sf_dir: str, threshold: float) -> list[int]:
    """The workloads that an adaptive search answers by filtering first."""
    plans = hybrid.plan_clauses(stored_metadata(spark, sf_dir), [where for _, where in own_clauses()], threshold)
    return [qid for qid, where in own_clauses() if plans[where].strategy == hybrid.PRE]


# --- sources and sinks ---------------------------------------------------------------------------


@register("s1_read_metadata")
def s1(spark, sf_dir):
    return read_metadata(spark, f"{sf_dir}/customer.parquet")


@register("s2_describe")
def s2(spark, sf_dir):
    items = fx.items(spark, sf_dir)
    total = row_count(items).first().n_rows
    return describe(items).withColumn("n_rows", F.lit(total).cast("bigint"))


@register("s3_row_count")
def s3(spark, sf_dir):
    return row_count(fx.table(spark, sf_dir, "lineitem"))


@register("s4_with_global_id")
def s4(spark, sf_dir):
    path = new_scratch_path(spark, "shards")
    events = fx.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    write_metadata(events.repartitionByRange(7, "event_id"), path, sort_by=["event_id"])
    return with_global_id(read_metadata(spark, path))


@register("s5_read_npy")
def s5(spark, sf_dir):
    path = new_scratch_path(spark, "npy")
    write_npy(fx.embeddings(spark, sf_dir), path, shards=5)
    return elements(read_npy(spark, f"{path}/part_*.npy", partition_bytes=20_000), "id", "embedding")


@register("s6_write_metadata")
def s6(spark, sf_dir):
    path = new_scratch_path(spark, "metadata")
    write_metadata(fx.metadata(spark, sf_dir), path, sort_by=["similarity"], partition_by=["NSFW"])
    written = read_metadata(spark, path, nan_as_null=False)
    return written.select("id", "label", "NSFW", "LICENSE", "similarity", "original_width", "original_height")


@register("s7_read_embeddings")
def s7(spark, sf_dir):
    return elements(read_embeddings(spark, f"{sf_dir}/embeddings.parquet", "vec_id"), "id", "embedding")


@register("s8_check_alignment")
def s8(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return check_alignment(orders, fx.embeddings(spark, sf_dir))


@register("s9_write_report")
def s9(spark, sf_dir):
    path = new_scratch_path(spark, "report")
    write_report(e4(spark, sf_dir), path)
    schema = "workload bigint, strategy string, filter_time double, search_time double, total_time double, recall double"
    return spark.read.option("header", True).schema(schema).csv(path)


# --- filters -------------------------------------------------------------------------------------

# name -> WHERE clause; F2-F6 and F8-F12 are plain SQL expressions
CLAUSES = {
    "f1_filter_where": "original_width > 1024 and original_height > 1024",
    "f2_equality": "NSFW == 'UNLIKELY'",
    "f2_equality_number": "original_width = 1024",
    "f3_inclusive_range": "similarity >= 0.02 and similarity <= 0.2 and original_width between 512 and 1536",
    "f4_strict_range": "similarity > 0.1 and original_height < 1792",
    "f5_not_equal": "nsfw != 'UNLIKELY'",
    "f6_field_vs_field_gt": "original_width > original_height",
    "f6_field_vs_field_gte": "original_width >= original_height",
    "f6_field_vs_field_lt": "original_width < original_height",
    "f6_field_vs_field_lte": "original_width <= original_height",
    "f8_is_null": "license is NULL",
    "f8_is_null_number": "similarity is null",
    "f9_is_not_null": "license is not NULL",
    "f10_self_comparison": "license = `LICENSE`",
    "f11_conjunction": "original_width = original_height and license is not NULL and nsfw='NSFW'",
    "f12_any_expression": "(nsfw in ('NSFW', 'UNSURE') or not (original_width between 512 and 1024)) "
    "and caption like '%7%' and abs(similarity - 0.1) < 0.09",
}


def _clause_query(where: str) -> Query:
    return lambda spark, sf_dir: filters.filter_where(fx.metadata(spark, sf_dir), where)


for _name, _where in CLAUSES.items():
    register(_name)(_clause_query(_where))


@register("f7_approx_eq")
def f7(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        (F.col("l_discount") * 3).alias("a"),
        (F.col("l_discount") + F.col("l_discount") + F.col("l_tax")).alias("b"),
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"),
    )
    return lines.filter(approx_eq(lines, "a", "b") | approx_eq(lines, "p", "s"))


@register("f13_filter_by")
def f13(spark, sf_dir):
    return filters.filter_by(fx.metadata(spark, sf_dir), nsfw="UNLIKELY", similarity_min=0.035, width_min=500)


@register("f13_filter_by_nothing")
def f13_nothing(spark, sf_dir):
    return filters.filter_by(fx.metadata(spark, sf_dir))


@register("f14_conjunct_profile")
def f14(spark, sf_dir):
    return filters.conjunct_profile(
        fx.metadata(spark, sf_dir), ["NSFW = 'UNLIKELY'", "similarity >= 0.35", "original_width >= 500"]
    )


@register("f15_rows_with_license")
def f15(spark, sf_dir):
    return filters.rows_with_license(fx.metadata(spark, sf_dir), "CC-BY")


@register("f16_distinct_values")
def f16(spark, sf_dir):
    return filters.distinct_values(fx.metadata(spark, sf_dir), "LICENSE")


@register("f17_fetch_rows")
def f17(spark, sf_dir):
    hits = knn_batch(fx.embeddings(spark, sf_dir), only_queries(fx.workloads(spark, sf_dir)), 10)
    rows = filters.fetch_rows(fx.metadata(spark, sf_dir), hits, max_rows=50)
    return shown(rows.select("qid", "rank", "id", "dist", "caption", "NSFW", "similarity", "original_width"))


@register("f18_selectivity")
def f18(spark, sf_dir):
    meta = fx.metadata(spark, sf_dir)
    result = filters.selectivity(meta, fx.WORKLOADS[4][2])
    return result.withColumn("selectivity", rounded("selectivity"))


@register("f19_null_as_zero")
def f19(spark, sf_dir):
    return filters.filter_where(fx.metadata(spark, sf_dir), "similarity <= 0.01", null_as_zero=True)


# --- vector functions ----------------------------------------------------------------------------


@register("v1_l2_normalize")
def v1(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    return elements(vectors.select(F.col("vec_id").alias("id"), l2_normalize(scaled).alias("vec")), "id")


@register("v2_dot")
def v2(spark, sf_dir):
    query = query_vector(spark, sf_dir)
    return fx.embeddings(spark, sf_dir).select(
        "id",
        rounded(dot("embedding", query)).alias("dot"),
        rounded(cosine_similarity("embedding", query)).alias("cosine"),
        rounded(l2_norm("embedding")).alias("norm"),
    )


@register("v3_cosine_distance")
def v3(spark, sf_dir):
    query = query_vector(spark, sf_dir)
    return fx.embeddings(spark, sf_dir).select("id", rounded(cosine_distance("embedding", query)).alias("dist"))


@register("v4_l2_sq_distance")
def v4(spark, sf_dir):
    query = query_vector(spark, sf_dir)
    distance = l2_sq_distance(l2_normalize("embedding"), query)
    return fx.embeddings(spark, sf_dir).select("id", rounded(distance).alias("dist"))


@register("v5_pool_query")
def v5(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("qid"), F.col("embedding").alias("vec")
    )
    return elements(pool_query(vectors), "qid", "qvec")


@register("v6_query_by_id")
def v6(spark, sf_dir):
    return elements(query_by_id(fx.embeddings(spark, sf_dir), 123), "qid", "qvec")


@register("v7_encode_text")
def v7(spark, sf_dir):
    encoded = encode_text(fx.table(spark, sf_dir, "documents"), "text", letter_count_encoder())
    return elements(encoded.select("doc_id", "embedding"), "doc_id", "embedding")


@register("v8_encode_images")
def v8(spark, sf_dir):
    blobs = fx.table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    encoded = encode_bytes(blobs, "content", byte_histogram_encoder()).select("page_id", "embedding")
    return elements(encoded, "page_id", "embedding")


@register("v8_encode_image_files")
def v8_files(spark, sf_dir):
    """Files made of the pages, one for each hundredth page number, read as images."""
    path = new_scratch_path(spark, "images")
    pages = fx.table(spark, sf_dir, "pages").select((F.col("page_id") % 100).alias("part"), "page_id", "html")
    pages.repartition(8, "part").sortWithinPartitions("part", "page_id").select("part", "html").write.partitionBy("part").text(path)
    encoded = encode_images(spark, path, byte_histogram_encoder(), "*.txt")
    name = F.regexp_extract("path", r"part=(\d+)/", 1).cast("bigint").alias("part")
    found = elements(encoded.select(name, "embedding"), "part", "embedding")
    return found.groupBy("part", "pos").agg(F.sum("x").alias("x"))


@register("v9_encode_workloads")
def v9(spark, sf_dir):
    """One workload for each page with a document of its number: the page as image, the document as text."""
    pages, docs = fx.table(spark, sf_dir, "pages"), fx.table(spark, sf_dir, "documents")
    images = pages.select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    workloads = docs.join(pages, docs.doc_id == pages.page_id).select(
        F.col("doc_id").alias("qid"), F.array(F.col("page_id").cast("string")).alias("images"), F.array("text").alias("texts"), F.lit("true").alias("where_sql")
    )

    def letters_of_bytes():
        count = letter_count_encoder()()
        return lambda blobs: count([bytes(blob).decode() for blob in blobs])

    return elements(encode_workloads(workloads, images, letters_of_bytes, letter_count_encoder()), "qid", "qvec")


# --- exact search --------------------------------------------------------------------------------


@register("k1_knn")
def k1(spark, sf_dir):
    return shown(knn(fx.embeddings(spark, sf_dir), query_vector(spark, sf_dir), 10))


@register("k2_knn_partial_merge")
def k2(spark, sf_dir):
    return shown(knn(fx.embeddings(spark, sf_dir), query_vector(spark, sf_dir), 200))


@register("k3_knn_batch")
def k3(spark, sf_dir):
    queries = fx.embeddings(spark, sf_dir).select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    return shown(knn_batch(fx.embeddings(spark, sf_dir), queries, 5))


@register("k4_rank_all")
def k4(spark, sf_dir):
    ranked = rank_all(fx.embeddings(spark, sf_dir), query_vector(spark, sf_dir), fx.metadata(spark, sf_dir))
    return shown(ranked)


# --- hybrid search -------------------------------------------------------------------------------


@register("h1_prefilter")
def h1(spark, sf_dir):
    queries = only_queries(fx.workloads(spark, sf_dir, [5]))
    where = fx.WORKLOADS[4][2]
    return shown(hybrid.search_prefilter(fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir), queries, where))


@register("h2_postfilter")
def h2(spark, sf_dir):
    emb, meta = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir)
    return shown(
        per_workload(
            spark, sf_dir, lambda q, where: hybrid.search_postfilter(emb, meta, q, where, oversample=SMALL_OVERSAMPLE)
        )
    )


@register("h2_postfilter_full")
def h2_full(spark, sf_dir):
    queries = only_queries(fx.workloads(spark, sf_dir, [4]))
    where = fx.WORKLOADS[3][2]
    return shown(hybrid.search_postfilter(fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir), queries, where))


@register("h3_hybrid")
def h3(spark, sf_dir):
    emb, meta = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir)
    return shown(per_workload(spark, sf_dir, lambda q, where: hybrid.search_hybrid(emb, meta, q, where)))


@register("h3_hybrid_ivf_all_lists")
def h3_ivf(spark, sf_dir):
    emb, meta, ivf = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir), index(spark, sf_dir, "IVF")
    return shown(
        per_workload(
            spark, sf_dir, lambda q, where: hybrid.search_hybrid(emb, meta, q, where, index=ivf, nprobe=EXHAUSTIVE)
        )
    )


@register("h3_hybrid_ivfpq")
def h3_ivfpq(spark, sf_dir):
    emb, meta, pq = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir), index(spark, sf_dir, "IVFPQ")
    hits = per_workload(
        spark, sf_dir, lambda q, where: hybrid.search_hybrid(emb, meta, q, where, index=pq, nprobe=EXHAUSTIVE)
    )
    return holds(spark, sf_dir, hits, pq, None, own_clauses(), searched_exactly(spark, sf_dir, hybrid.SELECTIVITY_THRESHOLD))


@register("h4_filter_candidates")
def h4(spark, sf_dir):
    cands = knn_batch(fx.embeddings(spark, sf_dir), only_queries(fx.workloads(spark, sf_dir)), 40)
    ids = filters.filter_where(stored_metadata(spark, sf_dir), "original_width >= 1024")
    return shown(hybrid.filter_candidates(cands, ids, 10, max_rows=5 * 40))


@register("h5_ann_postfilter")
def h5(spark, sf_dir):
    emb, meta, pq = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir), index(spark, sf_dir, "IVFPQ")
    queries = only_queries(fx.workloads(spark, sf_dir))
    hits = hybrid.search_ann_postfilter(pq, emb, meta, queries, "license is NULL", nprobe=EXHAUSTIVE)
    return holds(spark, sf_dir, hits, pq, None, [(qid, "license is NULL") for qid, _ in own_clauses()])


@register("h5_ann_postfilter_ivf")
def h5_ivf(spark, sf_dir):
    emb, meta, ivf = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir), index(spark, sf_dir, "IVF")
    queries = only_queries(fx.workloads(spark, sf_dir))
    hits = hybrid.search_ann_postfilter(
        ivf, emb, meta, queries, "license is NULL", nprobe=EXHAUSTIVE, oversample=SMALL_OVERSAMPLE
    )
    return shown(hits)


@register("h5_ann_postfilter_rerank")
def h5_rerank(spark, sf_dir):
    emb, meta, pq = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir), index(spark, sf_dir, "IVFPQ")
    queries = only_queries(fx.workloads(spark, sf_dir))
    return shown(
        hybrid.search_ann_postfilter(
            pq, emb, meta, queries, "license is NULL", nprobe=EXHAUSTIVE, rerank=True
        )
    )


@register("h6_prefilter_branch")
def h6(spark, sf_dir):
    emb, meta = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir)
    queries = only_queries(fx.workloads(spark, sf_dir, [3]))
    return shown(hybrid.search_hybrid(emb, meta, queries, fx.WORKLOADS[2][2], threshold=1.1))


@register("h7_plan_info")
def h7(spark, sf_dir):
    meta = stored_metadata(spark, sf_dir)
    plans = per_workload(
        spark, sf_dir, lambda q, where: hybrid.plan_info(meta, q, where, hybrid.EVALUATION_THRESHOLD)
    )
    return plans.withColumn("selectivity", rounded("selectivity"))


@register("h8_run_workloads")
def h8(spark, sf_dir):
    emb, meta = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir)
    return shown(hybrid.run_workloads(emb, meta, fx.workloads(spark, sf_dir)))


@register("h8_run_workloads_ivfpq")
def h8_ivfpq(spark, sf_dir):
    emb, meta, pq = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir), index(spark, sf_dir, "IVFPQ")
    hits = hybrid.run_workloads(emb, meta, fx.workloads(spark, sf_dir), index=pq, nprobe=EXHAUSTIVE)
    return holds(spark, sf_dir, hits, pq, None, own_clauses(), searched_exactly(spark, sf_dir, hybrid.EVALUATION_THRESHOLD))


# --- approximate index ---------------------------------------------------------------------------


@register("a1_train_sample")
def a1(spark, sf_dir):
    sample = train_sample(fx.embeddings(spark, sf_dir), 100)
    return sample.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"))


@register("a2_train_ivf")
def a2(spark, sf_dir):
    emb = fx.embeddings(spark, sf_dir)
    centroids = train_ivf(train_sample(emb), default_nlist(emb.count()))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    table = spark.createDataFrame(rows, "cluster_id int, centroid array<float>")
    return table.select("cluster_id", F.size("centroid").alias("d"), F.round(l2_norm("centroid"), 4).alias("norm"))


@register("a3_assign_clusters")
def a3(spark, sf_dir):
    ivf = index(spark, sf_dir, "IVF")
    assigned = assign_clusters(fx.embeddings(spark, sf_dir), ivf.centroids)
    similar = F.transform(F.lit(ivf.centroids.tolist()), lambda centroid: dot("embedding", centroid))
    best = F.array_max(similar) - F.get(similar, F.col("cluster_id")) <= 1e-5 * l2_norm("embedding")
    return assigned.select("id", best.alias("most_similar"))


@register("a4_ivf_search_all_lists")
def a4_all(spark, sf_dir):
    queries = fx.embeddings(spark, sf_dir).select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    return shown(index(spark, sf_dir, "IVF").search(queries, 5, EXHAUSTIVE))


@register("a4_ivf_search")
def a4(spark, sf_dir):
    ivf = index(spark, sf_dir, "IVF")
    return holds(spark, sf_dir, ivf.search(only_queries(fx.workloads(spark, sf_dir)), 10), ivf, NPROBE)


@register("a5_train_pq")
def a5(spark, sf_dir):
    """Whether each codeword is the mean of the residuals that are nearest to it (or has none)."""
    pq = index(spark, sf_dir, "IVFPQ")
    codes = pq.rows(spark).filter("cluster_id >= 0").join(fx.embeddings(spark, sf_dir), "id")
    centroid = F.get(F.lit(pq.centroids.tolist()), F.col("cluster_id"))
    rest = codes.withColumn("rest", F.zip_with(l2_normalize("embedding"), centroid, lambda a, b: a - b))
    width = pq.codebooks.shape[2]
    pieces = F.posexplode(F.transform("code", lambda c, i: F.struct(c.cast("int").alias("code"), F.slice("rest", i * width + 1, width).alias("v"))))
    members = rest.select(pieces.alias("m", "s")).select("m", "s.code", F.posexplode("s.v").alias("pos", "x"))
    means = members.groupBy("m", "code", "pos").agg(F.avg("x").alias("mean"))
    book = spark.read.parquet(f"{pq.path}/codebook")
    words = book.select("m", "code", F.size("subvec").alias("width"), F.posexplode("subvec").alias("pos", "x"))
    off = F.max(F.abs(F.col("x") - F.coalesce("mean", "x")))
    return words.join(means, ["m", "code", "pos"], "left").groupBy("m", "code", "width").agg((off < 0.02).alias("is_mean"))


@register("a6_pq_encode")
def a6(spark, sf_dir):
    pq = index(spark, sf_dir, "IVFPQ")
    codes = pq_encode(fx.embeddings(spark, sf_dir), pq.centroids, pq.codebooks)
    rows = codes.join(fx.embeddings(spark, sf_dir), "id")
    centroid = F.get(F.lit(pq.centroids.tolist()), F.col("cluster_id"))
    rows = rows.withColumn("rest", F.zip_with(l2_normalize("embedding"), centroid, lambda a, b: a - b))
    width, nearest = pq.codebooks.shape[2], F.lit(True)
    for part, words in enumerate(pq.codebooks.tolist()):
        away = F.transform(F.lit(words), partial(l2_sq_distance, F.slice("rest", part * width + 1, width)))
        nearest = nearest & (F.get(away, F.get("code", F.lit(part)).cast("int")) - F.array_min(away) <= 1e-5)
    return rows.select("id", F.size("code").alias("parts"), nearest.alias("nearest_words"))


@register("a7_ivfpq_search")
def a7(spark, sf_dir):
    pq = index(spark, sf_dir, "IVFPQ")
    return holds(spark, sf_dir, pq.search(only_queries(fx.workloads(spark, sf_dir)), 10), pq, NPROBE)


@register("a9_build_or_load")
def a9(spark, sf_dir):
    parts = None
    for kind in ("IVF", "IVFPQ"):
        built = index(spark, sf_dir, kind)
        versions = spark.read.parquet(f"{built.path.rpartition('/')[0]}/versions")
        part = versions.select("kind", "n", "d", "nlist", "m", "bits")
        stored = built.rows(spark).agg(F.count(F.lit(1)).alias("stored"))
        part = part.withColumn("stored", F.lit(stored.first().stored).cast("bigint"))
        parts = part if parts is None else parts.unionAll(part)
    return parts


@register("a10_fewer_than_k")
def a10(spark, sf_dir):
    queries = only_queries(fx.workloads(spark, sf_dir, [1, 5]))
    ivf = index(spark, sf_dir, "IVF")
    hits = ivf.search(queries, ivf.n + 1, EXHAUSTIVE)
    return hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"), F.max("rank").alias("last_rank"))


# --- evaluation ----------------------------------------------------------------------------------


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run times derived from the events: one event is one run of a workload with a strategy."""
    names = F.array(*[F.lit(name) for name in ev.STRATEGIES])
    return fx.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("workload"),
        F.get(names, (F.col("event_id") % 3).cast("int")).alias("strategy"),
        F.col("event_id").alias("run"),
        (F.col("value") / 1000).alias("filter_time"),
        (F.col("value") / 250 + F.col("event_id") % 3).alias("search_time"),
    )


def metric_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recall per workload and strategy, derived from the events as well."""
    share = F.avg(F.when(F.col("filter_time") < 0.01, 1.0).otherwise(0.0))
    return metrics(spark, sf_dir).groupBy("workload", "strategy").agg(share.alias("recall"))


@register("e1_recall")
def e1(spark, sf_dir):
    emb, meta = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir)
    workloads = fx.workloads(spark, sf_dir)
    truth = hybrid.run_workloads(emb, meta, workloads, strategy="prefilter")
    found = hybrid.run_workloads(emb, meta, workloads, strategy="postfilter", oversample=SMALL_OVERSAMPLE)
    result = ev.recall(found, truth, workloads)
    return result.withColumn("recall", rounded("recall"))


@register("e2_average_runs")
def e2(spark, sf_dir):
    averages = ev.average_runs(metrics(spark, sf_dir))
    return averages.withColumns({c: rounded(c) for c in ("filter_time", "search_time", "total_time")})


@register("e3_speedups")
def e3(spark, sf_dir):
    ratios = ev.speedups(ev.average_runs(metrics(spark, sf_dir)))
    return ratios.select("workload", *[rounded(c).alias(c) for c in ratios.columns[1:]])


@register("e4_results_table")
def e4(spark, sf_dir):
    return ev.results_table(ev.average_runs(metrics(spark, sf_dir)), metric_recalls(spark, sf_dir))


@register("e5_compare_filters")
def e5(spark, sf_dir):
    meta = fx.metadata(spark, sf_dir)
    by_sql = filters.filter_where(meta, "nsfw = 'UNLIKELY' and similarity >= 0.035 and original_width >= 500")
    by_columns = filters.filter_by(meta, nsfw="UNLIKELY", similarity_min=0.035, width_min=500)
    return ev.compare_filters(by_sql, by_columns)


@register("e6_work_counters")
def e6(spark, sf_dir):
    emb, meta, ivf = fx.embeddings(spark, sf_dir), stored_metadata(spark, sf_dir), index(spark, sf_dir, "IVF")
    queries, where = only_queries(fx.workloads(spark, sf_dir, [5])), fx.WORKLOADS[4][2]
    searches = {
        "prefilter": partial(hybrid.search_prefilter, emb, meta, queries, where),
        "postfilter": partial(hybrid.search_postfilter, emb, meta, queries, where, oversample=SMALL_OVERSAMPLE),
        "hybrid": partial(hybrid.search_hybrid, emb, meta, queries, where, index=ivf, nprobe=EXHAUSTIVE, threshold=0.0),
    }
    rows = []
    for name, search in searches.items():
        counters = hybrid.WorkCounters()
        search(counters=counters).collect()
        rows.append((name, *counters.as_dict().values()))
    return spark.createDataFrame(rows, "strategy string, rows_filtered bigint, rows_scored bigint, rows_returned bigint")


@register("e_evaluate")
def evaluation(spark, sf_dir):
    """The whole evaluation, five runs, on tables stored once."""
    base = new_scratch_path(spark, "evaluated")
    tables = {"emb": fx.embeddings(spark, sf_dir), "meta": fx.metadata(spark, sf_dir), "workloads": fx.workloads(spark, sf_dir)}
    for name, frame in tables.items():
        frame.write.parquet(f"{base}/{name}")
    measured, recalls = ev.evaluate(*[spark.read.parquet(f"{base}/{name}") for name in tables])
    averages = ev.average_runs(measured)
    rows = ev.results_table(averages, recalls).select("workload", "strategy", "recall")
    runs = averages.groupBy("workload").agg(F.sum("n_runs").alias("n_runs"))
    return rows.join(runs, "workload")
