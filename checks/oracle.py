"""The SQL each registered query is compared with; the given tables are views of the same names."""

from __future__ import annotations

from sieveknn.fixtures import ITEMS_SQL, WORKLOADS

from .queries import CLAUSES, SMALL_OVERSAMPLE

ITEMS = "items AS (" + ITEMS_SQL.format(embeddings="embeddings", orders="orders", events="events", labels="labels") + ")"

VEC = """vec AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings)"""

_MEMBERS = ", ".join(f"({qid}, {vector_id})" for qid, vector_ids, _ in WORKLOADS for vector_id in vector_ids)
# queries pooled from stored vectors: (qid, q, qn)
POOLED = f"""members(qid, vid) AS (VALUES {_MEMBERS}),
parts AS (
  SELECT qid, i, avg(v[i] / n) AS x
  FROM (SELECT qid, v, n, unnest(generate_series(1, len(v))) AS i FROM members JOIN vec ON vec.id = vid)
  GROUP BY qid, i),
pooled AS (SELECT CAST(qid AS BIGINT) AS qid, list(x ORDER BY i) AS q FROM parts GROUP BY qid),
queries AS (SELECT qid, q, sqrt(list_dot_product(q, q)) AS qn FROM pooled)"""

# every (query, vector) pair with its distance and the query's global rank
SCORED = """scored AS (SELECT qid, id, round(1.0 - list_dot_product(v, q) / (n * qn), 12) AS dist FROM queries, vec),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS place FROM scored)"""

# stored vector 123 as the only query
Q123 = "q123 AS (SELECT v AS q, n AS qn FROM vec WHERE id = 123)"


def rnd(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


HITS = f"SELECT qid, CAST(rank AS INTEGER) AS rank, id, {rnd('dist')} AS dist FROM hits WHERE rank <= 10"


def matching(clauses: list[tuple[int, str]]) -> str:
    """(qid, id) of the items that satisfy each query's own clause."""
    parts = [f"SELECT CAST({qid} AS BIGINT) AS qid, id FROM items WHERE {where}" for qid, where in clauses]
    return "matching AS (" + " UNION ALL ".join(parts) + ")"


def filtered_hits(clauses: list[tuple[int, str]], among: str = "") -> str:
    """The ten nearest matching items of each query, optionally only among its nearest ``among``."""
    return f"""WITH {ITEMS}, {VEC}, {POOLED}, {SCORED}, {matching(clauses)},
hits AS (
  SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank
  FROM ranked JOIN matching USING (qid, id) {among})
{HITS}"""


def all_hold(clauses: list[tuple[int, str]]) -> str:
    """A row for each hit that there must be when all lists are searched."""
    return f"""WITH {ITEMS}, {matching(clauses)}, counts AS (SELECT qid, count(*) AS n FROM matching GROUP BY qid)
SELECT qid, CAST(r AS INTEGER) AS rank, true AS holds FROM counts, range(1, 11) AS t(r) WHERE r <= n"""


def bytes_of(key: str, source: str) -> str:
    """How often each byte value occurs in the texts of a key."""
    return f"""WITH texts AS (SELECT {key}, hex(encode(html)) AS h FROM ({source})),
codes AS (SELECT {key}, substr(h, 2 * unnest(range(0, length(h) // 2)) + 1, 2) AS code FROM texts),
counts AS (SELECT {key}, CAST(('0x' || code) AS INTEGER) AS pos, count(*) AS n FROM codes GROUP BY ALL),
cells AS (SELECT DISTINCT {key}, CAST(i AS INTEGER) AS pos FROM texts, range(0, 256) AS r(i))
SELECT {key}, pos, CAST(coalesce(n, 0) AS DOUBLE) AS x FROM cells LEFT JOIN counts USING ({key}, pos)"""


OWN = [(qid, where) for qid, _, where in WORKLOADS]

METRICS = """metrics AS (
  SELECT user_id % 8 AS workload,
         CASE event_id % 3 WHEN 0 THEN 'prefilter' WHEN 1 THEN 'postfilter' ELSE 'hybrid' END AS strategy,
         value / 1000 AS filter_time, value / 250 + event_id % 3 AS search_time
  FROM events)"""
AVERAGES = """averages AS (
  SELECT workload, strategy, count(*) AS n_runs, avg(filter_time) AS filter_time, avg(search_time) AS search_time,
         avg(filter_time) + avg(search_time) AS total_time
  FROM metrics GROUP BY workload, strategy)"""
RESULTS = f"""WITH {METRICS}, {AVERAGES},
recalls AS (
  SELECT workload, strategy, avg(CASE WHEN filter_time < 0.01 THEN 1.0 ELSE 0.0 END) AS recall
  FROM metrics GROUP BY workload, strategy)
SELECT workload,
       CASE strategy WHEN 'prefilter' THEN 'Prefilter' WHEN 'postfilter' THEN 'Postfilter' ELSE 'Hybrid' END AS strategy,
       round(filter_time, 4) AS filter_time, round(search_time, 4) AS search_time,
       round(total_time, 4) AS total_time,
       round(CASE WHEN strategy = 'prefilter' THEN 1.0 ELSE recall END, 4) AS recall
FROM averages JOIN recalls USING (workload, strategy)"""

KNN_GRAPH = f"""WITH {VEC},
scored AS (SELECT a.id AS qid, b.id AS id, round(1.0 - list_dot_product(b.v, a.v) / (b.n * a.n), 12) AS dist FROM vec a, vec b),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM scored)
SELECT qid, CAST(rank AS INTEGER) AS rank, id, {rnd('dist')} AS dist FROM hits WHERE rank <= 5"""


def nearest_to_123(k: int) -> str:
    return f"""WITH {VEC}, {Q123},
scored AS (SELECT id, round(1.0 - list_dot_product(v, q) / (n * qn), 12) AS dist FROM vec, q123)
SELECT id, {rnd('dist')} AS dist FROM (SELECT * FROM scored ORDER BY dist, id LIMIT {k})"""


def exploded(source: str, key: str) -> str:
    """One row per element of ``(key, v)``."""
    return f"""SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, {rnd('v[i]')} AS x
FROM (SELECT {key}, v, unnest(generate_series(1, len(v))) AS i FROM {source})"""


ORACLE: dict[str, str] = {
    name: f"WITH {ITEMS} SELECT id FROM items WHERE {where.replace('`', chr(34))}" for name, where in CLAUSES.items()
}

ORACLE.update(
    {
        "s1_read_metadata": "SELECT * FROM customer",
        "s2_describe": f"""WITH {ITEMS}
SELECT name, type, (SELECT count(*) FROM items) AS n_rows
FROM (VALUES ('id', 'bigint'), ('embedding', 'array<float>'), ('label', 'int'), ('NSFW', 'string'),
  ('LICENSE', 'string'), ('similarity', 'double'), ('original_width', 'bigint'), ('original_height', 'bigint'),
  ('kind', 'string'), ('caption', 'string')) AS t(name, type)""",
        "s3_row_count": "SELECT count(*) AS n_rows FROM lineitem",
        "s4_with_global_id": """SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, event_id, event_type, value
FROM events""",
        "s5_read_npy": f"WITH {VEC} " + exploded("vec", "id"),
        "s6_write_metadata": f"""WITH {ITEMS}
SELECT id, label, NSFW, LICENSE, similarity, original_width, original_height FROM items""",
        "s7_read_embeddings": f"WITH {VEC} " + exploded("vec", "id"),
        "s8_check_alignment": """SELECT (SELECT count(*) FROM orders) AS n_meta, (SELECT count(*) FROM embeddings) AS n_emb,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT vec_id FROM embeddings)) AS only_meta,
  (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT o_orderkey FROM orders)) AS only_emb,
  (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS n_bad_dim""",
        "s9_write_report": RESULTS,
        "f7_approx_eq": """SELECT * FROM (
  SELECT l_orderkey, l_linenumber, l_discount * 3 AS a, l_discount + l_discount + l_tax AS b,
         l_partkey AS p, l_suppkey AS s FROM lineitem)
WHERE abs(a - b) <= 1e-9 + 1e-9 * abs(b) OR p = s""",
        "f13_filter_by": f"""WITH {ITEMS}
SELECT id FROM items WHERE NSFW = 'UNLIKELY' AND similarity >= 0.035 AND original_width >= 500""",
        "f13_filter_by_nothing": f"WITH {ITEMS} SELECT id FROM items WHERE false",
        "f14_conjunct_profile": f"""WITH {ITEMS}
SELECT 'NSFW = ''UNLIKELY''' AS predicate, count(*) FILTER (WHERE NSFW = 'UNLIKELY') AS n_rows FROM items
UNION ALL SELECT 'similarity >= 0.35', count(*) FILTER (WHERE similarity >= 0.35) FROM items
UNION ALL SELECT 'original_width >= 500', count(*) FILTER (WHERE original_width >= 500) FROM items""",
        "f15_rows_with_license": f"WITH {ITEMS} SELECT id FROM items WHERE LICENSE = 'CC-BY'",
        "f16_distinct_values": f"WITH {ITEMS} SELECT DISTINCT LICENSE FROM items WHERE LICENSE IS NOT NULL",
        "f17_fetch_rows": f"""WITH {ITEMS}, {VEC}, {POOLED}, {SCORED}
SELECT qid, CAST(place AS INTEGER) AS rank, id, {rnd('dist')} AS dist, caption, NSFW, similarity, original_width
FROM ranked JOIN items USING (id) WHERE place <= 10""",
        "f18_selectivity": f"""WITH {ITEMS}
SELECT count(*) FILTER (WHERE original_width > 1024 AND original_height > 1024) AS n_filtered, count(*) AS n_total,
  {rnd('count(*) FILTER (WHERE original_width > 1024 AND original_height > 1024) / count(*)')} AS selectivity
FROM items""",
        "f19_null_as_zero": f"WITH {ITEMS} SELECT id FROM items WHERE coalesce(similarity, 0) <= 0.01",
        "v1_l2_normalize": f"""WITH {VEC},
scaled AS (SELECT id, list_transform(v, lambda x: x * (label + 2)) AS w FROM vec),
unit AS (SELECT id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM scaled)
"""
        + exploded("unit", "id").replace("SELECT id, CAST", "SELECT id, CAST"),
        "v2_dot": f"""WITH {VEC}, {Q123}
SELECT id, {rnd('list_dot_product(v, q) / qn')} AS dot, {rnd('list_dot_product(v, q) / (n * qn)')} AS cosine,
       {rnd('n')} AS norm FROM vec, q123""",
        "v3_cosine_distance": f"""WITH {VEC}, {Q123}
SELECT id, {rnd('1.0 - list_dot_product(v, q) / (n * qn)')} AS dist FROM vec, q123""",
        "v4_l2_sq_distance": f"""WITH {VEC}, {Q123}
SELECT id, {rnd('2.0 - 2.0 * list_dot_product(v, q) / (n * qn)')} AS dist FROM vec, q123""",
        "v5_pool_query": f"""WITH {VEC},
parts AS (
  SELECT label, i, avg(v[i] / n) AS x
  FROM (SELECT label, v, n, unnest(generate_series(1, len(v))) AS i FROM vec) GROUP BY label, i),
pooled AS (SELECT CAST(label AS BIGINT) AS qid, list(x ORDER BY i) AS q FROM parts GROUP BY label),
unit AS (SELECT qid, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS v FROM pooled)
"""
        + exploded("unit", "qid"),
        "v6_query_by_id": f"""WITH {VEC},
unit AS (SELECT id AS qid, list_transform(v, lambda x: x / n) AS v FROM vec WHERE id = 123)
"""
        + exploded("unit", "qid"),
        "v7_encode_text": """SELECT doc_id, CAST(i AS INTEGER) AS pos,
  CAST(length(text) - length(replace(text, chr(CAST(97 + i AS INTEGER)), '')) AS DOUBLE) AS x
FROM documents, generate_series(0, 25) AS letters(i)""",
        "v8_encode_images": bytes_of("page_id", "SELECT page_id, html FROM pages"),
        # a file holds its pages with a line feed behind each
        "v8_encode_image_files": bytes_of("part", "SELECT page_id % 100 AS part, html || chr(10) AS html FROM pages"),
        "v9_encode_workloads": f"""WITH texts AS (
  SELECT doc_id AS qid, text AS t, 0 AS k FROM documents JOIN pages ON page_id = doc_id
  UNION ALL SELECT doc_id, html, 1 FROM documents JOIN pages ON page_id = doc_id),
parts AS (
  SELECT qid, k, i, CAST(length(t) - length(replace(t, chr(CAST(97 + i AS INTEGER)), '')) AS DOUBLE) AS x
  FROM texts, generate_series(0, 25) AS letters(i)),
lengths AS (SELECT qid, k, sqrt(sum(x * x)) AS n FROM parts GROUP BY qid, k),
means AS (SELECT qid, i, avg(CASE WHEN n = 0 THEN 0.0 ELSE x / n END) AS x FROM parts JOIN lengths USING (qid, k) GROUP BY qid, i),
whole AS (SELECT qid, sqrt(sum(x * x)) AS n FROM means GROUP BY qid)
SELECT qid, CAST(i AS INTEGER) AS pos, {rnd('CASE WHEN n = 0 THEN 0.0 ELSE x / n END')} AS x FROM means JOIN whole USING (qid)""",
        "k1_knn": nearest_to_123(10),
        "k2_knn_partial_merge": nearest_to_123(200),
        "k3_knn_batch": KNN_GRAPH,
        "k4_rank_all": f"""WITH {ITEMS}, {VEC}, {Q123},
scored AS (SELECT id, round(2.0 - 2.0 * list_dot_product(v, q) / (n * qn), 12) AS dist FROM vec, q123)
SELECT row_number() OVER (ORDER BY dist, id) AS rank, id, {rnd('dist')} AS dist, caption
FROM scored JOIN items USING (id)""",
        "h1_prefilter": filtered_hits([OWN[4]]),
        "h2_postfilter": filtered_hits(OWN, f"WHERE place <= {SMALL_OVERSAMPLE * 10}"),
        "h2_postfilter_full": filtered_hits([OWN[3]], "WHERE place <= 20000"),
        "h3_hybrid": filtered_hits(OWN),
        "h3_hybrid_ivf_all_lists": filtered_hits(OWN),
        "h4_filter_candidates": filtered_hits(
            [(qid, "original_width >= 1024") for qid, _ in OWN], "WHERE place <= 40"
        ),
        "h5_ann_postfilter_rerank": filtered_hits([(qid, "license is NULL") for qid, _ in OWN], "WHERE place <= 20000"),
        "h6_prefilter_branch": filtered_hits([OWN[2]]),
        "h7_plan_info": f"WITH {ITEMS}, {matching(OWN)}, total AS (SELECT count(*) AS n FROM items), "
        + "ids AS (SELECT * FROM (VALUES "
        + ", ".join(f"({qid})" for qid, _ in OWN)
        + ") AS t(qid)), "
        + f"""counts AS (SELECT CAST(ids.qid AS BIGINT) AS qid, count(id) AS m FROM ids LEFT JOIN matching USING (qid) GROUP BY ids.qid)
SELECT qid, n AS n_total, m AS n_filtered, {rnd('m / n')} AS selectivity,
  CASE WHEN m = 0 THEN 'none' WHEN m / n < 0.1 THEN 'pre-filtering' ELSE 'post-filtering' END AS strategy
FROM counts, total""",
        "h8_run_workloads": filtered_hits(OWN),
        "a1_train_sample": """SELECT least(100, count(*)) AS n_rows, least(100, count(*)) AS n_ids FROM embeddings""",
        "a2_train_ivf": """SELECT CAST(i AS INTEGER) AS cluster_id, 64 AS d, CAST(1.0 AS DOUBLE) AS norm
FROM (SELECT unnest(generate_series(0, CAST(floor(sqrt(count(*))) AS BIGINT) - 1)) AS i FROM embeddings)""",
        "a3_assign_clusters": "SELECT vec_id AS id, true AS most_similar FROM embeddings",
        "a4_ivf_search_all_lists": KNN_GRAPH,
        "a5_train_pq": """SELECT CAST(m AS INTEGER) AS m, CAST(c AS INTEGER) AS code, 8 AS width, true AS is_mean
FROM range(0, 8) AS a(m), range(0, 16) AS b(c)""",
        "a6_pq_encode": "SELECT vec_id AS id, 8 AS parts, true AS nearest_words FROM embeddings",
        # approximate searches: each hit is right, whatever the index found
        **dict.fromkeys(
            ("a4_ivf_search", "a7_ivfpq_search"),
            "SELECT CAST(q AS BIGINT) AS qid, CAST(r AS INTEGER) AS rank, true AS holds FROM range(1, 6) AS a(q), range(1, 11) AS b(r)",
        ),
        **dict.fromkeys(("h3_hybrid_ivfpq", "h8_run_workloads_ivfpq"), all_hold(OWN)),
        "h5_ann_postfilter": all_hold([(qid, "license is NULL") for qid, _ in OWN]),
        "h5_ann_postfilter_ivf": filtered_hits([(qid, "license is NULL") for qid, _ in OWN], f"WHERE place <= {SMALL_OVERSAMPLE * 10}"),
        "a9_build_or_load": """SELECT kind, count(*) AS n, 64 AS d, CAST(floor(sqrt(count(*))) AS INTEGER) AS nlist,
  m, bits, count(*) AS stored
FROM embeddings, (VALUES ('IVF', 0, 0), ('IVFPQ', 8, 4)) AS t(kind, m, bits) GROUP BY kind, m, bits""",
        "a10_fewer_than_k": """SELECT CAST(qid AS BIGINT) AS qid, count(*) AS n_hits, CAST(count(*) AS INTEGER) AS last_rank
FROM embeddings, (VALUES (1), (5)) AS t(qid) GROUP BY qid""",
        "e1_recall": f"""WITH {ITEMS}, {VEC}, {POOLED}, {SCORED}, {matching(OWN)},
kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM ranked JOIN matching USING (qid, id)),
counts AS (
  SELECT queries.qid, count(id) FILTER (WHERE rank <= 10) AS n_truth,
         count(id) FILTER (WHERE rank <= 10 AND place <= {SMALL_OVERSAMPLE * 10}) AS n_found
  FROM queries LEFT JOIN kept ON kept.qid = queries.qid GROUP BY queries.qid)
SELECT qid, n_found, n_truth, n_found AS n_common,
  {rnd('CASE WHEN n_truth > 0 THEN n_found / n_truth WHEN n_found = 0 THEN 1.0 ELSE 0.0 END')} AS recall
FROM counts""",
        "e2_average_runs": f"""WITH {METRICS}, {AVERAGES}
SELECT workload, strategy, n_runs, {rnd('filter_time')} AS filter_time, {rnd('search_time')} AS search_time,
  {rnd('total_time')} AS total_time FROM averages""",
        "e3_speedups": f"""WITH {METRICS}, {AVERAGES}, wide AS (
  SELECT workload, max(total_time) FILTER (WHERE strategy = 'prefilter') AS pre,
    max(total_time) FILTER (WHERE strategy = 'postfilter') AS post,
    max(total_time) FILTER (WHERE strategy = 'hybrid') AS hyb FROM averages GROUP BY workload)
SELECT workload, {rnd('post / nullif(pre, 0)')} AS post_over_pre, {rnd('pre / nullif(hyb, 0)')} AS pre_over_hybrid,
  {rnd('post / nullif(hyb, 0)')} AS post_over_hybrid FROM wide""",
        "e4_results_table": RESULTS,
        # exact search on both branches, so every strategy finds what the pre-filter finds
        "e_evaluate": """SELECT CAST(q AS BIGINT) AS workload, s AS strategy, CAST(1.0 AS DOUBLE) AS recall, CAST(15 AS BIGINT) AS n_runs
FROM range(1, 6) AS a(q), (VALUES ('Prefilter'), ('Postfilter'), ('Hybrid')) AS b(s)""",
        "e5_compare_filters": f"""WITH {ITEMS}, kept AS (
  SELECT id FROM items WHERE NSFW = 'UNLIKELY' AND similarity >= 0.035 AND original_width >= 500)
SELECT count(*) AS n_a, count(*) AS n_b, CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b FROM kept""",
        "e6_work_counters": f"""WITH {ITEMS}, {VEC}, {POOLED}, {SCORED}, {matching([OWN[4]])},
kept AS (SELECT place FROM ranked JOIN matching USING (qid, id) ORDER BY place LIMIT 10)
SELECT s AS strategy, (SELECT count(*) FROM matching) AS rows_filtered, (SELECT count(*) FROM matching) AS rows_scored,
  (SELECT count(*) FROM kept WHERE s <> 'postfilter' OR place <= {SMALL_OVERSAMPLE * 10}) AS rows_returned
FROM (VALUES ('prefilter'), ('postfilter'), ('hybrid')) AS t(s)""",
    }
)
