"""The registered corpus queries and, where SQL can express them, their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveknn.llm import exact, infill, language, lm_scoring, minhash, mixing, negatives, passages, pieces, repeats, secret_scan, spots, toxicity
from sieveknn.llm.common import LOWER, UPPER, documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.fingerprint_report(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(documents(spark, sf_dir))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle_report(documents(spark, sf_dir))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


CORPUS_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_spotsigs": op4_spotsigs,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_lm_score": op8_lm_score,
    "op9_minhash": op9_minhash,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

_OP6 = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select doc_id, keep_id, group_size, (doc_id is not distinct from keep_id) as kept, sha256(norm) as text_sha256
from t join g using (norm)
"""

_OP9 = rf"""
with recursive t as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end as sh
  from t),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
pairs as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
  from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs where 100 * c >= {minhash.PERCENT} * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(id, r) as (select doc_id, doc_id from documents union select id, b from reach join both_ways on r = a),
lowest as (select id, min(r) as component_id from reach group by id)
select doc_id, len(sh) as n_shingles, component_id, doc_id = component_id as kept from s join lowest on id = doc_id
"""

_OP10 = rf"""
with recursive sized as (
  select doc_id, source, case when source is null then 'null' else '=' || source end as k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens,
         md5('{mixing.SEED}:' || coalesce(doc_id::varchar, 'null')) as place
  from documents),
totals as (select k, sum(n_tokens)::bigint as tokens, count(*) as docs from sized group by k),
lists as (select list(tokens / top::double) as xs, count(*) as n, max(top)::double / min(tokens) as spread
          from totals, (select max(tokens) as top from totals) where tokens > 0),
bisect(i, low, high, mid, xs, n) as (
  select 0, 0::double, 2::double, 1::double, xs, n from lists
  union all
  select i + 1, case when ok then mid else low end, case when ok then high else mid end,
         case when i = 0 and ok then 1 else ((case when ok then mid else low end) + (case when ok then high else mid end)) / 2 end, xs, n
  from (select *, ln(list_sum(list_transform(xs, lambda x: pow(x, mid)))) - mid * list_sum(list_transform(xs, lambda x: pow(x, mid) * ln(x)))
               / list_sum(list_transform(xs, lambda x: pow(x, mid))) >= {mixing.TARGET_ENTROPY} * ln(n) - 1e-12 as ok from bisect)
  where i < 48),
exponent as (select round(least(1, greatest(case when n = 1 then 1 else least(1, low) end,
                    case when spread > 1 then 1 - ln({mixing.MAX_REPETITION}) / ln(spread) else 0 end)), 6) as a
             from (select * from bisect order by i desc limit 1), (select spread from lists)),
plan as (
  select k, tokens, ceil(docs / {float(mixing.BLOCK_DOCS)})::bigint as blocks,
         case when tokens > 0 then round(pow(tokens / top::double, a) / norm, 6) else 0 end as weight,
         case when tokens > 0 then round(pow(tokens / top::double, a - 1), 6) else 1 end as repetition
  from totals, exponent, (select max(tokens) as top from totals),
       (select sum(pow(tokens / top::double, a)) as norm from totals, exponent, (select max(tokens) as top from totals) where tokens > 0)),
cuts as (select *, floor(repetition)::int as passes, floor((repetition - floor(repetition)) * tokens)::bigint as rest from plan),
placed as (
  select s.*, weight, repetition, passes, rest, ('0x' || substr(place, 1, 12))::bigint % blocks as block,
         md5('{mixing.SEED}:' || k || ':' || (('0x' || substr(place, 1, 12))::bigint % blocks)::varchar) as block_place
  from sized s join cuts using (k)),
upto as (select *, sum(n_tokens) over (partition by k order by block_place, place range between unbounded preceding and current row) as upto from placed)
select doc_id, source, n_tokens, weight, repetition, block, passes + case when rest > 0 and upto <= rest then 1 else 0 end as copies from upto
"""

_OP11 = rf"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('{infill.SEED}:' || coalesce(doc_id::varchar, 'null')) as h from documents),
u as (
  select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as u, ('0x' || substr(h, 1, 8))::bigint as h1,
         ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from t),
c as (
  select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= {infill.FIM_PERCENT} then 'plain'
              when h4 % 100 < {infill.SPM_PERCENT} then 'spm' else 'psm' end as form from u),
p as (
  select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256 from p
"""

_OP12 = rf"""
with w as materialized (
  select row_number() over () as rid, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select rid, i, array_to_string(w[i:i + {passages.LENGTH} - 1], ' ') as s
      from (select rid, w, unnest(range(1, len(w) - {passages.LENGTH} + 2)) as i from w)),
d as (select s from g group by s having count(*) > 1),
r as (select distinct rid, unnest(range(i, i + {passages.LENGTH})) as i from g join d using (s)),
k as (select rid, string_agg(x, ' ' order by i) as kept, count(*) as n_kept
      from (select rid, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w) anti join r using (rid, i) group by rid)
select doc_id, len(w)::bigint as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (rid)
"""

_OP13 = f"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor({negatives.SCALE} * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= {negatives.POSITIVES})
select anchor_id, positive_id, row_number() over best :: int as rank, s.id as negative_id, positive_score, s.score as negative_score
from p join s using (anchor_id)
where not same and {negatives.LOW_PERCENT} * positive_score <= 100 * score and 100 * score <= {negatives.HIGH_PERCENT} * positive_score
window best as (partition by anchor_id, positive_id order by s.score desc, s.id)
qualify row_number() over best <= {negatives.NEGATIVES}
"""

CORPUS_ORACLE: dict[str, str] = {
    "op6_exact_dedup": _OP6,
    "op9_minhash": _OP9,
    "op10_mixing": _OP10,
    "op11_fill_in_middle": _OP11,
    "op12_substring_dedup": _OP12,
    "op13_hard_negatives": _OP13,
}
