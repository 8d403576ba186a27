"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import backoff_lm, decontaminate, embedding_dedup, filter_audit, merge_replay, mixing, quality, simhash, substring_dedup, suffix_dedup, token_alignment, token_records, warc
from trackloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


@query("op1_token_records")
def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_digest(spark, table(spark, sf_dir, "documents"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_decontaminate", r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as k
        from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from bw where len(w) > 0)),
sizes as (select distinct n from win),
pos as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as k
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
occ as (select pos.doc_id, pos.i, pos.n, win.item_id from pos join win on pos.k = win.k and pos.n = win.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from occ)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as l
        from (select distinct doc_id, cast(item_id as varchar) as s from occ) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hit using (doc_id) left join its using (doc_id)""")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


@query("op4_backoff_scores", r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
t as (select doc_id, i, ws[i] as w, case when i > 1 then ws[i - 1] end as v, case when i > 2 then ws[i - 2] end as u
      from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d)),
c1 as (select w, count(*) as n from t group by w),
c2 as (select v, w, count(*) as n from t where v is not null group by v, w having count(*) >= 2),
c3 as (select u, v, w, count(*) as n from t where u is not null group by u, v, w having count(*) >= 2),
s as (select t.doc_id, case
        when g3.n is not null then log10(g3.n) - log10(h2.n)
        when g2.n is not null then log10(g2.n) - log10(h1.n) + (least(3, i) - 2) * log10(0.4)
        else log10(g1.n) - log10((select count(*) from t)) + (least(3, i) - 1) * log10(0.4) end as s
      from t join c1 g1 on t.w = g1.w left join c2 g2 on t.v = g2.v and t.w = g2.w left join c1 h1 on t.v = h1.w
      left join c3 g3 on t.u = g3.u and t.v = g3.v and t.w = g3.w left join c2 h2 on t.u = h2.v and t.v = h2.w)
select d.doc_id, cast(len(ws) as bigint) as n_words, round(coalesce(sum(s.s), 0), 6) as log10_score, round(sum(s.s) / nullif(len(ws), 0), 6) as mean_log10
from d left join s using (doc_id) group by d.doc_id, ws""")
def op4_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_lm.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log10_score", 6).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


@query("op5_embedding_dedup", """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v),
l as (select a.vec_id as x, b.vec_id as y from u a join u b on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0
      and list_dot_product(a.e, b.e) / a.n / b.n >= 0.9),
reach as (select vec_id as x, vec_id as y from u union select reach.x, l.y from reach join l on reach.y = l.x),
c as (select x as vec_id, min(y) as component_id from reach group by x)
select c.vec_id, (select count(*) from l where l.x = c.vec_id) as n_links, component_id, c.vec_id = component_id as kept from c""")
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_mix_sources")
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op9_warc", r"""
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select html, min(page_id) as first_id from p group by html)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((cast('0x' || substr(sha1(html), 5 * (i // 4) + 1, 5) as integer) >> (15 - 5 * (i % 4))) & 31) + 1, 1) for i in range(32)], '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from p join f using (html)""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digest(spark, table(spark, sf_dir, "pages"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.near_duplicate_passages(table(spark, sf_dir, "documents"))


@query("op11_filter_audit", r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
f as (select doc_id, part, concat(
        case when len(w) < 200 then 'A' else '' end, case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end,
        case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 'C' else '' end,
        case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end,
        case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end) as fails from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
c as (select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by part, fails),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as o from x a, x b, x c, x d, x e
      where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
s as (select o as filter_order, step, o[step] as filter, o[1:step - 1] as before from o, (select unnest(range(1, 6)) as step)),
m as (select part, filter_order, step, filter, n, good, toxic, contains(fails, filter) as failing, translate(before, fails, '') <> before as gone,
        fails = filter as alone from c, s),
r as (select part, filter_order, step, filter,
        sum(case when not gone and not failing then n else 0 end) as kept, sum(case when not gone and failing then n else 0 end) as removed,
        sum(case when gone and failing then n else 0 end) as redundant, sum(case when alone then n else 0 end) as unique_fails,
        sum(case when not gone and failing then good else 0 end) as good_lost, sum(case when not gone and failing then toxic else 0 end) as toxic_lost
      from m group by part, filter_order, step, filter)
select part, filter_order, cast(step as integer) as step, filter, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, filter) as bigint) as shapley from r""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query("op13_merge_replay")
def op13_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge_replay.encode(table(spark, sf_dir, "documents"), decode=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
