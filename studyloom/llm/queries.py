"""The registered queries of the corpus operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe_codec,
    decontamination,
    html_extract,
    minhash_dedup,
    packing,
    prefix_trie,
    quality_rules,
    ranked_search,
    secret_scan,
    substring_dedup,
    token_counts,
    token_store,
    vector_dedup,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_digest(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_digest(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_links(_table(spark, sf_dir, "embeddings"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_digest(_table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digest(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES = {
    "op11_decontamination": f"""
with texts as (select row_number() over () as rid, doc_id, {_TERMS} as w from documents),
items as (select item_id, w, least(len(w), 10) as k from (select item_id, {_TERMS} as w from benchmark)),
windows as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as t from (select *, unnest(range(1, len(w) - k + 2)) as i from items where k > 0)),
places as (select rid, i, k, array_to_string(w[i : i + k - 1], ' ') as t
           from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from texts, (select distinct k from windows))),
met as (select distinct rid, i, p.k, item_id from places p join windows v on p.k = v.k and p.t = v.t),
hit as (select rid, count(distinct spot) as n_hit from (select rid, unnest(range(i, i + k)) as spot from met) group by rid),
named as (select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names
          from (select distinct rid, item_id from met where item_id is not null) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from texts left join hit using (rid) left join named using (rid)""",
    "op12_ranked_search": f"""
with held as (select rid, doc_id, term, count(*)::bigint as tf
              from (select rid, doc_id, unnest(w) as term from (select row_number() over () as rid, doc_id, {_TERMS} as w from documents)) group by all),
sizes as (select rid, sum(tf)::bigint as n from held group by rid),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as total from sizes),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as weight from (select term, count(*) as df from held group by term), corpus),
asked as (select distinct asked_row, item_id, term from (select asked_row, item_id, unnest(w) as term from (select row_number() over () as asked_row, item_id, {_TERMS} as w from benchmark))),
scored as (select asked_row, item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::bigint as score
           from asked join held using (term) join weights using (term) join sizes using (rid), corpus group by asked_row, item_id, rid, doc_id)
select item_id, rank, doc_id, score
from (select *, row_number() over (partition by asked_row order by score desc, doc_id)::int as rank from scored where score > 0) where rank <= 50""",
    "op13_prefix_trie": r"""
with recursive bits(i, n, v) as (
  select i, 0, i from range(256) r(i) union all
  select i, n + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where n < 8),
crc as (select list(v order by i) as tbl from bits where n = 8),
turns as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                 row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as spot
          from conversations where conv_id is not null),
convs as (select c, c - ((c % 20) + 20) % 20 as base,
                 xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
                                 lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) % 4 as h
          from (select distinct c from turns), crc),
placed as (select v.c, 0 as own, spot, role, text from convs v join turns t on t.c = v.base where spot <= h union all
         select v.c, 1, spot, role, text from convs v join turns t on t.c = v.c where spot > h),
along as (select c, row_number() over w as depth, string_agg(sha256(role || ':' || sha256(text)), ',') over w as path,
                 len(regexp_extract_all(text, '[^ 	-
]+')) as words
          from placed window w as (partition by c order by own, spot rows unbounded preceding)),
pre as (select c, 0 as depth, '' as path, 0 as words from convs union all select c, depth, path, words from along),
ended as (select c, max(depth) as depth from pre group by c),
ends as (select p.path, string_agg(c::varchar, ',' order by c) as ids from pre p join ended using (c, depth) group by p.path),
parts as (select depth, path, count(*) as n_convs, min(c) as conv_id, max(words) as words from pre group by depth, path),
nodes as (select *, case when depth = 1 then '' when depth > 1 then left(path, len(path) - 65) end as above from parts),
kids as (select above as path, count(*) as n_children from nodes where depth > 0 group by above),
own as (select n.*, coalesce(n_children, 0) as n_children, case when n_children is null then 1 else 0 end as leaf, (n_convs - 1) * words as saved from nodes n left join kids using (path)),
totals as (select a.path, sum(leaf) as n_leaves, sum(saved) as saved_tokens from own o join pre a on a.c = o.conv_id and a.depth <= o.depth group by a.path)
select o.conv_id::bigint as conv_id, o.depth::bigint as depth, up.conv_id::bigint as parent_conv_id, o.n_convs::bigint as n_convs,
       o.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from own o join totals using (path) left join ends using (path) left join nodes up on up.path = o.above""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_substring_dedup,
        op2_quality_rules,
        op3_secret_scan,
        op4_token_store,
        op5_packing,
        op6_token_counts,
        op7_vector_dedup,
        op8_minhash_dedup,
        op9_bpe_codec,
        op10_html_extract,
        op11_decontamination,
        op12_ranked_search,
        op13_prefix_trie,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
