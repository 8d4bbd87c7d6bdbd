"""Registered queries of the text operators with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm import (exact_dedup, licenses, line_dedup, line_quality, lm, merkle, ordinal, packing, raking, role_repair,
                             simhash, strata, token_file)
from tracewright.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


def op2_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(table(spark, sf_dir, "documents"))


def op3_ordinal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_digest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op5_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mixture(table(spark, sf_dir, "documents"))


def op6_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens. A sequence of 4096 tokens holds at most
    4096 documents and an attention cost of 4096 squared, so these limits never
    cost a sequence here."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, END_ID)


def op7_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repair(table(spark, sf_dir, "conversations"))


def op8_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths: they are placed in a tree by source and id, and one with a
    licence statement in its first three lines stands for the licence file of its folder."""
    return licenses.scan_files(licenses.document_paths(table(spark, sf_dir, "documents")), F.col("line") < 3)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, END_ID)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering: A-Z in lower case where 3 divides the CRC-32 of the id."""
    return merkle.audit(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op12_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.search(strata.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {"op1_line_frequency": op1_line_frequency, "op2_trie_scores": op2_trie_scores,
           "op3_ordinal_severity": op3_ordinal_severity,
           "op4_digest_runs": op4_digest_runs,
           "op5_raked_mixture": op5_raked_mixture, "op6_vector_best_fit": op6_vector_best_fit,
           "op7_role_repair": op7_role_repair, "op8_ball_hashing": op8_ball_hashing, "op9_licence_scan": op9_licence_scan,
           "op10_token_files": op10_token_files, "op11_merkle_manifest": op11_merkle_manifest,
           "op12_stratified_search": op12_stratified_search, "op13_line_dedup": op13_line_dedup}
ORACLE = {
    "op1_line_frequency": r"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
split as (select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
                 [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as l from d),
pos as (select doc_id, w, unnest(range(1, len(w) - 6)) as p from split where len(w) >= 8),
windows as (select doc_id, p, array_to_string(w[p:p + 7], ' ') as k from pos),
twice as (select doc_id, p, count(*) over (partition by doc_id, k) as n from windows),
covered as (select doc_id, count(distinct q) as n_repeat_words
            from (select doc_id, unnest(range(p, p + 8)) as q from twice where n > 1) group by doc_id),
ln as (select doc_id, source, text, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) as words,
              lower(trim(regexp_replace(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'))) as k
       from (select doc_id, source, text, unnest(l) as s from split)),
line_docs as (select source, k, count(distinct text) as n from ln group by all),
hosts as (select source, count(distinct text) as hd from ln group by all),
lost as (select ln.doc_id, sum(words) as removed_words
         from ln join line_docs f on f.source is not distinct from ln.source and f.k = ln.k
                 join hosts h on h.source is not distinct from ln.source
         where f.n > 20 and f.n > 0.005 * hd group by ln.doc_id),
m as (select doc_id, cast(len(w) as bigint) as n_words,
             cast(length(array_to_string(w, '')) as bigint) as word_chars,
             cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
             cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
             cast(coalesce(removed_words, 0) as bigint) as removed_words
      from split left join covered using (doc_id) left join lost using (doc_id)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select *, not base_failed and (n_words - removed_words) >= 0.2 * n_words as kept from j""",
    "op4_digest_runs": """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))""",
    "op11_merkle_manifest": r"""
with recursive d as (
  select doc_id, coalesce('=' || lang, '') as key, source, lang, n_chars, text,
         xor(4294967295, list_reduce(list_concat([4294967295], flatten([[cast(ascii(s) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]
             for s in string_split(cast(doc_id as varchar), '')])),
           lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc
  from documents),
coded as (
  select doc_id, key, crc, coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-')
         || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
         || coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-') as head, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from d),
leaves as (
  select doc_id, key, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
         case when crc % 3 = 0 then sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) end as changed from coded),
placed as (select *, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as i from leaves),
numbered as (select row_number() over (order by key, i) as r, * from placed),
tree as (
  select key, 0 as k, i, leaf as h, count(*) over (partition by key) as m from placed
  union all
  select key, k + 1, i // 8, sha256(string_agg(h, '' order by i)), (any_value(m) + 7) // 8 from tree where m > 1 group by key, k, i // 8),
subroots as (select key, h as subroot, row_number() over (order by key) - 1 as i from tree where m = 1),
upper_tree as (
  select 0 as k, i, subroot as h, count(*) over () as m from subroots
  union all
  select k + 1, i // 8, sha256(string_agg(h, '' order by i)), (any_value(m) + 7) // 8 from upper_tree where m > 1 group by k, i // 8),
runs as (
  select key, k, i // 8 as run, list(h order by i) as hs, any_value(m) as m from tree where m > 1 group by all
  union all
  select null, k, i // 8, list(h order by i), any_value(m) from upper_tree where m > 1 group by k, i // 8),
walk as (
  select p.r, p.key, cast(0 as bigint) as level, p.i, coalesce(changed, leaf) as h, '' as proof, 0 as k, false as top,
         s.i as place from numbered p join subroots s using (key)
  union all
  select r, w.key, level + 1, case when hs is null then place else w.i // 8 end,
         case when hs is null then w.h else sha256(array_to_string(list_concat(hs[:w.i % 8], [w.h], hs[w.i % 8 + 2:]), '')) end,
         case when hs is null then proof else proof || array_to_string(list_concat(hs[:w.i % 8], hs[w.i % 8 + 2:]), '') end,
         case when hs is null then 0 else w.k + 1 end, top or hs is null, place
  from walk w left join runs u on u.k = w.k and u.run = w.i // 8 and u.key is not distinct from (case when top then null else w.key end)
  where not (top and hs is null)),
last as (select *, row_number() over (partition by r order by level desc) as back from walk)
select doc_id, leaf, subroot, (select h from upper_tree where m = 1) as root, sha256(l.proof) as proof_sha256,
       l.h as folded_root, l.h = (select h from upper_tree where m = 1) as verified
from numbered n join last l on l.r = n.r and l.back = 1 join subroots s on s.key = n.key""",
    "op12_stratified_search": r"""
with w as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
d as (select doc_id, r, ts, cast(len(ts) as bigint) as n from w where len(ts) > 0),
size as (select count(*) as nn, cast(sum(n) as bigint) as ll from d),
m as (select r, doc_id, 75 + (25 * n * nn) // ll as m from d, size),
post as (select r, term, count(*) as tf from (select r, unnest(ts) as term from d) group by r, term),
df as (select term, count(*) as df from post group by term),
q as (select item_id, term, count(*) as q from (
        select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select distinct item_id, text from benchmark)) group by all),
weights as (select item_id, term, q * cast(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) as bigint) as weight
            from q join df using (term), size),
scored as (select item_id, m.doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
           from weights join post using (term) join m using (r) group by item_id, r, m.doc_id),
best as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
         from scored where score > 0)
select * from best where rank <= 20""",
    "op13_line_dedup": r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as s, unnest(range(len(ls))) as p from d),
k as (select *, translate(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
j as (select *, length(key) >= 10 and doc_id > min(doc_id) over (partition by key) as lost from k)
select doc_id, count(*) as n_lines, cast(count(*) filter (where lost) as bigint) as n_dropped,
       sha256(coalesce(string_agg(s, chr(10) order by p) filter (where not lost), '')) as kept_sha256
from j group by r, doc_id""",
}
