"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import ann, bpe, decontaminate, filter_audit, hard_negatives, html_text, licenses, line_dedup, lm, near_dup, sharding, suffix_dedup, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), form="kept_sha256")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(_table(spark, sf_dir, "documents"))
    known = F.filter("notices", lambda x: x["family"] != "unknown")
    return rows.select("doc_id", "licences", F.size("notices").cast("long").alias("n_notices"), F.size(known).cast("long").alias("n_confirmed"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), VOCABULARY, digests=True)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_md5")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_html_text, op3_suffix_dedup, op4_sharding, op5_licenses, op6_toxicity, op7_bpe, op8_near_duplicates, op9_nearest, op10_lm_score, op11_filter_audit, op12_line_dedup, op13_hard_negatives)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
iw as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, p, p + 9), ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from i where len(w) > 0)
),
sizes as (select distinct n from iw),
dw as (
  select doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)
),
hits as (select dw.doc_id, dw.p, dw.n, iw.item_id from dw join iw on dw.s = iw.s and dw.n = iw.n),
spots as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from (select distinct doc_id, p, n from hits)) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id, cast(item_id as varchar) as x from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spots using (doc_id) left join found using (doc_id)
""",
    "op11_filter_audit": r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
firsts as (select t, min(doc_id) as first from d group by t),
marks as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as bad from labels where doc_id is not null group by doc_id),
m as (
  select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad,
    (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::int
      + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as mask
  from d join firsts using (t) left join marks using (doc_id)
),
cell as (select part, mask, count(*) as n, sum(good) as good, sum(bad) as bad from m group by part, mask),
f as (select chr(65 + i::int) as name, (1 << i)::int as bit from range(0, 5) r(i)),
o as (
  select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
),
s as (select filter_order, step, bits[step] as own, coalesce(list_sum(list_slice(bits, 1, step - 1)), 0)::int as prior from o, range(1, 6) r(step)),
r as (
  select part, filter_order, step, own,
    sum(case when mask & (own | prior) = 0 then n else 0 end) as kept, sum(case when mask & own > 0 and mask & prior = 0 then n else 0 end) as removed,
    sum(case when mask & own > 0 and mask & prior > 0 then n else 0 end) as redundant, sum(case when mask = own then n else 0 end) as unique_fails,
    sum(case when mask & own > 0 and mask & prior = 0 then good else 0 end) as good_lost, sum(case when mask & own > 0 and mask & prior = 0 then bad else 0 end) as toxic_lost
  from cell, s group by part, filter_order, step, own
)
select part, filter_order, cast(step as int) as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from r
""",
    "op12_line_dedup": r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (
  select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line from d)
),
r as (select k, min(doc_id) as first from x where length(k) >= 10 group by k having count(distinct doc_id) > 1),
y as (select x.doc_id, i, line, r.k is not null and x.doc_id <> first as dropped from x left join r using (k))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from y group by doc_id
""",
    "op13_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor_id, v.vec_id, v.label = a.label as same, list_inner_product(a.q, v.q)::bigint as score
  from v a join v on a.vec_id <> v.vec_id and len(a.q) = len(v.q) where a.vec_id % 100 = 0
),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank, vec_id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
)
select * from n where rank <= 10
""",
}
