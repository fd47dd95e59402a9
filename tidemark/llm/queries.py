"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact, infill, language, licenses, neighbours, pii, prefix_trie, quality, simhash, substring, toxicity
from .common import load, small_batches
from .decontaminate import LOWER, UPPER


OP1 = rf"""
with dw as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
ii as (select item_id, w, least(10, len(w)) as n, unnest(range(0, len(w) - least(10, len(w)) + 1)) as i from iw where len(w) > 0),
ig as (select distinct item_id, n, array_to_string(w[i + 1 : i + n], ' ') as s from ii),
dd as (select r, w, n, unnest(range(0, len(w) - n + 1)) as i from dw, (select distinct n from ig) where len(w) >= n),
hits as (select r, i, n, item_id from (select r, i, n, array_to_string(w[i + 1 : i + n], ' ') as s from dd) d join ig using (n, s)),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
its as (select r, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct r, item_id::varchar as s from hits where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos using (r) left join its using (r)"""
OP3 = r"""
with dw as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
ww as (select r, i, array_to_string(w[i + 1 : i + 35], ' ') as s from (select r, w, unnest(range(0, len(w) - 34)) as i from dw where len(w) >= 35)),
rep as (select s from ww group by s having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as p from ww semi join rep using (s)),
words as (select r, unnest(w) as x, unnest(range(0, len(w))) as p from dw),
kept as (select r, string_agg(x, ' ' order by p) as k from words anti join gone using (r, p) group by r),
n as (select r, count(*) as n_removed from gone group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256 from dw left join n using (r) left join kept using (r)"""

#: CRC-32 of a decimal id, a bit at a time: each byte, then eight shifts.
CRC32 = (
    "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, o: case when o >= 0 then xor(a, o) else xor(a >> 1, 3988292384::bigint * (a & 1)) end), 4294967295::bigint)"
)
OP11 = f"""
with t as (select conv_id, turn, length(coalesce(text, '')) as n, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as k from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn is not null, turn, k) as i from t),
c as (select *, conv_id - conv_id % 100 as base from (select conv_id, {CRC32} % 6 as h from (select distinct conv_id from t))),
r as (select c.conv_id, 0 as part, i, k, n from c join o on o.conv_id = c.base and o.i <= c.h union all select c.conv_id, 1, i, k, n from c join o on o.conv_id = c.conv_id and o.i > c.h),
m as (select conv_id, row_number() over w as d, n, string_agg(k, '') over w as key from r window w as (partition by conv_id order by part, i) union all select conv_id, 0, 0, '' from c),
e as (select *, d = max(d) over (partition by conv_id) as ends from m),
v as (select key, d as depth, min(conv_id) as conv_id, count(*) as n_convs, max(n) as n, string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends) as ids from e group by 1, 2),
ch as (select left(key, 64 * (depth - 1)) as key, count(*) as n_children from v where depth > 0 group by 1),
x as (select v.*, coalesce(n_children, 0) as n_children from v left join ch using (key)),
s as (select left(key, 64 * j) as key, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * n)::bigint as saved_tokens from (select *, unnest(range(0, depth + 1)) as j from x) group by 1)
select x.conv_id, x.depth, y.conv_id as parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(coalesce(x.ids, '')) as ends_sha256
from x join s using (key) left join v y on x.depth > 0 and y.depth = x.depth - 1 and y.key = left(x.key, 64 * y.depth)"""
OP12 = """
select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size, coalesce(doc_id = max(doc_id) over t, false) as kept, sha256(coalesce(text, '')) as text_sha256,
  strlen(coalesce(text, '')) as n_bytes from documents window t as (partition by coalesce(text, ''))"""
OP13 = """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
g as (select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as x, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as y, ('0x' || substr(h, 17, 8))::bigint % 100 as p, ('0x' || substr(h, 25, 8))::bigint % 100 as q from d),
f as (select *, least(x, y) as a, greatest(x, y) as b, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or p >= 90 then 'plain' when q < 20 then 'spm' else 'psm' end as form from g)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || t[1 : a] || '<S>' || t[b + 1 :] || '<M>' || t[a + 1 : b] else '<S>' || t[b + 1 :] || '<P>' || t[1 : a] || '<M>' || t[a + 1 : b] end) as output_sha256,
  sha256(t) as restored_sha256 from f"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.bpe_digest(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.simhash_digest(load(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring.dedup_digest(load(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.language_digest(load(spark, sf_dir, "documents"))


def judged(out: DataFrame, least: float) -> DataFrame:
    """doc_id, held_out, score, predicted of a classifier that learns where crc32(doc_id) mod 5 is not 0."""
    held = F.coalesce(language.fold_of("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return judged(quality.quality(docs, labels, language.fold_of("doc_id", 5) != 0), 0.3)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.grammar(docs, labels, language.fold_of("doc_id", 5) != 0)
    return judged(toxicity.scored(docs, model), 0.5)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(load(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    vectors = load(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses_digest(load(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return prefix_trie.trie_nodes(prefix_trie.with_shared_openings(prefix_trie.conversations(load(spark, sf_dir, "conversations"))))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_digest(load(spark, sf_dir, "documents")).drop("n_chunks")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return infill.fim_digest(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_bpe, op3_substring, op4_simhash, op5_language, op6_quality, op7_pii, op8_neighbours, op9_licenses, op10_toxicity, op11_prefix_trie, op12_exact, op13_infill)}


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express at the size of the correctness check; the others are tested against brute force."""
    return {"op1_decontamination": OP1, "op3_substring": OP3, "op11_prefix_trie": OP11, "op12_exact": OP12, "op13_infill": OP13}
