"""The registered queries of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table

SHARDS = [f"shard-{k:02d}" for k in range(64)]


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import vector_groups

    return vector_groups(table(spark, sf_dir, "embeddings"))


def byte_codec():
    import public_tokenizers

    from .bpe import Codec

    return Codec.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), byte_codec())


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import Tokenizer, token_counts

    cache = spark.conf.get("spark.groundwork.tokens.cache", None)  # a folder that runs share; unset: a new one
    return token_counts(table(spark, sf_dir, "documents"), Tokenizer(public_tokenizers.path("byte_bpe_50k.json")), cache)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymised, secret_key

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality(docs, table(spark, sf_dir, "labels"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .host_rules import host_rules

    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return host_rules(table(spark, sf_dir, "documents")).select(*cols)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op10_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place

    return place(table(spark, sf_dir, "documents"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_vector_dedup": op1_vector_dedup,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_pii_surrogates": op5_pii_surrogates,
        "op6_quality_model": op6_quality_model,
        "op7_host_rules": op7_host_rules,
        "op8_source_mix": op8_source_mix,
        "op9_toxicity": op9_toxicity,
        "op10_shard_lookup": op10_shard_lookup,
        "pipeline": pipeline,
    }


OP7_SQL = r"""
with t as (select doc_id, coalesce(source, chr(1)) as host, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
grams as (select doc_id, text, unnest(range(1, len(w) - 3)) as i, w from lines where len(w) >= 5),
keyed as (select doc_id, text, i, list_slice(w, i, i + 4) as g from grams),
rep as (select doc_id, text, i from (select *, count(*) over (partition by doc_id, text, g) as c from keyed) where c > 1),
cov as (select doc_id, text, count(distinct p) as n from (select doc_id, text, unnest(range(i, i + 5)) as p from rep) group by doc_id, text),
m as (select lines.doc_id, host, len(w)::bigint as n_words,
    length(regexp_replace(lines.text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(lines.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
  from lines left join cov on lines.doc_id = cov.doc_id and lines.text = cov.text),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
h as (select host, count(*)::double as n, count(*) filter (base_failed)::double as f from b group by host),
s as (select greatest(least(sum(f) / sum(n), 1 - 1e-6), 1e-6) as m, sum(n) as n, sum(f * f / n) as ff, count(*) as k from h),
v as (select *, (greatest(ff - n * m * m, 0) - (k - 1) * m * (1 - m)) / greatest(n, 1) as between_ from s),
p as (select m, case when between_ <= 0 then 1e4 else least(greatest(m * (1 - m) / between_ - 1, 1.0), 1e4) end as weight from v)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and (h.f + m * weight) / (h.n + weight) <= 0.5 as kept
from b join h on b.host = h.host cross join p
"""

OP8_SQL = r"""
with d as (select doc_id, case when source is null then 'b' else 'a' || source end as src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s0 as (select src, sum(size)::bigint as source_size, count(*)::bigint as docs from d group by src),
s1 as (select *, [3, 1, 2][((row_number() over (order by src) - 1) % 3 + 1)::int]::hugeint as w, source_size::hugeint * 2 as most from s0),
s2 as (select *, sum(source_size) over ()::hugeint * 150 as total150, sum(w) over () as all_w,
    coalesce(sum(most) over (order by most / w, src rows between unbounded preceding and 1 preceding), 0)::hugeint as before,
    coalesce(sum(w) over (order by most / w, src rows between unbounded preceding and 1 preceding), 0)::hugeint as w_before from s1),
s3 as (select *, most * 100 * (all_w - w_before) <= (total150 - before * 100) * w as full_ from s2),
s4 as (select *, sum(case when full_ then 0 else w end) over () as kept_w,
    (total150 - sum(case when full_ then most * 100 else 0 end) over ())::hugeint as rest from s3),
s5 as (select src, source_size, docs, case when full_ then most::double else (w * rest)::double / (100.0 * kept_w)::double end as target from s4),
s6 as (select *, floor(sum(target) over () / 32 + 0.5)::bigint as h, count(*) filter (target > 0) over () as n, sum(target) over () as v from s5),
q1 as (select src, target, h, unnest(range(1, floor(target * (2 * h + n) / (2 * v))::bigint + 3)) as k from s6 where target > 0),
w1 as (select src, count(*) as blocks from (select *, row_number() over (order by target / (2 * k - 1) desc, src, k) as r from q1) where r <= h group by src),
s7 as (select s6.*, coalesce(blocks, 0)::bigint as blocks, ceil(docs / greatest(512, floor(sqrt(docs))))::bigint as parts from s6 left join w1 using (src)),
r as (select d.*, md5('42:' || coalesce(doc_id::varchar, 'null')) as key from d),
r2 as (select r.*, ('0x' || substr(key, 1, 15))::bigint % parts as part from r join s7 using (src)),
p0 as (select src, part, sum(size)::bigint as part_size from r2 group by src, part),
p1 as (select p0.*, s7.blocks as h, count(*) filter (part_size > 0) over (partition by src) as n, sum(part_size) over (partition by src)::double as v from p0 join s7 using (src)),
q2 as (select src, part, h, part_size, unnest(range(1, floor(part_size * (2.0 * h + n) / (2 * v))::bigint + 3)) as k from p1 where part_size > 0),
w2 as (select src, part, count(*) as quota from (select *, row_number() over (partition by src order by part_size::double / (2 * k - 1) desc, part, k) as rn from q2) where rn <= h group by src, part),
p2 as (select p1.src, p1.part, part_size, least(coalesce(quota, 0) * 32, part_size * 2)::bigint as words from p1 left join w2 using (src, part)),
c as (select r2.*, coalesce(sum(size) over (partition by src, part order by key, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from r2)
select doc_id, size, source_size, target,
    (case when part_size > 0 then (words // part_size) * size + least(greatest(words % part_size - before, 0), size) else 0 end)::bigint as taken
from c join p2 using (src, part) join s7 using (src)
"""


def _op10_sql() -> str:
    """The filled table goes in as text; the tests hold the filling against a plain one."""
    from .sharding import lookup_table, prime_from

    slots = prime_from(100 * len(SHARDS))
    return rf"""
select doc_id, slot, string_split('{",".join(lookup_table(SHARDS, slots))}', ',')[slot + 1] as shard from (
  select doc_id, ('0x' || substr(md5(case when doc_id is null then 'n' else 'k' || doc_id end), 1, 15))::bigint % {slots} as slot from documents)
"""


OP1_SQL = r"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) as (select vec_id, vec_id from v union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from p group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.component_id, vec_id)::bigint as component_id, vec_id = coalesce(c.component_id, vec_id) as kept
from embeddings left join c on vec_id = c.a left join n on vec_id = n.a
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_vector_dedup": OP1_SQL, "op7_host_rules": OP7_SQL, "op8_source_mix": OP8_SQL, "op10_shard_lookup": _op10_sql()}
