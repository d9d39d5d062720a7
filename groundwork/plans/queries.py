"""Queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields, jsontext, text as X
from ..operators import binding, dedup, evidence, guards, intervals, rank, reports, rewrites, segment
from ..sources import html, store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf):
    return _t(spark, sf, "documents")


# Normal forms and other projections


@query("norm_compare", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as norm from documents")
def norm_compare(spark, sf):
    return _docs(spark, sf).select("doc_id", X.compare_form(F.col("text")).alias("norm"))


@query("norm_identity", r"select doc_id, regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', '', 'g') as norm from documents")
def norm_identity(spark, sf):
    return _docs(spark, sf).select("doc_id", X.identity_form(F.col("text")).alias("norm"))


@query("norm_match", r"select doc_id, regexp_replace(lower(text), '[^a-z0-9+.#/_\-\x{4e00}-\x{9fff}]+', '', 'g') as norm from documents")
def norm_match(spark, sf):
    return _docs(spark, sf).select("doc_id", X.match_form(F.col("text")).alias("norm"))


@query("norm_evidence", r"""select doc_id, regexp_replace(lower(text), '[\s，。；：、,.;:!?！？()（）\[\]【】"''“”‘’|·•\-—]+', '', 'g') as norm from documents""")
def norm_evidence(spark, sf):
    return _docs(spark, sf).select("doc_id", X.evidence_form(F.col("text")).alias("norm"))


@query("excerpts", r"""with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as s from documents)
select doc_id, case when length(s) <= 140 then s else rtrim(substr(s, 1, 139)) || '…' end as excerpt from t""")
def excerpts(spark, sf):
    return _docs(spark, sf).select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query("company_form", r"""select s_suppkey, regexp_replace(s_name || case when s_suppkey % 3 = 0 then ' Inc.' when s_suppkey % 3 = 1 then ' LLC' else ' (old)' end, '\s*(股份有限公司|有限责任公司|有限公司|集团|公司|Inc\.?|Ltd\.?|LLC|Corp\.?|[（(][^（）()]*[）)])$', '') as company from supplier""")
def company_form(spark, sf):
    tail = F.when(F.col("s_suppkey") % 3 == 0, " Inc.").when(F.col("s_suppkey") % 3 == 1, " LLC").otherwise(" (old)")
    return _t(spark, sf, "supplier").select("s_suppkey", X.company_form(F.concat("s_name", tail)).alias("company"))


@query("safe_filenames", r"""select page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '[^A-Za-z0-9._\-\x{4e00}-\x{9fff}]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 160), ''), 'upload.bin') as name from pages""")
def safe_filenames(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.safe_filename(F.col("url")).alias("name"))


@query("requirement_ids", r"select item_id, 'req_' || substr(sha1(regexp_replace(lower(text), '[^a-z0-9+.#/_\-\x{4e00}-\x{9fff}]+', '', 'g')), 1, 10) as req_id from benchmark")
def requirement_ids(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", X.requirement_id(F.col("text")).alias("req_id"))


_REDACT_SQL = r"regexp_replace(regexp_replace({x}, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'), '(?:\+?86[- ]?)?1[3-9][0-9]{{9}}', '[PHONE]', 'g')"
_ID_SQL = r"regexp_replace(regexp_replace({x}, '(^|[^0-9])[0-9]{{15,18}}[0-9Xx]($|[^0-9])', '\1[ID]\2', 'g'), '(^|[^0-9])[0-9]{{15,18}}[0-9Xx]($|[^0-9])', '\1[ID]\2', 'g')"


@query("pii_redact", f"select doc_id, {_ID_SQL.format(x=_REDACT_SQL.format(x='text'))} as redacted from documents")
def pii_redact(spark, sf):
    return _docs(spark, sf).select("doc_id", X.redact_pii(F.col("text"), 1 << 30).alias("redacted"))


@query("pii_counts_by_lang", r"""select lang, sum(len(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}')))::bigint as mails,
  sum(len(regexp_extract_all(text, '(?:\+?86[- ]?)?1[3-9][0-9]{9}')))::bigint as phones from documents group by lang""")
def pii_counts_by_lang(spark, sf):
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p))).cast("long")
    return _docs(spark, sf).groupBy("lang").agg(n(r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}").alias("mails"), n(r"(?:\+?86[- ]?)?1[3-9][0-9]{9}").alias("phones"))


def _injection_sql(x: str) -> str:
    from ..functions.lexicons import INJECTION_PATTERNS

    for p in INJECTION_PATTERNS:
        x = f"regexp_replace({x}, '{p}', '[REDACTED]', 'gi')"
    return x


@query("injection_redact", f"select conv_id, turn, {_injection_sql('text')} as clean from conversations")
def injection_redact(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", X.redact_injection(F.col("text")).alias("clean"))


_OTHER = r"length(regexp_replace({x}, '[\x00-\x7f\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]+', '', 'g'))"


@query("token_estimate_docs", f"select doc_id, (length(text) + 2 * {_OTHER.format(x='text')})::bigint as tokens from documents")
def token_estimate_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("static_token_estimate", rf"""select doc_id, (ceil(length(regexp_replace(text, '[^\x00-\x7f]+', '', 'g')) / 3.0)
  + length(regexp_replace(text, '[^\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]+', '', 'g')) + 2 * {_OTHER.format(x='text')})::bigint as tokens from documents""")
def static_token_estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", X.static_token_estimate(F.col("text")).alias("tokens"))


@query("chat_token_estimate", f"select conv_id, (sum(length(text) + 2 * {_OTHER.format(x='text')}) + 12 * count(*) + 64)::bigint as tokens from conversations group by conv_id")
def chat_token_estimate(spark, sf):
    return _t(spark, sf, "conversations").groupBy("conv_id").agg((F.sum(X.token_estimate(F.col("text"))) + 12 * F.count("*") + 64).cast("long").alias("tokens"))


# Dates


_PERIOD = "year(o_orderdate) || '.' || lpad(month(o_orderdate)::varchar, 2, '0')"


@query("period_parse", r"""with o as (select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, year(o_orderdate + interval 7 month) as y2, month(o_orderdate + interval 7 month) as m2 from orders)
select o_orderkey, (y * 12 + m)::bigint as start, case when o_orderkey % 4 = 3 then null else y2 * 12 + m2 end::bigint as "end",
  lpad(m::varchar, 2, '0') || '-' || y || ' - ' || case when o_orderkey % 4 = 3 then '至今' else lpad(m2::varchar, 2, '0') || '-' || y2 end as normal from o""")
def period_parse(spark, sf):
    o = _t(spark, sf, "orders")
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    end = F.add_months(F.col("o_orderdate").cast("date"), 7)
    y2, m2 = F.year(end), F.month(end)
    c = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, c(y, ".", m, " - ", y2, ".", m2)).when(k == 1, c(y, "年", m, "月至", y2, "年", m2, "月")).when(k == 2, c(F.lpad(m.cast("string"), 2, "0"), "/", y, " ~ ", F.lpad(m2.cast("string"), 2, "0"), "/", y2)).otherwise(c(y, "-", F.lpad(m.cast("string"), 2, "0"), " - 至今"))
    p = X.period_months(s)
    return o.select("o_orderkey", p["start"].cast("long").alias("start"), p["end"].cast("long").alias("end"), X.normal_period(s).alias("normal"))


def _order_spans(spark, sf):
    o = _t(spark, sf, "orders")
    start = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return o.select("o_custkey", "o_orderkey", start.cast("long").alias("start"), (start + F.col("o_orderkey") % 6).cast("long").alias("end"))


_SPANS = 'select o_custkey, o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate))::bigint as start, (year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 6)::bigint as "end" from orders'


@query("interval_union_months", rf"""with s as ({_SPANS}), r as (select *, max("end") over (partition by o_custkey order by start, "end" rows between unbounded preceding and 1 preceding) as reach from s),
g as (select *, sum(case when reach is null or start > reach + 1 then 1 else 0 end) over (partition by o_custkey order by start, "end" rows unbounded preceding) as run from r),
m as (select o_custkey, run, max("end") - min(start) + 1 as n from g group by o_custkey, run)
select o_custkey, sum(n)::bigint as months, greatest(1, round_even(sum(n) / 12.0, 0))::bigint as years from m group by o_custkey""")
def interval_union_months(spark, sf):
    return intervals.union_months(_order_spans(spark, sf), "o_custkey", whole=False)


@query("interval_overlap_pairs", rf"""with s as ({_SPANS}) select a.o_custkey, a.o_orderkey as first, b.o_orderkey as second, least(a."end", b."end") - greatest(a.start, b.start) + 1 as months
from s a join s b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.start <= b."end" and b.start <= a."end" """)
def interval_overlap_pairs(spark, sf):
    return intervals.overlapping(_order_spans(spark, sf), "o_custkey", "o_orderkey")


@query("sort_order_violations", rf"""with s as ({_SPANS}), n as (select *, lead(o_orderkey) over w as nk, lead(start) over w as ns from s window w as (partition by o_custkey order by o_orderkey))
select o_custkey, o_orderkey as first, nk as second from n where start < ns""")
def sort_order_violations(spark, sf):
    return intervals.out_of_order(_order_spans(spark, sf), "o_custkey", "o_orderkey")


@query("newest_first", rf"with s as ({_SPANS}) select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by start desc, o_orderkey)::bigint as rank from s")
def newest_first(spark, sf):
    return intervals.newest_first(_order_spans(spark, sf), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


# Pieces


_LINES = r"""select doc_id, i - 1 as pos, l, trim(l, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) as piece,
  length(l) - length(ltrim(l, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) as lead_, sum(length(l) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before_
  from (select doc_id, unnest(string_split_regex(text, '[\r\n]')) as l, generate_subscripts(string_split_regex(text, '[\r\n]'), 1) as i from documents)"""


@query("line_split_offsets", rf"""with l as ({_LINES}) select doc_id, pos::bigint as pos, (coalesce(before_, 0) + lead_)::bigint as start, (coalesce(before_, 0) + lead_ + length(piece))::bigint as "end", piece from l where piece <> '' """)
def line_split_offsets(spark, sf):
    return segment.lines(_docs(spark, sf))


@query("sentence_units", r"""with s as (select doc_id, unnest(string_split_regex(text, '[。；;！？!?\r\n]+')) as p, generate_subscripts(string_split_regex(text, '[。；;！？!?\r\n]+'), 1) - 1 as pos from documents),
t as (select doc_id, pos::bigint as pos, trim(p, ' ' || chr(9) || chr(12)) as piece from s) select doc_id, pos, piece from t where length(piece) >= 2""")
def sentence_units(spark, sf):
    return segment.sentences(_docs(spark, sf)).select("doc_id", "pos", "piece")


@query("consecutive_line_dedup", rf"""with l as ({_LINES}), k as (select * from l where piece <> ''), w as (select doc_id, pos::bigint as pos, piece, lag(piece) over (partition by doc_id order by pos) as was from k)
select doc_id, pos, piece from w where was is null or was <> piece""")
def consecutive_line_dedup(spark, sf):
    return segment.dedup_consecutive(segment.lines(_docs(spark, sf))).select("doc_id", "pos", "piece")


@query("heading_asof", rf"""with l as ({_LINES}), k as (select doc_id, pos::bigint as pos, piece, case when length(piece) <= 18 then piece end as h from l where piece <> '')
select doc_id, pos, coalesce(last_value(h ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row),
  first_value(h ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and unbounded following)) as heading from k""")
def heading_asof(spark, sf):
    return segment.carry_heading(segment.lines(_docs(spark, sf)), F.length("piece") <= 18).select("doc_id", "pos", "heading")


@query("record_islands", rf"""with l as ({_LINES}), k as (select doc_id, pos, piece from l where piece <> ''),
r as (select doc_id, sum(case when length(piece) <= 18 then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as record, piece from k)
select doc_id, record::bigint as record, count(*) as n_lines, sum(length(piece))::bigint as n_chars from r group by doc_id, record""")
def record_islands(spark, sf):
    rows = segment.islands(segment.lines(_docs(spark, sf)), F.length("piece") <= 18)
    return rows.groupBy("doc_id", "record").agg(F.count("*").alias("n_lines"), F.sum(F.length("piece")).cast("long").alias("n_chars"))


@query("wrapped_lines", rf"""with l as ({_LINES}), k as (select doc_id, pos, piece from l where piece <> ''),
r as (select *, sum(case when regexp_matches(piece, '^[a-zà-ÿ]') then 0 else 1 end) over (partition by doc_id order by pos rows unbounded preceding) as g from k)
select doc_id, min(pos)::bigint as pos, string_agg(piece, ' ' order by pos) as piece from r group by doc_id, g""")
def wrapped_lines(spark, sf):
    return segment.coalesce_wrapped(segment.lines(_docs(spark, sf)), F.col("piece").rlike("^[a-zà-ÿ]")).select("doc_id", "pos", "piece")


@query("budget_prefix", rf"""with l as ({_LINES}), k as (select doc_id, pos::bigint as pos, sum(length(piece)) over (partition by doc_id order by pos rows unbounded preceding)::bigint as used from l where piece <> '')
select doc_id, pos, used from k where used <= 1000""")
def budget_prefix(spark, sf):
    return segment.under_budget(segment.lines(_docs(spark, sf)), 1000).select("doc_id", "pos", "used")


@query("numeric_anchors", r"""with a as (select doc_id, unnest(regexp_extract_all(text, '(^|[^A-Za-z0-9])([0-9]+(?:\.[0-9]+)?\s*(?:%|w|k|ms|s|qps|tps|fps|mb|gb))', 2, 'i')) as x from documents)
select doc_id, count(distinct trim(x)) as n from a group by doc_id""")
def numeric_anchors(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(X.metric_anchors(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query("latin_terms_topk", r"""with t as (select lang, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+./-]{1,24}'))) as term from documents), c as (select lang, term, count(*) as n from t group by lang, term)
select lang, term, n, rank from (select *, row_number() over (partition by lang order by n desc, term) as rank from c) where rank <= 20""")
def latin_terms_topk(spark, sf):
    t = _docs(spark, sf).select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9_+./-]{1,24}"), F.lit(0))).alias("term"))
    c = t.groupBy("lang", F.lower("term").alias("term")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    return c.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 20")


@query("requirement_keywords", r"""with k as (select item_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+./-]{1,24}|[\x{4e00}-\x{9fff}]{2,8}')) as w, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+./-]{1,24}|[\x{4e00}-\x{9fff}]{2,8}'), 1) as i from benchmark),
f as (select item_id, lower(w) as l, arg_min(w, i) as w, min(i) as i from k where lower(w) not in ('and', 'with', 'for', 'the', 'you', 'will', 'have', 'years', 'experience', 'ability', 'plus') group by item_id, lower(w)),
r as (select *, row_number() over (partition by item_id order by i) as n from f) select item_id, n::bigint as pos, w as keyword from r where n <= 40""")
def requirement_keywords(spark, sf):
    k = _t(spark, sf, "benchmark").select("item_id", F.posexplode(X.keywords(F.col("text"))).alias("pos", "keyword"))
    return k.select("item_id", (F.col("pos") + 1).cast("long").alias("pos"), "keyword")


# Evidence


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_GRAMS = f"""select {{id}}, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as gram from (select {{id}}, {_WORDS} as w from {{t}})"""
_OVERLAP = f"""with c as ({_GRAMS.format(id="item_id", t="benchmark")}), d as ({_GRAMS.format(id="doc_id", t="documents")}), n as (select item_id, count(*) as total from c group by item_id),
o as (select c.item_id, d.doc_id, count(*) as shared from c join d using (gram) group by all)"""


def _overlap(spark, sf):
    return evidence.corpus_overlap(_t(spark, sf, "benchmark"), _docs(spark, sf), "item_id")


@query("evidence_best_match", f"""{_OVERLAP} select item_id, doc_id, shared, total from (select o.*, total, row_number() over (partition by item_id order by shared desc, doc_id) as r from o join n using (item_id) where shared / total >= 0.22) where r = 1""")
def evidence_best_match(spark, sf):
    return evidence.best_document(_overlap(spark, sf), "item_id")


@query("evidence_missing", f"""{_OVERLAP} select item_id from benchmark where item_id not in (select item_id from o join n using (item_id) where shared / total >= 0.22)""")
def evidence_missing(spark, sf):
    found = _overlap(spark, sf).where("shared / total >= 0.22").select("item_id").distinct()
    return _t(spark, sf, "benchmark").select("item_id").join(found, "item_id", "left_anti")


@query("evidence_exact", f"""with c as (select item_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' as c from benchmark), d as (select doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' as d from documents)
select item_id, doc_id from c join d on contains(d, c)""")
def evidence_exact(spark, sf):
    return evidence.containing(_t(spark, sf, "benchmark"), _docs(spark, sf), "item_id")


@query("coverage_ratio_by_lang", f"""{_OVERLAP} select lang, count(distinct o.item_id) as items, round(avg(shared / total), 6) as coverage from o join n using (item_id) join documents using (doc_id) group by lang""")
def coverage_ratio_by_lang(spark, sf):
    o = _overlap(spark, sf).join(_docs(spark, sf).select("doc_id", "lang"), "doc_id")
    return o.groupBy("lang").agg(F.countDistinct("item_id").alias("items"), F.round(F.avg(F.col("shared") / F.col("total")), 6).alias("coverage"))


_TURNS = "select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as was from conversations"


@query("turn_alignment", rf"""with t as ({_TURNS}), b as (select conv_id, turn, regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_]+', '', 'g') as x, regexp_replace(lower(was), '[^\p{{L}}\p{{M}}\p{{N}}_]+', '', 'g') as y from t where was is not null),
g as (select conv_id, turn, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) as gx, list_distinct(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) as gy from b)
select conv_id, turn, round(len(list_intersect(gx, gy)) / greatest(len(gx), 1), 6) as overlap from g""")
def turn_alignment(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, sf, "conversations").withColumn("was", F.lag("text").over(w)).where("was is not null")
    return t.select("conv_id", "turn", F.round(X.covered_share(X.identity_bigrams(F.col("text")), X.identity_bigrams(F.col("was"))), 6).alias("overlap"))


@query("keyword_alignment", r"""with t as (select conv_id, turn, lower(text) as l, lag(text) over (partition by conv_id order by turn) as req from conversations),
k as (select conv_id, turn, unnest(regexp_extract_all(req, '[A-Za-z][A-Za-z0-9_+./-]{1,24}|[\x{4e00}-\x{9fff}]{2,8}')) as w, generate_subscripts(regexp_extract_all(req, '[A-Za-z][A-Za-z0-9_+./-]{1,24}|[\x{4e00}-\x{9fff}]{2,8}'), 1) as i from t where req is not null),
f as (select conv_id, turn, lower(w) as w, min(i) as i from k where lower(w) not in ('and', 'with', 'for', 'the', 'you', 'will', 'have', 'years', 'experience', 'ability', 'plus') group by conv_id, turn, lower(w)),
r as (select *, row_number() over (partition by conv_id, turn order by i) as n from f), ws as (select conv_id, turn, list(w) as ws from r where n <= 40 group by conv_id, turn)
select t.conv_id, t.turn, len(list_filter(coalesce(ws, []), lambda x: contains(l, x)))::bigint as n_matched, case when ws is null then 0 else round_even(100.0 * len(list_filter(ws, lambda x: contains(l, x))) / len(ws), 0) end::bigint as coverage
from t left join ws using (conv_id, turn) where req is not null""")
def keyword_alignment(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, sf, "conversations").withColumn("req", F.lag("text").over(w)).where("req is not null")
    a = rank.alignment(t, "req", "text", shown=40)
    return a.select("conv_id", "turn", F.size("matched").cast("long").alias("n_matched"), "coverage")


@query("atom_audit")
def atom_audit(spark, sf):
    """Each conversation's later turns judged clause by clause against its first."""
    c = _t(spark, sf, "conversations")
    w = Window.partitionBy("conv_id")
    c = c.withColumn("first", F.min("turn").over(w))
    facts = c.where("turn = first").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")
    later = c.where("turn > first").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    atoms = segment.pieces(later.select("conv_id", "key", "text"), segment.SENTENCE, "key", "text", 2)
    atoms = atoms.select(F.split("key", ":")[0].cast("long").alias("doc_id"), F.concat_ws(":", "key", "pos").alias("atom_id"), F.col("piece").alias("text"))
    return evidence.atom_matches(atoms, facts)


# Duplicates


@query("exact_dup_groups", r"""with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as s from documents) select sha256(s) as digest, count(*) as size, min(doc_id) as least_id from t group by s""")
def exact_dup_groups(spark, sf):
    return dedup.exact_groups(_docs(spark, sf))


@query("prefix60_dedup", rf"""with l as ({_LINES}), p as (select doc_id, pos::bigint as pos, piece, trim(substr(piece, 1, 60)) as p from l where piece <> '') select doc_id, pos, piece from (select *, row_number() over (partition by doc_id, p order by pos) as r from p) where r = 1""")
def prefix60_dedup(spark, sf):
    return dedup.first_by_prefix(segment.lines(_docs(spark, sf)), "doc_id", "pos", "piece").select("doc_id", "pos", "piece")


_TOKENS = r"list_distinct(list_concat(case when length(x) < 2 then [x] else list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) end, regexp_extract_all(x, '[a-zA-Z]{3,}')))"


def _turns(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", "text")


@query("near_dup_pairs", rf"""with c as (select doc_id, regexp_replace(text, '\s+', '', 'g') as x from documents), t as (select doc_id, {_TOKENS} as t from c)
select a.doc_id as first, b.doc_id as second from t a join t b on a.doc_id < b.doc_id
where len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) > 0.65""")
def near_dup_pairs(spark, sf):
    """Near pairs among all documents."""
    docs = _docs(spark, sf).select(F.lit(0).alias("all"), "doc_id", "text")
    return dedup.near_pairs(docs, "all", "doc_id", "text", space=r"[\t\n\f\r ]+", empty=True).drop("all")


@query("near_dup_kept")
def near_dup_kept(spark, sf):
    return dedup.near_duplicates(_turns(spark, sf), "conv_id", "turn", "text").select("conv_id", "turn", "kept")


@query("distinct_limited", rf"""with l as ({_LINES}), d as (select doc_id, pos::bigint as pos, piece, row_number() over (partition by doc_id, lower(piece) order by pos) as n from l where piece <> ''), k as (select doc_id, pos, row_number() over (partition by doc_id order by pos) as rank from d where n = 1)
select doc_id, pos, rank::bigint as rank from k where rank <= 5""")
def distinct_limited(spark, sf):
    return dedup.distinct_limited(segment.lines(_docs(spark, sf)), "doc_id", "pos", "piece", 5).select("doc_id", "pos", F.col("rank").cast("long").alias("rank"))


@query("subsumed_rows", r"""with p as (select p_brand as k, p_partkey as pos, case when p_partkey % 3 = 0 then '' else p_type end as a, case when p_partkey % 2 = 0 then '' else p_size::varchar end as b from part)
select k, pos from p x where not exists (select 1 from p y where y.k = x.k and (x.a = '' or x.a = y.a) and (x.b = '' or x.b = y.b) and (case when x.a = '' then 0 else 1 end + case when x.b = '' then 0 else 1 end) < (case when y.a = '' then 0 else 1 end + case when y.b = '' then 0 else 1 end))""")
def subsumed_rows(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("a"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_size").cast("string")).alias("b"))
    return dedup.subsumed(p, "k", "pos", ["a", "b"]).select("k", "pos")


@query("coalesced_rows", r"""with p as (select p_brand as k, p_partkey as pos, case when p_partkey % 3 = 0 then null else p_type end as a, case when p_partkey % 2 = 0 then null else p_size::varchar end as b from part)
select k, min(pos) as pos, arg_min(a, pos) filter (a is not null) as a, arg_min(b, pos) filter (b is not null) as b from p group by k""")
def coalesced_rows(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("a"), F.when(F.col("p_partkey") % 2 != 0, F.col("p_size").cast("string")).alias("b"))
    return dedup.coalesced(p, ["k"], "pos", ["a", "b"])


@query("union_by_key", "select c_custkey as k from customer where c_custkey % 2 = 0 union select o_custkey from orders")
def union_by_key(spark, sf):
    kept = _t(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return dedup.union_by_key(kept, _t(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct(), ["k"])


@query("record_owners", """with v as (select o_custkey as record_id, o_orderpriority as owner, count(*) as score from orders group by all), m as (select *, max(score) over (partition by record_id) as b from v), t as (select *, count(*) over (partition by record_id) as ties from m where score = b)
select record_id, owner, score from t where ties = 1""")
def record_owners(spark, sf):
    votes = _t(spark, sf, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderpriority").alias("owner"), F.lit(1).cast("long").alias("weight"))
    return evidence.record_owner(votes)


@query("possible_scopes", """with f as (select distinct l_orderkey as record_id, l_returnflag as field, l_linestatus as scope from lineitem), n as (select record_id, count(distinct field) as need from f group by record_id)
select record_id, scope from f join n using (record_id) group by record_id, scope having count(distinct field) = max(need)""")
def possible_scopes(spark, sf):
    f = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("scope"))
    return evidence.possible_scopes(f)


# Scores, ranks, roll-ups


@query("bullet_rank_topk", rf"""with l as ({_LINES}), k as (select doc_id, pos::bigint as pos, piece, case when regexp_matches(piece, '[0-9]') then 1 else 0 end + 3 * case when regexp_matches(piece, '[0-9]+(\.[0-9]+)?\s*%') then 1 else 0 end + 2 * case when len(regexp_extract_all(piece, '[0-9]+(?:\.[0-9]+)?')) >= 2 then 1 else 0 end as density from l where piece <> ''),
r as (select doc_id, pos, density, row_number() over (partition by doc_id order by density desc, least(length(piece), 120) desc, pos) as rank from k) select doc_id, pos, density::bigint as density, rank from r where rank <= 3""")
def bullet_rank_topk(spark, sf):
    top = rank.ranked_bullets(segment.lines(_docs(spark, sf)), "doc_id", "pos", "piece", F.lit(""), 3)
    return top.select("doc_id", "pos", "density", "rank")


_LEX = {"plain": ("the", "and", "with"), "loud": ("!!", "###", "$$$"), "listed": (" | ",)}


@query("lexicon_vote", """with s as (select doc_id, lower(text) as t from documents), v as (select doc_id, contains(t, 'the')::int + contains(t, 'and')::int + contains(t, 'with')::int as a, contains(t, '!!')::int + contains(t, '###')::int + contains(t, '$$$')::int as b, contains(t, ' | ')::int as c from s)
select doc_id, case when greatest(a, b, c) = 0 then 'other' when a = greatest(a, b, c) then 'plain' when b = greatest(a, b, c) then 'loud' else 'listed' end as label, greatest(a, b, c)::double as votes from v""")
def lexicon_vote(spark, sf):
    return rank.vote(_docs(spark, sf), _LEX, "text").select("doc_id", "label", "votes")


@query("scan_quality", r"""with s as (select doc_id, length(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), '')) as n, length(regexp_replace(text, '[\p{L}\p{M}\p{N}_\s\x{3000}-\x{303f}\x{ff00}-\x{ffef}\-./%]+', '', 'g')) as noise from documents)
select doc_id, case when noise / greatest(n, 1) < 0.1 then 30 when noise / greatest(n, 1) < 0.2 then 15 else 0 end::bigint as score from s""")
def scan_quality(spark, sf):
    return _docs(spark, sf).select("doc_id", X.scan_score(F.col("text")).cast("long").alias("score"))


@query("quality_by_label", "select quality, toxic, count(*) as n, round(avg(n_chars), 6) as mean_chars, max(n_chars) as most_chars from documents join labels using (doc_id) group by quality, toxic")
def quality_by_label(spark, sf):
    j = _docs(spark, sf).select("doc_id", "n_chars").join(_t(spark, sf, "labels"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.max("n_chars").alias("most_chars"))


@query("score_rollup", "select lang, source, count(*) as n, round_even(avg((n_chars >= 500)::int), 4) as usable_rate from documents group by rollup (lang, source)")
def score_rollup(spark, sf):
    return rank.rollup(_docs(spark, sf), ["lang", "source"], F.col("n_chars") >= 500)


@query("reason_histogram", r"""with r as (select unnest(list_filter([case when n_chars < 100 then 'short' end, case when regexp_matches(text, '[#*$%&]{3}') then 'symbols' end, case when regexp_matches(text, '!!') then 'shouting' end], lambda x: x is not null)) as reason from documents) select reason, count(*) as n from r group by reason""")
def reason_histogram(spark, sf):
    r = F.array_compact(F.array(F.when(F.col("n_chars") < 100, "short"), F.when(F.col("text").rlike("[#*$%&]{3}"), "symbols"), F.when(F.col("text").rlike("!!"), "shouting")))
    return _docs(spark, sf).select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("audit_calibration")
def audit_calibration(spark, sf):
    n = lambda c: F.count(F.when(c, 1))
    d = F.col("l_discount")
    i = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(n(d > 0.08).alias("high"), n((d > 0.04) & (d <= 0.08)).alias("medium"), n(d <= 0.04).alias("low"), (F.avg("l_quantity") / 5).alias("base"))
    return rank.audit_score(i, F.col("base"), F.col("high"), F.col("medium"), F.col("low")).select("k", "score")


@query("completeness_scores", """with c as (select o_custkey as k, count(*) filter (o_orderstatus = 'F') as hard, count(*) filter (o_orderstatus = 'O') as soft, count(*) filter (o_orderstatus = 'P') as conflicts from orders group by 1)
select k, greatest(0.0, least(30.0, 30.0 - 4.0 * hard - 2.0 * soft - least(6.0, 2.0 * conflicts)))::double as score from c""")
def completeness_scores(spark, sf):
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    c = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(n("F").alias("hard"), n("O").alias("soft"), n("P").alias("conflicts"))
    return c.select("k", rank.completeness_score(F.col("hard"), F.col("soft"), F.col("conflicts")).alias("score"))


@query("shrink_guard", "select page_id, n_chars >= 200 and length(html) <= greatest(120, floor(n_chars * 0.35)) as shrunk from pages join documents on page_id = doc_id")
def shrink_guard(spark, sf):
    j = _t(spark, sf, "pages").join(_docs(spark, sf).select("doc_id", "n_chars"), F.col("page_id") == F.col("doc_id"))
    return j.select("page_id", rank.shrunk(F.col("n_chars"), F.length("html")).alias("shrunk"))


@query("change_log_diff", rf"""with t as ({_TURNS}) select conv_id, turn, case when trim(text) = '' then 'clear' else 'replace' end as action, length(was)::bigint as was_chars, length(text)::bigint as now_chars from t where was is not null and trim(regexp_replace(was, '\s+', ' ', 'g')) <> trim(regexp_replace(text, '\s+', ' ', 'g'))""")
def change_log_diff(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, sf, "conversations").withColumn("was", F.lag("text").over(w)).where("was is not null")
    log = guards.changes(t.select("conv_id", "turn", F.col("was").alias("value")), t.select("conv_id", "turn", F.col("text").alias("value")), ["conv_id", "turn"])
    return log.select("conv_id", "turn", "action", F.length("before").cast("long").alias("was_chars"), F.length("after").cast("long").alias("now_chars"))


@query("rewrite_guard")
def rewrite_guard(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, sf, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null").withColumnRenamed("text", "after")
    return guards.guarded(t).select("conv_id", "turn", "reasons", F.length("accepted").alias("accepted_chars"))


# Sources, stores, JSON


@query("draft_latest_version", "select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def draft_latest_version(spark, sf):
    return store.latest(_t(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("next_versions", "select o_custkey as draft_id, (max(o_orderkey) + 1)::bigint as version from orders group by o_custkey union all select c_custkey, 1 from customer where c_custkey not in (select o_custkey from orders)")
def next_versions(spark, sf):
    existing = _t(spark, sf, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("version"))
    keys = _t(spark, sf, "customer").select(F.col("c_custkey").alias("draft_id")).union(existing.select("draft_id")).distinct()
    return store.next_versions(existing, keys).select("draft_id", F.col("version").cast("long").alias("version"))


@query("props_json_parse", "select event_id, len(json_keys(props))::bigint as n_props, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value from events")
def props_json_parse(spark, sf):
    p = _t(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return p.select("event_id", F.size("m").cast("long").alias("n_props"), F.get(F.map_values("m"), 0).alias("first_value"))


@query("tolerant_json")
def tolerant_json(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.concat(F.lit("answer: ```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n``` end")).alias("raw"))
    return e.select("event_id", jsontext.tolerant_json(F.col("raw")).alias("json"))


@query("flat_paths", "select event_id, 'props.' || k as path, json_extract_string(props, '$.' || k) as value from (select event_id, props, unnest(json_keys(props)) as k from events)")
def flat_paths(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.explode(jsontext.flat_paths(F.concat(F.lit('{"props": '), "props", F.lit("}")))).alias("x"))
    return e.select("event_id", "x.path", "x.value")


@query("url_predicate", r"select page_id, regexp_matches(url, '^https?://[^/?#@\s:]+(:(80|443))?([/?#]|$)') as public, regexp_extract(url, '^(https?://[^\s]+)', 1) as url from pages")
def url_predicate(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", X.is_public_url(F.col("url")).alias("public"), X.split_url(F.col("url"))["url"].alias("url"))


@query("html_visible_text")
def html_visible_text(spark, sf):
    return html.read_visible(_t(spark, sf, "pages"), most=None).select("page_id", "text")


# Fields, rewrites and bindings


@query("semantic_forms", r"""select doc_id, regexp_replace(regexp_replace(lower(text), '[，。；：、“”‘’（）()【】\[\],.;:!?！？\-_/\\"'']', '', 'g'), '\s+', '', 'g') as form from documents""")
def semantic_forms(spark, sf):
    return _docs(spark, sf).select("doc_id", fields.semantic_form(F.col("text")).alias("form"))


@query("snippets", "select doc_id, case when length(trim(text)) <= 42 then trim(text) else rtrim(substr(trim(text), 1, 42)) || '...' end as snippet from documents")
def snippets(spark, sf):
    return _docs(spark, sf).select("doc_id", fields.snippet(F.col("text")).alias("snippet"))


_PAIRS = "regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g')"
_BIGRAMS = "list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"


@query("review_due", f"""with t as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as was from conversations), n as (select conv_id, turn, {_PAIRS.format(x="was")} as x, {_PAIRS.format(x="text")} as y from t where was is not null),
g as (select conv_id, turn, {_BIGRAMS.format(x="x")} as a, {_BIGRAMS.format(x="y")} as b from n)
select conv_id, turn, len(a) = 0 or len(b) = 0 or len(list_intersect(a, b)) / len(b) < 0.35 or len(list_intersect(a, b)) / len(a) < 0.45 as due from g""")
def review_due(spark, sf):
    """Whether each turn, taken as a rewrite of the one before it, needs a second look."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _turns(spark, sf).withColumn("was", F.lag("text").over(w)).where("was is not null")
    return t.select("conv_id", "turn", rewrites.needs_review(F.col("was"), F.col("text")).alias("due"))


@query("latin_anchors", r"""with t as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+./-]{1,30}')) as w from documents)
select doc_id, count(distinct lower(w))::bigint as anchors from t where lower(w) not in ('the', 'and') and (regexp_matches(w, '[A-Z0-9]') or length(w) >= 6) group by doc_id""")
def latin_anchors(spark, sf):
    a = rewrites.technical_anchors(F.col("text"), [], [], ["the", "and"])
    return _docs(spark, sf).select("doc_id", F.size(a).cast("long").alias("anchors")).where("anchors > 0")


def _claims_and_blocks(spark, sf):
    """Each conversation's last turn as claims, clause by clause, and its earlier turns as blocks."""
    c = _turns(spark, sf).withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    claims = c.where("turn = last").select("conv_id", F.posexplode(F.split("text", r"[.\n]")).alias("claim_id", "text"))
    blocks = c.where("turn < last").select("conv_id", F.col("turn").alias("block_id"), F.col("turn").alias("pos"), "text")
    return claims, blocks


@query("claim_overlaps", f"""with c as (select *, max(turn) over (partition by conv_id) as last from conversations),
q as (select conv_id, unnest(string_split_regex(text, '[.\\n]')) as text, generate_subscripts(string_split_regex(text, '[.\\n]'), 1) - 1 as claim_id from c where turn = last),
x as (select conv_id, claim_id, {_PAIRS.format(x="text")} as x from q), a as (select conv_id, claim_id, {_BIGRAMS.format(x="x")} as a from x),
y as (select conv_id, turn, {_PAIRS.format(x="text")} as x from c where turn < last), b as (select conv_id, turn as block_id, {_BIGRAMS.format(x="x")} as b from y)
select conv_id, claim_id::int as claim_id, block_id, round(len(list_intersect(a, b)) / len(a), 6) as share from a join b using (conv_id) where len(list_intersect(a, b)) > 0""")
def claim_overlaps(spark, sf):
    claims, blocks = _claims_and_blocks(spark, sf)
    return binding.overlaps(claims, blocks, "conv_id").select("conv_id", "claim_id", "block_id", F.round("share", 6).alias("share"))


@query("claim_bindings")
def claim_bindings(spark, sf):
    """Each claim's best block, with all blocks that bear it; the tests hold the tiers against hand-made cases."""
    claims, blocks = _claims_and_blocks(spark, sf)
    return binding.bound(claims.withColumn("kind", F.lit("bullets")), blocks, "conv_id").withColumn("similarity", F.round("similarity", 6))


# Reports


_ISSUES = "select l_orderkey, l_linenumber as pos, l_linenumber % 3 as bullet_index, case l_returnflag when 'N' then null when 'A' then ' a ' else 'r' end as project, case l_linestatus when 'O' then 'High' when 'F' then case when l_quantity > 25 then 'low' else 'none' end end as severity from lineitem"


def _issues(spark, sf):
    """Lines of orders in the place of issues of documents."""
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    severity = F.when(s == "O", "High").when(s == "F", F.when(F.col("l_quantity") > 25, "low").otherwise("none"))
    project = F.when(r == "A", " a ").when(r != "N", "r")
    return _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") % 3).alias("bullet_index"), project.alias("project"), severity.alias("severity"))


@query("issue_index", f"""with t as ({_ISSUES}) select l_orderkey, coalesce(nullif(trim(project), ''), '项目经历') as project, bullet_index, count(*) as n, min(pos) as first
from t where bullet_index > 0 group by all""")
def issue_index(spark, sf):
    return reports.issue_index(_issues(spark, sf), "l_orderkey")


@query("audit_summaries", f"""with t as ({_ISSUES}), c as (select l_orderkey, count(*) as issues, count(*) filter (lower(severity) = 'high') as high, count(*) filter (coalesce(lower(severity), '') not in ('high', 'low')) as medium, count(*) filter (lower(severity) = 'low') as low from t where pos < 6 group by 1),
s as (select l_orderkey, l_linenumber, l_tax * 100 as x, row_number() over (partition by l_orderkey order by l_tax * 100, l_linenumber) as r from lineitem),
w as (select l_orderkey, string_agg(printf('d%d:%.1f', l_linenumber, x), '、' order by r) as weakest from s where r <= 2 group by 1)
select l_orderkey, weakest, coalesce(issues, 0) as issues, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(low, 0) as low from w left join c using (l_orderkey)""")
def audit_summaries(spark, sf):
    scores = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.concat(F.lit("d"), F.col("l_linenumber")).alias("dimension"), (F.col("l_tax") * 100).alias("score"))
    return reports.audit_summary(_issues(spark, sf).where("pos < 6"), scores, "l_orderkey")


@query("rewrite_counts", """select l_orderkey, count(*) filter (l_returnflag = 'R' and l_linenumber % 2 = 1) as rewrites from lineitem group by 1""")
def rewrite_counts(spark, sf):
    action = F.when(F.col("l_returnflag") == "R", "replace").otherwise("keep")
    path = F.when(F.col("l_linenumber") % 2 == 1, F.format_string("experience[0].bullets[%d]", "l_linenumber")).otherwise("meta.name")
    return reports.rewrite_counts(_t(spark, sf, "lineitem").select("l_orderkey", action.alias("action"), path.alias("path")), "l_orderkey")


@query("patches_in_batch", "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def patches_in_batch(spark, sf):
    batch = _t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return reports.in_batch(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), batch, ["l_orderkey"])


_RAW = "list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))"


@query("closest_sentences", f"""with c as (select *, max(turn) over (partition by conv_id) as last from conversations),
q as (select conv_id, generate_subscripts(string_split_regex(text, '[.\\n]'), 1) - 1 as bullet_id, regexp_replace(unnest(string_split_regex(text, '[.\\n]')), '[\\s\\p{{Z}}]+', '', 'g') as x from c where turn = last),
a as (select conv_id, bullet_id, {_RAW} as a from q), b as (select conv_id, turn as pos, {_RAW} as b from (select conv_id, turn, regexp_replace(text, '[\\s\\p{{Z}}]+', '', 'g') as x from c where turn < last)),
p as (select conv_id, bullet_id, pos, len(list_intersect(a, b)) / len(a) as coverage, len(list_intersect(a, b)) / len(b) as recall from a join b using (conv_id) where len(list_intersect(a, b)) > 0)
select conv_id, bullet_id::int as bullet_id, pos, round(coverage, 6) as coverage, round(recall, 6) as recall from p qualify row_number() over (partition by conv_id, bullet_id order by p.coverage desc, p.recall desc, pos) = 1""")
def closest_sentences(spark, sf):
    claims, blocks = _claims_and_blocks(spark, sf)
    found = reports.closest_sentences(claims.withColumnRenamed("claim_id", "bullet_id"), blocks, "conv_id")
    return found.withColumns({"coverage": F.round("coverage", 6), "recall": F.round("recall", 6)})


@query("case_means", """select lang, grouping(lang) = 1 as whole, count(*) as cases, count(*) filter (n_chars % 2 = 0) as exact, count(*) filter (n_chars > 500) as conserved,
round(sum(doc_id % 8)::double / count(*) / 8, 4) as mean_order_accuracy, round(sum(n_chars % 4)::double / count(*) / 4, 4) as mean_adjacency_accuracy from documents group by rollup (lang)""")
def case_means(spark, sf):
    c = _docs(spark, sf).select("lang", (F.col("n_chars") % 2 == 0).alias("exact"), (F.col("n_chars") > 500).alias("conserved"), (F.col("doc_id") % 8 / 8).alias("order_accuracy"), (F.col("n_chars") % 4 / 4).alias("adjacency_accuracy"))
    return reports.case_means(c, "lang")
