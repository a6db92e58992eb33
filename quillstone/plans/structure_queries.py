"""Structure of texts and tables: documents give the texts, orders and suppliers give pages and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import models as M
from quillstone.functions import structure as S
from quillstone.functions import structure_rules as R
from quillstone.operators import lines as L
from quillstone.plans.registry import group
from quillstone.session import spread
from quillstone.sources import pages as P
from quillstone.sources import tables as T
from quillstone.sources.tables import table

QUERIES, SQL, query = group()


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _rewritten(column: str, rules, flags: str) -> str:
    for pattern, to in rules:
        column = f"regexp_replace({column}, '({'?' + flags + ')' if flags else '?s)'}{S.portable(pattern)}', {_sql_text(to.replace('{', chr(92)).replace('}', ''))}, 'g')"
    return column


_FIXED = _rewritten(_rewritten("text", R.MARKER_REWRITES, "im"), R.PAGE_REWRITES, "")


@query(f"select doc_id, md5({_FIXED}) as digest from documents")
def marked_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(S.fixed_markers(F.col("text")).cast("binary")).alias("digest"))


@query(f"select doc_id, md5(trim({_rewritten('text', R.READING_REWRITES, '')})) as digest from documents")
def readable_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(S.readable(F.col("text")).cast("binary")).alias("digest"))


_P = {k: S.portable(getattr(R, k)) for k in ("LIST_ITEM", "LONG_LIST", "QUESTION_ANSWER", "DEFINES", "PROCEDURE", "PROCEDURE_OR_HOW", "TERMS", "SECTION_MARKS", "ARTICLE_MARKS")}
_KIND = "case doc_id % 3 when 0 then 'definitions' when 1 then 'procedures' else 'general' end"


def _kind():
    return F.when(F.col("doc_id") % 3 == 0, "definitions").when(F.col("doc_id") % 3 == 1, "procedures").otherwise("general")


@query(rf"""
with d as (select doc_id, text, {_KIND} as kind from documents)
select doc_id, not (ends_with(text, '...') or ends_with(text, '…'))
    and (regexp_matches(text, '[.!?][\t\n\f\r ]*$') or regexp_matches(text, '(?m){_P["LIST_ITEM"]}'))
    and case kind when 'definitions' then regexp_matches(text, '(?i){_P["DEFINES"]}') when 'procedures' then regexp_matches(text, '(?i){_P["PROCEDURE_OR_HOW"]}') else true end as complete,
  regexp_matches(text, '(?m){_P["LONG_LIST"]}') or regexp_matches(text, '{_P["QUESTION_ANSWER"]}')
    or len(text) - len(replace(text, '|', '')) >= 4 or len(text) - len(replace(text, chr(9), '')) >= 4 or kind <> 'general'
    or regexp_matches(text, '(?i){_P["DEFINES"]}') or regexp_matches(text, '(?i){_P["PROCEDURE"]}') or regexp_matches(text, '(?i){_P["TERMS"]}') as protected
from d
""")
def concept_flags(spark, d):
    text = F.col("text")
    return _docs(spark, d).select("doc_id", S.is_complete(text, _kind()).alias("complete"), S.is_protected(text, _kind()).alias("protected"))


@query(rf"""
with n as (select doc_id, text, len(regexp_extract_all(text, '(?im){_P["SECTION_MARKS"]}')) + len(regexp_extract_all(text, '(?im){_P["ARTICLE_MARKS"]}'))
  + len(text) - len(replace(text, '?', '')) + len(regexp_extract_all(text, '(?m){_P["LIST_ITEM"]}')) as n,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) as sentences, regexp_matches(text, '(?m){_P["LIST_ITEM"]}') as listed from documents)
select doc_id, case when coalesce(text, '') = '' then 'unknown' when n >= 20 then 'high' when n >= 10 then 'medium' when n >= 5 then 'low' else 'minimal' end as complexity,
  case when words = 0 then 0.0::double else least(1.0::double, round(case when words / sentences <= 20 then 0.9::double when words / sentences <= 30 then 0.7 when words / sentences <= 40 then 0.5 else 0.3 end + case when listed then 0.1::double else 0 end, 6)) end as ease
from n
""")
def document_profile(spark, d):
    text = F.col("text")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    return _docs(spark, d).select("doc_id", S.complexity(text).alias("complexity"), S.ease(words, sentences, S.is_list(text)).alias("ease"))


def _terms(lang: str) -> str:
    return "[" + ", ".join(f"'{t}'" for t in R.DOMAIN_TERMS[lang]) + "]"


@query(f"""
with d as (select doc_id, lower(text) as low, lang, {_KIND} as kind from documents)
select doc_id, array_to_string(list_sort(list_distinct(list_concat(case when kind <> 'general' then [kind] else [] end,
  coalesce(list_filter(case lang when 'it' then {_terms('it')} when 'en' then {_terms('en')} else [] end, lambda t: contains(low, t)), [])))), ',') as keywords from d
""")
def topic_keywords(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(S.keywords(F.col("text"), _kind(), F.col("lang")), ",").alias("keywords"))


_LIMITS = " ".join(f"when contains(model, '{k}') then {n}" for k, n in R.MODEL_LIMITS)


@query(f"""
with m as (select doc_id, len(text) as n, case doc_id % 5 when 0 then 'openrouter/qwen-2.5-72b' when 1 then 'microsoft/Phi-4' when 2 then 'gpt-4o' when 3 then 'GPT-3.5-turbo' else 'other/model' end as name from documents),
l as (select *, lower(name) as model from m), k as (select *, case {_LIMITS} end as token_limit from l)
select doc_id, name as model, token_limit::int as token_limit, coalesce(n / 4 > token_limit * 0.8, false) as too_long, contains(model, 'qwen') as is_qwen, contains(model, 'phi') as is_phi, starts_with(name, 'openrouter/') as is_hosted from k
""")
def model_limits(spark, d):
    n = F.col("doc_id") % 5
    name = F.when(n == 0, "openrouter/qwen-2.5-72b").when(n == 1, "microsoft/Phi-4").when(n == 2, "gpt-4o").when(n == 3, "GPT-3.5-turbo").otherwise("other/model")
    rows = _docs(spark, d).select("doc_id", "text", name.alias("model"))
    m = F.col("model")
    return rows.select("doc_id", "model", M.token_limit(m).alias("token_limit"), M.too_long(F.col("text"), m).alias("too_long"), M.is_qwen(m).alias("is_qwen"), M.is_phi(m).alias("is_phi"), M.is_hosted(m).alias("is_hosted"))


@query(r"""
with w as (select l_orderkey as doc, l_linenumber as page, l_quantity * 15 + 30.0 as top, l_partkey % 400 as x0, l_comment as text from
  (select *, l_returnflag || '-' || l_suppkey::varchar as l_comment from lineitem)),
k as (select * from w where not (top < 50 or top > 800 - 50))
select doc, string_agg(text, ' ' order by top, x0, text) as text, count(*) as n_words from k group by doc
""")
def reading_order(spark, d):
    """Words of a page, one for each line item, read from the top left with header and footer left out."""
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), (F.col("l_quantity") * 15 + 30.0).alias("top"), (F.col("l_partkey") % 400).alias("x0"), F.concat("l_returnflag", F.lit("-"), F.col("l_suppkey").cast("string")).alias("text"))
    kept = words.where(~P.is_header_footer(F.col("top"), F.lit(800.0)))
    return P.read_in_order(kept, ["doc"]).select("doc", "text", "n_words")


_GRID = """
with g as (select s_nationkey as nation, s_suppkey as k, case when s_suppkey % 4 = 0 then null else s_name end as a, ' ' as b, case when s_suppkey % 3 = 0 then '' else round(s_acctbal, 2)::varchar end as c, case when s_suppkey % 5 = 0 then null else 'x' || s_suppkey::varchar end as e from supplier)
"""


@query(_GRID + """
, p as (select nation, unnest([struct_pack(h := 'Supplier Name', v := trim(a)), struct_pack(h := 'Amount', v := nullif(c, '')), struct_pack(h := 'Column_3', v := e)], recursive := true) from g)
select nation, h as header, count(*) as n, md5(string_agg(v, '|' order by v)) as digest from p where v is not null group by nation, h
""")
def table_records(spark, d):
    """A table for each nation: a title row, a header row with dashes and a blank, an empty column, empty cells."""
    rows = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("nation"),
        F.col("s_suppkey").alias("k"),
        F.array(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")), F.lit(" "), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.round("s_acctbal", 2).cast("string")), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("x"), F.col("s_suppkey").cast("string")))).alias("cells"),
    )
    grids = rows.groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("k", "cells"))).alias("g"))
    top = F.array(F.array(F.lit("2024"), F.lit(None), F.lit(None), F.lit(None)), F.array(F.lit("- Supplier Name -"), F.lit(None), F.lit("Amount"), F.lit(None))).cast("array<array<string>>")
    read = grids.select("nation", S.records(F.concat(top, F.transform("g", lambda x: x["cells"]))).alias("t"))
    cells = read.select("nation", F.explode("t.records").alias("m")).select("nation", F.explode("m").alias("header", "v"))
    return cells.groupBy("nation", "header").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("v")), "|").cast("binary")).alias("digest"))


@query("""
select l_returnflag as doc, l_linenumber as page, count(*) as n_tables from lineitem where l_quantity % 10 = 0 group by all
""")
def tables_per_page(spark, d):
    found = table(spark, d, "lineitem").where(F.col("l_quantity") % 10 == 0).select(F.col("l_returnflag").alias("doc"), F.col("l_linenumber").alias("page"))
    return P.tables_per_page(found)


@query(r"""
with t as (select doc_id, 'front matter' || chr(10) || '1. First part' || chr(10) || text || chr(10) || 'GENERAL TERMS' || chr(10) || substr(text, 2, 90) || chr(10) || '1. First part ' || chr(10) || substr(text, 5, 30) as text from documents where text is not null),
l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from t),
h as (select *, regexp_matches(line, '^[0-9]+(\.[0-9]+)*[.)]? +\S') or (regexp_matches(line, '^[A-Z][A-Z ]{4,}$')) as head from l),
s as (select *, sum(head::int) over (partition by doc_id order by i) as n from h),
g as (select doc_id, n, max(line) filter (head) as header, trim(coalesce(string_agg(line, ' ' order by i) filter (not head), '')) as content from s where n > 0 group by doc_id, n)
select doc_id, trim(header) as header, arg_max(substr(content, 1, 60), n) as preview from g group by doc_id, trim(header)
""")
def section_previews(spark, d):
    """Sections by numbered or capital headings, by name, the last of a name; the first 60 characters of each."""
    text = F.col("text")
    whole = F.concat(F.lit("front matter\n1. First part\n"), text, F.lit("\nGENERAL TERMS\n"), F.substring(text, 2, 90), F.lit("\n1. First part \n"), F.substring(text, 5, 30))
    return P.section_contents(_docs(spark, d).withColumn("text", whole)).select("doc_id", "header", F.substring("content", 1, 60).alias("preview"))


_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
_COMPLETE = f"""(not (ends_with(text, '...') or ends_with(text, '…')) and (regexp_matches(text, '[.!?][\\t\\n\\f\\r ]*$') or regexp_matches(text, '(?m){_P["LIST_ITEM"]}'))
    and case kind when 'definitions' then regexp_matches(text, '(?i){_P["DEFINES"]}') when 'procedures' then regexp_matches(text, '(?i){_P["PROCEDURE_OR_HOW"]}') else true end)"""


@query(rf"""
with d as (select doc_id, text, source as title, {_KIND} as kind, {_WORDS} as words, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) as sentences,
  len(list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: len(w) > 12)) as long_words, trim(coalesce(text, '')) <> '' as c, trim(coalesce(source, '')) <> '' as t from documents)
select doc_id, least(1.0::double, (t::int * 2 + coalesce(t and len(title) between 10 and 100, false)::int + coalesce(t and ends_with(title, '?'), false)::int
    + c::int * 2 + (c and len(text) between 150 and 1000)::int * 2 + (c and words >= 20)::int + (c and regexp_matches(text, '[.!?]'))::int + (c and not contains(text, '...') and not contains(text, '…'))::int * 2
    + (kind <> 'general')::int * 2 + (kind in ('definitions', 'procedures'))::int * 2 + {_COMPLETE}::int * 2 + (doc_id % 2 = 0)::int + (doc_id % 7 <> 0)::int) / 20.0::double) as score,
  case when words = 0 then 0.0::double else least(10, greatest(0, case when words / sentences <= 15 then 10 when words / sentences <= 25 then 8 when words / sentences <= 35 then 6 else 4 end
    + regexp_matches(text, '[.!?]')::int - case when 10 * long_words > words then 2 else 0 end)) / 10.0::double end as ease
from d where text is not null
""")
def chunk_scores(spark, d):
    text = F.col("text")
    word = F.lit(r"[^\x20\x09-\x0D]+")
    words, sentences = F.regexp_count(text, word), F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    long_words = F.size(F.filter(F.regexp_extract_all(text, word, F.lit(0)), lambda w: F.length(w) > 12))
    rows = spread(table(spark, d, "documents").select("doc_id", "text", "source").where("text is not null"))
    i = F.col("doc_id")
    return rows.select("doc_id", S.chunk_score(F.col("source"), text, _kind(), i % 2 == 0, i % 7 == 0).alias("score"), S.chunk_ease(words, sentences, long_words, text.rlike("[.!?]")).alias("ease"))


@query(f"""
with t as (select doc_id, 'n. ' || doc_id::varchar || chr(10) || case doc_id % 3 when 0 then 'Travel policy of ' || coalesce(source, '') || chr(10) when 1 then 'Policy' || chr(10) else '' end || coalesce(text, '') as text from documents),
l as (select doc_id, generate_subscripts(x, 1) as i, trim(unnest(x)) as line from (select doc_id, string_split(text, chr(10))[1:15] as x from t))
select t.doc_id, coalesce(arg_min(line, i) filter (len(line) between 11 and 199 and regexp_matches(upper(line), '{"|".join(R.TITLE_WORDS)}')), '') as title from t left join l on t.doc_id = l.doc_id group by t.doc_id
""")
def document_titles(spark, d):
    lead = F.concat(F.lit("n. "), F.col("doc_id").cast("string"), F.lit("\n"))
    named = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Travel policy of "), F.coalesce("source", F.lit("")), F.lit("\n"))).when(F.col("doc_id") % 3 == 1, "Policy\n").otherwise("")
    rows = table(spark, d, "documents").select("doc_id", F.concat(lead, named, F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select("doc_id", S.document_title(F.col("text")).alias("title"))


@query(r"""
with t as (select doc_id, chr(65279) || chr(10) || ' ' || chr(10) || chr(9) || coalesce(text, '') || ' ' || chr(10) || chr(10) as text from documents),
b as (select doc_id, array_to_string(list_transform(string_split(replace(text, chr(65279), ''), chr(10)), lambda x: regexp_replace(x, '^[\t\f\r ]+|[\t\f\r ]+$', '', 'g')), chr(10)) as text from t)
select doc_id, md5(regexp_replace(text, '^\n+|\n+$', '', 'g')) as digest from b
""")
def converted_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("﻿\n \n\t"), F.coalesce("text", F.lit("")), F.lit(" \n\n")).alias("text"))
    return rows.select("doc_id", F.md5(S.converted(F.col("text")).cast("binary")).alias("digest"))


@query(r"""
with p as (select doc_id, 'dir.x/' || case doc_id % 4 when 0 then '12-' || doc_id::varchar || '_policy.pdf' when 1 then doc_id::varchar || '_a_b.TXT' when 2 then 'policy_' || doc_id::varchar || '.pdf' else doc_id::varchar || '.doc' end as path from documents),
s as (select doc_id, path, regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') as stem from p)
select doc_id, coalesce(nullif(regexp_extract(stem, '^([\d-]+)_', 1), ''), stem) as policy_id, coalesce(nullif(regexp_extract(stem, '^(\d+)_', 1), ''), stem) as index_policy_id,
  case when ends_with(lower(path), '.pdf') then 'pdf' when ends_with(lower(path), '.txt') then 'txt' else 'unknown' end as file_type from s
""")
def policy_paths(spark, d):
    i, n = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    name = F.when(n == 0, F.concat(F.lit("12-"), i, F.lit("_policy.pdf"))).when(n == 1, F.concat(i, F.lit("_a_b.TXT"))).when(n == 2, F.concat(F.lit("policy_"), i, F.lit(".pdf"))).otherwise(F.concat(i, F.lit(".doc")))
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("dir.x/"), name).alias("path"))
    path = F.col("path")
    return rows.select("doc_id", T.policy_id(path).alias("policy_id"), T.index_policy_id(path).alias("index_policy_id"), T.file_type(path).alias("file_type"))


@query(r"""
with l as (select user_id as doc, event_id as i, case when event_id % 3 = 0 then '--- Page ' || (event_id % 50)::varchar || ' ---' else 'line ' || event_id::varchar end as line from events),
n as (select *, try_cast(nullif(regexp_extract(line, '^-{3} Page ([0-9]+) -{3}$', 1), '') as int) as page from l)
select doc, i, coalesce(last_value(page ignore nulls) over (partition by doc order by i rows between unbounded preceding and current row), 1) as page from n
""")
def page_numbers(spark, d):
    n = F.col("event_id")
    line = F.when(n % 3 == 0, F.concat(F.lit("--- Page "), (n % 50).cast("string"), F.lit(" ---"))).otherwise(F.concat(F.lit("line "), n.cast("string")))
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc"), n.alias("i"), line.alias("line"))
    return L.carried_pages(rows, ["doc"], "i", F.col("line")).select("doc", "i", "page")


@query(r"""
with h as (select user_id as doc, event_id as i, (event_id * 7 % 11 % 4 + 1)::int as level, 'T' || event_id::varchar as title from events),
p as (select a.doc, a.i, a.level, b.level as l, max(b.i) as at from h a join h b on a.doc = b.doc and b.i <= a.i and b.level <= a.level group by all),
c as (select p.*, (select coalesce(max(x.i), -1) from h x where x.doc = p.doc and x.i <= p.i and x.level < p.l) as cut from p)
select c.doc, c.i, string_agg(h.title, ' > ' order by c.l) as path from c join h on h.doc = c.doc and h.i = c.at where c.at > c.cut group by c.doc, c.i
""")
def heading_paths(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc"), n.alias("i"), (n * 7 % 11 % 4 + 1).cast("int").alias("level"), F.concat(F.lit("T"), n.cast("string")).alias("title"))
    return L.heading_paths(rows, ["doc"], "i", "level", "title").select("doc", "i", "path")


@query("""
with s as (select l_orderkey as doc, l_partkey % 2000 as "start", l_partkey % 2000 + l_quantity::bigint * 3 as "end" from lineitem),
o as (select *, max("end") over (partition by doc order by "start", "end" rows between unbounded preceding and 1 preceding) as reach from s),
n as (select *, sum(case when reach is null or "start" - reach >= 100 then 1 else 0 end) over (partition by doc order by "start", "end" rows unbounded preceding) as n from o)
select doc, min("start") as "start", max("end") as "end" from n group by doc, n
""")
def merged_spans(spark, d):
    start = F.col("l_partkey") % 2000
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 3).alias("end"))
    return L.merged_spans(rows, ["doc"]).select("doc", "start", "end")


@query("""
with r as (select event_type, user_id, event_id, row_number() over (partition by event_type, user_id order by event_id) as r from events)
select event_type, user_id, count(*) as n, string_agg(event_id::varchar, ',' order by r) filter (r <= 3) as contexts from r group by all having count(*) >= 2
""")
def first_contexts(spark, d):
    rows = table(spark, d, "events").select("event_type", "user_id", "event_id", F.col("event_id").cast("string").alias("context"))
    return L.first_contexts(rows, ["event_type", "user_id"], "event_id", "context").withColumn("contexts", F.array_join("contexts", ","))
