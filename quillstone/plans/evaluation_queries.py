"""Evaluation analytics: labels hold actual (quality) and predicted (toxic) classes, events hold raw responses, orders stand for experiment files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import evaluate as E
from quillstone.plans.registry import group
from quillstone.session import numbered
from quillstone.sources import sinks, tables
from quillstone.sources.tables import table

QUERIES, SQL, query = group()


@query("select count(*) as n, count(*) filter (quality = toxic) as n_equal, round(avg((quality = toxic)::int), 6) as accuracy from labels")
def eval_accuracy(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").cast("string"), F.col("toxic").cast("string"))
    return E.accuracy(rows, "quality", "toxic").withColumn("accuracy", F.round("accuracy", 6))


@query("""
with g as (select a.x as actual, p.x as predicted from (values (0), (1)) a(x), (values (0), (1)) p(x))
select actual, predicted, count(quality) as n from g left join labels on quality = actual and toxic = predicted group by actual, predicted
""")
def confusion_matrix(spark, d):
    return E.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1])


@query("select quality as actual, toxic as predicted, count(*) as n from labels group by cube (quality, toxic)")
def confusion_totals(spark, d):
    return E.confusion_totals(table(spark, d, "labels"), "quality", "toxic")


_REPORT = """
with c as (select x as label, count(*) filter (quality = x and toxic = x) as tp, count(*) filter (toxic = x) as called, count(*) filter (quality = x) as support
           from labels, (values (0), (1)) l(x) group by x),
r as (select label::varchar as label, case when called = 0 then 0.0 else tp / called end as precision, case when support = 0 then 0.0 else tp / support end as recall, support from c),
f as (select label, precision::double as precision, recall::double as recall, case when precision + recall = 0 then 0.0::double else 2 * precision * recall / (precision + recall) end as f1, support from r)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from f
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from f
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from f
"""


@query(_REPORT)
def classification_report(spark, d):
    return E.report(table(spark, d, "labels"), "quality", "toxic", [0, 1]).select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("select l.doc_id, lang, quality, toxic, (quality = toxic) as is_match from documents d join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) l using (doc_id)")
def eval_join_inner(spark, d):
    truth = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, d, "documents").join(truth, "doc_id").select("doc_id", "lang", "quality", "toxic", (F.col("quality") == F.col("toxic")).alias("is_match"))


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def eval_unmatched(spark, d):
    return E.unmatched(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("select user_id, event_type, arg_max(event_id, event_id) as event_id, arg_max(round(value, 6), event_id) as value from events group by user_id, event_type")
def eval_duplicate_last_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"), F.col("event_id").alias("ord"))
    return E.last_of(rows, ["user_id", "event_type"], ["ord"]).drop("ord")


@query("""
with r as (select *, row_number() over (partition by user_id order by strftime(ts, '%Y-%m-%d %H:%M:%S') desc, event_id) as k from events)
select user_id as request_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as updated_at, event_id,
       case event_type when 'purchase' then 'Yes' when 'click' then 'No - Unrelated event' when 'view' then 'Maybe' else event_type end as outcome
from r where k = 1
""")
def latest_response(spark, d):
    codes = {"purchase": "Yes", "click": "No - Unrelated event", "view": "Maybe"}
    rows = table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "event_id", E.outcome_code(F.col("event_type"), codes).alias("outcome"), (-F.col("event_id")).alias("back"))
    return E.last_of(rows, ["request_id"], ["updated_at", "back"]).drop("back")


@query("""
with k as (select distinct case when event_id % 7 = 0 then event_type else user_id::varchar end as id from events)
select id, row_number() over (order by try_cast(case when regexp_full_match(id, '\\d{1,18}') then id end as bigint) asc nulls last, id) as rank from k
""")
def numeric_aware_sort_rank(spark, d):
    e = table(spark, d, "events")
    ids = e.select(F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("id")).distinct()
    return numbered(ids, E.numeric_order(F.col("id")), "rank")


_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


@query(f"""
with p as (select a.doc_id, {_WORDS.format('a.text')} as x, {_WORDS.format('b.text')} as y from documents a join documents b on b.doc_id = a.doc_id + 1)
select doc_id, round(case when len(x) = 0 and len(y) = 0 then 1.0 when len(x) = 0 or len(y) = 0 then 0.0
       else len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) end, 6) as iou from p
""")
def text_iou_pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(other, "doc_id").select("doc_id", F.round(T.word_iou(F.col("text"), F.col("other")), 6).alias("iou"))


@query("""
select p_partkey, round(case when greatest(len(p_name), len(p_brand || ' ' || p_type)) = 0 then 1.0
       else 1 - levenshtein(p_name, p_brand || ' ' || p_type) / greatest(len(p_name), len(p_brand || ' ' || p_type)) end, 6) as similarity from part
""")
def edit_similarity_pairs(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(T.edit_similarity(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type")), 6).alias("similarity"))


_OUT = "case o_orderkey % 5 when 0 then ' ' || o_orderstatus || ' ' when 1 then 'NULL ' when 2 then '  ' when 3 then 'None' else o_orderpriority end"


@query(f"select o_orderkey, case when lower(trim(x)) in ('', 'null', 'none') then null else trim(x) end as outcome from (select o_orderkey, {_OUT} as x from orders)")
def normalize_outcomes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.normalise(F.expr(_OUT)).alias("outcome"))


_PATHS = """(select o_orderkey, o_custkey, o_orderpriority, 'model-' || o_orderstatus || '/' ||
  case when o_orderkey % 3 = 0 then 'complete-policy' else 'k=' || (o_orderkey % 9) end || '/' ||
  case when o_orderkey % 11 = 0 then 'latest' else {stamp} end || '/' || lower(o_orderpriority) || '/policy_' || (o_custkey % 40) || '_results.json' as path from orders)"""
_SQL_PATHS = _PATHS.format(stamp="strftime(o_orderdate, '%d-%m-%y--%H-%M-%S')")
_SPARK_PATHS = _PATHS.format(stamp="date_format(o_orderdate, 'dd-MM-yy--HH-mm-ss')")
_PARSED = f"""
select o_orderkey, split_part(path, '/', 1) as model, try_cast(nullif(regexp_extract(path, '/k=(\\d+)/', 1), '') as integer) as k,
       contains(path, '/complete-policy/') as complete_policy,
       strftime(try_strptime(nullif(regexp_extract(path, '/(\\d{{2}}-\\d{{2}}-\\d{{2}}--\\d{{2}}-\\d{{2}}-\\d{{2}})/', 1), ''), '%d-%m-%y--%H-%M-%S'), '%Y-%m-%d %H:%M:%S') as run_ts,
       split_part(path, '/', 4) as prompt, nullif(regexp_extract(path, 'policy_(?:id-)?([\\d-]+)_', 1), '') as policy_id
from {_SQL_PATHS}
"""


def _partitions(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders_for_paths")
    paths = spark.sql(f"select o_orderkey, path from {_SPARK_PATHS.replace('from orders)', 'from orders_for_paths)')}")
    return paths.select("o_orderkey", *tables.partition_of(F.col("path"))).withColumn("run_ts", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss"))


@query(_PARSED)
def partition_path_parse(spark, d):
    return _partitions(spark, d)


@query(f"""
with p as ({_PARSED}), r as (select *, row_number() over (partition by model, policy_id order by run_ts desc nulls last, o_orderkey) as n from p)
select model, policy_id, run_ts, o_orderkey from r where n = 1
""")
def latest_partition(spark, d):
    order = F.struct(F.coalesce("run_ts", F.lit("")), -F.col("o_orderkey"))
    got = _partitions(spark, d).groupBy("model", "policy_id").agg(F.max_by(F.struct("run_ts", "o_orderkey"), order).alias("r"))
    return got.select("model", "policy_id", "r.run_ts", "r.o_orderkey")


@query("""
select o_orderpriority as model, count(*) as total, count(*) filter (o_orderstatus = 'F') as matches,
       round(avg((o_orderstatus = 'F')::int) * 100, 6) as match_percent, round(avg(o_totalprice), 4) as mean_score from orders group by 1
""")
def summary_means(spark, d):
    o = table(spark, d, "orders").withColumn("is_match", F.col("o_orderstatus") == "F")
    return o.groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("total"), F.count_if("is_match").alias("matches"), F.round(F.avg(F.col("is_match").cast("double")) * 100, 6).alias("match_percent"), F.round(F.avg("o_totalprice"), 4).alias("mean_score"))


@query("""
with s as (select l_returnflag as model, avg(l_quantity) as quantity, avg(l_discount) as discount, avg(l_tax) as tax from lineitem group by 1),
l as (select model, 'quantity' as metric, quantity as v from s union all select model, 'discount', discount from s union all select model, 'tax', tax from s)
select metric, round(max(v) filter (model = 'A'), 6) as "A", round(max(v) filter (model = 'N'), 6) as "N", round(max(v) filter (model = 'R'), 6) as "R" from l group by metric
""")
def compare_models(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return E.compare(s, ["quantity", "discount", "tax"], ["A", "N", "R"]).select("metric", *(F.round(c, 6).alias(c) for c in ("A", "N", "R")))


@query("""
select conv_id, count(*) as n, string_agg(role || ':' || turn, '|' order by turn, role, text) as questions from conversations group by conv_id
""")
def nest_results(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("q"))
    return rows.select("conv_id", "n", F.array_join(F.transform("q", lambda x: F.concat_ws(":", x["role"], x["turn"].cast("string"))), "|").alias("questions"))


@query("""
select conv_id, turn, case role when 'user' then 'APPROVED' when 'system' then 'UNDECIDED' else 'REJECTED' end as status from conversations
""")
def review_rows(spark, d):
    outcome = F.when(F.col("role") == "user", "Yes").when(F.col("role") == "system", "Maybe").otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", sinks.review_status(outcome).alias("status"))


@query("""
select l_returnflag as model, case when count(distinct l_linestatus) = 1 then max(l_linestatus) else 'multiple' end as k, count(*) as n from lineitem group by 1
""")
def collapse_distinct(spark, d):
    seen = F.collect_set("l_linestatus")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.when(F.size(seen) == 1, seen[0]).otherwise("multiple").alias("k"), F.count("*").alias("n"))
