"""Answers and reports: verified answers, model personas, presets, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import persona_model as M
from quillstone.operators import presets, reports
from quillstone.plans import document_queries as D
from quillstone.plans.registry import group
from quillstone.plans.verify import verify
from quillstone.session import spread
from quillstone.sources.tables import table

QUERIES, SQL, query = group()


@query("""
with a as (select conv_id, turn, text, case turn % 2 when 0 then 'Yes' else 'No - condition(s) not met' end as e,
  case turn % 3 when 0 then substr(text, 3, 20) when 1 then 'not in there ' || conv_id::varchar end as o,
  case conv_id % 2 when 0 then substr(text, 1, 5) else 'CHF ' || turn::varchar end as p from conversations),
k as (select *, case when contains(coalesce(text, ''), coalesce(o, '')) then coalesce(o, '') else '' end as o2, case when p <> '' and contains(coalesce(text, ''), p) then p end as p2 from a),
v as (select *, case when e = 'Yes' and o2 = '' then 'No - Unrelated event' else e end as e2 from k),
c as (select *, concat_ws(', ', case when e2 <> e then 'eligibility' end, case when o2 <> coalesce(o, '') then 'outcome_justification' end, case when coalesce(p2, '') <> coalesce(p, '') then 'payment_justification' end) as changes from v)
select conv_id, turn, e2 as eligibility, md5(o2) as digest, p2 as payment_justification, case when changes = '' then 'confirmed' else 'corrected' end as status, case when changes = '' then 'none' else changes end as changes_made from c
""")
def verified_answers(spark, d):
    """Answers made up for every turn, some of them not quoted from it, through two rounds of verification."""
    turn, conv = F.col("turn"), F.col("conv_id")
    rows = table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("context"),
        F.when(turn % 2 == 0, "Yes").otherwise("No - condition(s) not met").alias("eligibility"),
        F.when(turn % 3 == 0, F.substring("text", 3, 20)).when(turn % 3 == 1, F.concat(F.lit("not in there "), conv.cast("string"))).alias("outcome_justification"),
        F.when(conv % 2 == 0, F.substring("text", 1, 5)).otherwise(F.concat(F.lit("CHF "), turn.cast("string"))).alias("payment_justification"),
    )
    out = verify(rows, iterations=2)
    return out.select("conv_id", "turn", "eligibility", F.md5(F.col("outcome_justification").cast("binary")).alias("digest"), "payment_justification", "status", "changes_made")


@query(r"""
with e as (select event_id as i, case when event_id % 3 <> 0 then 'policyholder ' || event_type end as u,
  case event_id % 4 when 1 then 'my wife in the hotel' when 2 then 'Self' when 3 then 'a child' end as a, case when event_id % 5 = 0 then 'somewhere in Asia' end as l,
  case when event_id % 2 = 0 then 'met at the airport' end as r, case when event_id % 7 = 0 then 'Spouse' end as k, case when event_id % 6 = 0 then false end as ab,
  case when event_id % 8 = 0 then true end as c, event_id % 10 - 1 as t, case when event_id % 11 <> 0 then event_id % 7 end as n from events),
x as (select *, case when t between 1 and 5 then t else 1 end as total, coalesce(u, 'policyholder (individual)') as policy_user from e),
y as (select *, coalesce(a, policy_user || ' (inferred)') as affected_person from x),
z as (select *, lower(affected_person) || ' ' || lower(coalesce(r, '')) as ctx from y),
q as (select *, coalesce(l, case when contains(ctx, 'airport') then 'airport' when regexp_matches(ctx, 'hotel|resort') then 'hotel/resort' when regexp_matches(ctx, 'hospital|clinic') then 'hospital/medical facility'
    when regexp_matches(ctx, 'home|house') then 'home' when regexp_matches(ctx, 'abroad|foreign|overseas|international') then 'abroad (unspecified location)' else 'unspecified location' end) as location,
  coalesce(k, case when lower(affected_person) = lower(policy_user) or contains(lower(affected_person), 'self') then 'self' when regexp_matches(lower(affected_person), 'spouse|wife|husband|partner') then 'spouse/partner'
    when regexp_matches(lower(affected_person), 'child|son|daughter') then 'child/dependent' when regexp_matches(lower(affected_person), 'parent|father|mother') then 'parent' else 'unknown (inferred)' end) as kin from z)
select i as event_id, policy_user, affected_person, location, coalesce(ab, regexp_matches(lower(location), 'abroad|foreign|overseas|international|europe|asia|america|africa|australia')) as is_abroad,
  kin as relationship_to_policyholder, coalesce(c, regexp_matches(lower(kin), 'self|spouse|partner|child|dependent')) as is_affected_covered, total::int as total_count, coalesce(case when n > total then total else n end, 1)::int as claimant_count from q
""")
def model_personas(spark, d):
    """Replies with gaps and impossible counts, one for each event, read and made whole."""
    i = F.col("event_id")
    fields = F.struct(
        F.when(i % 3 != 0, F.concat(F.lit("policyholder "), "event_type")).alias("policy_user"),
        F.when(i % 4 == 1, "my wife in the hotel").when(i % 4 == 2, "Self").when(i % 4 == 3, "a child").alias("affected_person"),
        F.when(i % 5 == 0, "somewhere in Asia").alias("location"),
        F.when(i % 2 == 0, "met at the airport").alias("relationship"),
        F.when(i % 7 == 0, "Spouse").alias("relationship_to_policyholder"),
        F.when(i % 6 == 0, False).alias("is_abroad"),
        F.when(i % 8 == 0, True).alias("is_affected_covered"),
        (i % 10 - 1).alias("total_count"),
        F.when(i % 11 != 0, i % 7).alias("claimant_count"),
    )
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct(fields.alias("personas"))).alias("said")).withColumn("p", M.read(F.col("said")))
    return rows.select("event_id", *(c.alias(k) for k, c in M.whole(F.col("p")).items() if k not in ("mentioned_people", "relationship")))


@query(D.packed_words(256) + D.overlapped(25, "' '", False) + "select doc_id, chunk_ord, md5(chunk) as digest from o")
def preset_fast_chunks(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return presets.chunk_by_preset(docs, "fast").select("doc_id", "chunk_ord", F.md5(F.col("text").cast("binary")).alias("digest"))


_CHUNKS = """
with c as (select doc_id, source, coalesce(n_chars, 0) % 101 / 100.0 as quality, coalesce(n_chars, 0) % 67 / 66.0 as readability, doc_id % 3 <> 0 as has_context,
  case doc_id % 5 when 0 then 'coverage' when 1 then 'exclusions' else 'general' end as kind from documents)
"""


def _chunks(spark, d):
    n, i = F.coalesce("n_chars", F.lit(0)), F.col("doc_id")
    kind = F.when(i % 5 == 0, "coverage").when(i % 5 == 1, "exclusions").otherwise("general")
    return table(spark, d, "documents").select(i.alias("chunk_id"), "source", (n % 101 / 100.0).alias("quality"), (n % 67 / 66.0).alias("readability"), (i % 3 != 0).alias("has_context"), kind.alias("kind"))


def _step(name: str, value: str) -> str:
    above = ">" if name == "general_share" else ">="
    return f"(select '{name}' as measure, ({' + '.join(f'({value} {above} {b})::int' for b in reports.STEPS[name])})::int as step from c)"


@query(_CHUNKS + " union all ".join(_step(n, v) for n, v in (("quality", "avg(quality)"), ("high_quality_share", "avg((quality >= 0.8)::int)"), ("readability", "avg(readability)"), ("context_share", "avg(has_context::int)"), ("general_share", "avg((kind = 'general')::int)"))))
def quality_recommendations(spark, d):
    return reports.recommendations(reports.chunk_quality(_chunks(spark, d))).select("measure", "step")


@query(_CHUNKS + "select doc_id as chunk_id, quality::double as quality from c order by c.quality desc, doc_id limit 5")
def top_quality_chunks(spark, d):
    """A report of the five best chunks."""
    return reports.best_chunks(_chunks(spark, d)).select("chunk_id", F.col("quality").cast("double").alias("quality"))


@query("""
with d as (select doc_id, source, list_distinct(list_filter(string_split(lower(substr(text, 1, 40)), ' '), lambda x: x <> '')) as a, list_distinct(list_filter(string_split(lower(substr(text, 21, 40)), ' '), lambda x: x <> '')) as b from documents where text is not null),
i as (select source, len(list_intersect(a, b)) as n, len(list_distinct(list_concat(a, b))) as u from d)
select source, count(*) as n, round(avg(case when u = 0 then 0.0 else n / u end), 6) as average_iou, count(*) filter (u > 0 and n = u) as n_same from i group by source
""")
def iou_report(spark, d):
    """Overlap of two stretches of each text by source, as a report has it."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda x: x != ""))
    a, b = words(F.substring("text", 1, 40)), words(F.substring("text", 21, 40))
    union = F.size(F.array_union(a, b))
    detail = table(spark, d, "documents").where("text is not null").select("source", F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union).alias("justification_iou"))
    return reports.iou_report(detail, ["source"]).select("source", "n", F.round("average_iou", 6).alias("average_iou"), "n_same")
