"""Retrieval over the embeddings table: vec_id divisible by 20 asks, all rows answer; label stands for the policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import vector as V
from quillstone.plans.registry import group
from quillstone.sources.tables import table

QUERIES, SQL, query = group()


def _tables(spark, d):
    e = table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    rows = e.select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("policy"))
    asked = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("policy"))
    return asked, rows


_TOPK = """
with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
s as (select q.vec_id as query_id, r.vec_id, round({score}, 9) as score
      from e q join e r on q.vec_id <> r.vec_id {mask} where q.vec_id % 20 = 0),
k as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, round(score, 6) as score from k where rank <= 3
"""
_COS = "list_cosine_similarity(q.v, r.v)"


def _six(df):
    return df.withColumn("score", F.round("score", 6))


@query(_TOPK.format(score=_COS, mask=""))
def retrieve_topk(spark, d):
    return _six(V.retrieve(*_tables(spark, d)))


@query(_TOPK.format(score=_COS, mask="and q.label = r.label"))
def retrieve_topk_masked(spark, d):
    return _six(V.retrieve(*_tables(spark, d), masked=True))


@query(_TOPK.format(score=f"case when q.label = r.label then {_COS} else -1 end", mask=""))
def retrieve_topk_compat(spark, d):
    return _six(V.retrieve(*_tables(spark, d), masked=True, compat=True))


@query("""
select label, cast(i - 1 as integer) as pos, round(avg(cast(embedding[i] as double)), 6) as value
from embeddings, unnest(generate_series(1, len(embedding))) as t(i) group by label, i
""")
def label_centroids(spark, d):
    got = V.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return got.select("label", "pos", F.round("value", 6).alias("value"))


@query("""
with c as (select label, i, avg(cast(embedding[i] as double)) as x from embeddings, unnest(generate_series(1, len(embedding))) as t(i) group by label, i),
v as (select label, list(x order by i) as c from c group by label),
s as (select e.label, vec_id, round(list_cosine_similarity(cast(embedding as double[]), c), 9) as score from embeddings e join v using (label)),
k as (select *, row_number() over (partition by label order by score desc, vec_id) as rank from s)
select label, vec_id, cast(rank as integer) as rank, round(score, 6) as score from k where rank <= 10
""")
def centroid_top10(spark, d):
    got = V.nearest_to_centroid(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 10)
    return got.select("label", "vec_id", "rank", F.round("score", 6).alias("score"))


_NEXT = """
with n as (select label, vec_id, cast(embedding as double[]) as v,
  lead(cast(embedding as double[])) over (partition by label order by vec_id) as w from embeddings),
x as (select label, vec_id, 1 - list_cosine_similarity(v, w) as distance from n where w is not null)
"""


def _distances(spark, d):
    return V.neighbour_distances(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding")


@query(_NEXT + "select label, vec_id, round(distance, 6) as distance from x")
def adjacent_distance(spark, d):
    return _distances(spark, d).select("label", "vec_id", F.round("distance", 6).alias("distance"))


@query(_NEXT + "select label, round(quantile_cont(distance, 0.75), 6) as threshold from x group by label")
def distance_percentile(spark, d):
    return _distances(spark, d).groupBy("label").agg(F.round(F.percentile("distance", F.lit(0.75)), 6).alias("threshold"))


@query(_NEXT + """, t as (select label, quantile_cont(distance, 0.75) as threshold from x group by label)
select x.label, vec_id, round(distance, 6) as distance from x join t using (label) where round(distance, 9) > round(threshold, 9)
""")
def semantic_breaks(spark, d):
    return V.breakpoints(_distances(spark, d), "label").select("label", "vec_id", F.round("distance", 6).alias("distance"))


@query("""
select label, count(*) as n, count(distinct vec_id) as n_ids, min(len(embedding)) as least_dim, max(len(embedding)) as most_dim,
       round(avg(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])))), 6) as mean_norm
from embeddings group by label
""")
def index_statistics(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("n_ids"), F.min(F.size("embedding")).cast("long").alias("least_dim"), F.max(F.size("embedding")).cast("long").alias("most_dim"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"))
