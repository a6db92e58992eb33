"""Mixing sources to target weights by hash thresholds, with DataFrame operations only.

Each source gets a target of words. A source is taken whole as many times as its target holds it; of the rest, the
documents whose hash lies below the source's threshold are taken once more. Thresholds come from histograms: words
summed by source and leading hash bits give the bucket that holds the budget's end, only the documents of that boundary
bucket are counted again by the following bits, and so on to the last bit. Nothing is sorted but one row for each
source and bucket. Budgets are nested: a larger target takes a superset.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; rows that repeat a doc_id
share one hash and so one fate; a source of size 0 has target 0; an empty table gives an empty mix. Other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import stored, table, words_of
from quillstone.session import numbered

#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Low bits left out at each level: 60 hash bits are resolved 12, 24 and 24 at a time.
LEVELS = (48, 24, 0)
#: A table of sources is broadcast up to so many rows, else joined by shuffle.
SMALL = 20_000


def hash60(key: Column) -> Column:
    """60 bits of the MD5 of the key's decimal text: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target. Water filling: targets in proportion to weights, none above most times its size.

    Each round caps the sources below the level and raises it for the others, until none is below: sums only, no source
    meets all others.
    """
    cap = F.lit(most) * F.col("source_size")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = numbered(sizes, [F.col("source").asc_nulls_last()], "rank").withColumn("weight", weight).withColumn("cap", cap)
    whole = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    goal, full, left, level = share * (whole["size"] or 0), 0.0, whole["weight"] or 0, None
    while left:
        level = (goal - full) / left
        got = rows.where(F.col("cap") / F.col("weight") < F.lit(level)).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
        still = (whole["weight"] or 0) - (got["weight"] or 0)
        if still == left:
            break
        full, left = got["cap"] or 0.0, still
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if left else F.col("cap")
    return rows.select("source", "source_size", target.alias("target"))


def _with_sources(docs: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    right = sources.withColumnRenamed("source", "__source")
    return docs.join(F.broadcast(right) if n <= SMALL else right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def thresholds(sized: DataFrame, goals: DataFrame, n: int) -> DataFrame:
    """goals with repeats (whole takes) and cut: documents with hash below it are taken once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("repeats", whole).withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    above = 60
    for low in LEVELS:
        inside = _with_sources(sized, state.select("source", "prefix"), n).where(F.shiftright("h", above) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("h", low).alias("b")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("b")
        sums = sums.withColumn("upto", F.sum("words").over(running)).withColumn("before", F.col("upto") - F.col("words"))
        left = state.select("source", "left").withColumnRenamed("source", "__source")
        edge = sums.join(F.broadcast(left) if n <= SMALL else left, F.col("source").eqNullSafe(F.col("__source"))).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("upto")))
        edge = edge.select(F.col("source").alias("__source"), "b", "before", "words")
        state = state.join(edge, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        state = state.withColumn("left", F.col("left") - F.coalesce("before", F.lit(0)))
        last = F.col("b") + F.when(F.col("words") - F.col("left") < F.col("left"), 1).otherwise(0) if low == 0 else F.col("b")
        state = stored(state.withColumn("prefix", F.coalesce(last, F.lit(-1).cast("long"))).drop("b", "before", "words"), "mix-level")
        above = low
    return state.select("source", "source_size", "target", "repeats", F.col("prefix").alias("cut"))


def plan(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs (doc_id, text, source)."""
    size = F.size(words_of(F.col("text"))).cast("long")
    sized = stored(docs.select("doc_id", "source", size.alias("size"), hash60(F.col("doc_id")).alias("h")), "mix-sizes")
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most), "mix-targets")
    n = goals.count()
    cuts = thresholds(sized, goals, n)
    return _with_sources(sized, cuts, n).withColumn("copies", F.col("repeats") + (F.col("h") < F.col("cut")).cast("long"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of docs. The cut is joined by source, so texts are not shuffled."""
    size = F.size(words_of(F.col("text"))).cast("long")
    sized = stored(docs.select("doc_id", "source", size.alias("size"), hash60(F.col("doc_id")).alias("h")), "mix-sizes")
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most), "mix-targets")
    n = goals.count()
    cuts = thresholds(sized, goals, n).select("source", "repeats", "cut")
    inner = docs.select(F.struct(*docs.columns).alias("__row"), F.col("source"), hash60(F.col("doc_id")).alias("h"))
    taken = _with_sources(inner, cuts, n).withColumn("copies", F.col("repeats") + (F.col("h") < F.col("cut")).cast("long"))
    return taken.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = plan(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


#: The same mix in SQL: there the documents of a source are sorted by hash and added up.
SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as h
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source asc nulls last) as rank
  from sized group by source),
weighed as (
  select *, 2.0::double * source_size as cap, [3, 1, 2][((rank - 1) % 3) + 1] as weight from sources),
filled as (
  select *, cap / weight as r,
         coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as full_,
         sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as open_,
         sum(source_size) over () as total
  from weighed),
levels as (select *, (1.5::double * total - full_) / open_ as level from filled),
goal as (select coalesce(arg_min(level, (r, rank)), 1e300) as level from levels where level <= r),
targets as (select source, source_size, least(cap, goal.level * weight) as target from weighed, goal),
parts as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as repeats,
         target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size as rest
  from targets),
hashes as (
  select source, h, sum(size) as words, sum(sum(size)) over (partition by source order by h) as upto
  from sized group by source, h),
cuts as (
  select h.source, max(h.h + case when upto - p.rest < p.rest - (upto - words) then 1 else 0 end) as cut
  from hashes h join parts p on h.source is not distinct from p.source
  where upto - words <= p.rest and p.rest < upto group by h.source)
select s.doc_id, s.size, p.source_size, round(p.target, 6) as target,
       cast(s.size * (p.repeats + case when s.h < c.cut then 1 else 0 end) as bigint) as taken
from sized s join parts p on s.source is not distinct from p.source
left join cuts c on s.source is not distinct from c.source
"""
