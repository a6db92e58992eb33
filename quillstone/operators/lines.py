"""Lines of documents in order: pages carried forward, paths of headings, nearby spans merged. Windows are by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_MARK = r"^-{3} Page ([0-9]+) -{3}$"


def carried_pages(lines: DataFrame, keys: list[str], order: str, line: Column, first: int = 1) -> DataFrame:
    """lines with the page that each stands on: the number of the last page mark at or above it, first before any."""
    number = F.nullif(F.regexp_extract(line, PAGE_MARK, 1), F.lit("")).cast("int")
    above = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("page", F.coalesce(F.last(number, ignorenulls=True).over(above), F.lit(first)))


def heading_paths(headings: DataFrame, keys: list[str], order: str, level: str, title: str, levels: int = 4) -> DataFrame:
    """headings (of levels from 1) with the path of titles from the top: of each higher level the last one above that no heading of a still higher level came after.

    One window for each level: a level's title counts while no heading of a smaller level has come since.
    """
    above = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(F.col(order).alias("at"), F.col(title).alias("title"))
    rows = headings
    for k in range(1, levels + 1):
        rows = rows.withColumn(f"__own{k}", F.last(F.when(F.col(level) == k, at), ignorenulls=True).over(above))
        rows = rows.withColumn(f"__cut{k}", F.coalesce(F.max(F.when(F.col(level) < k, F.col(order))).over(above), F.lit(-1)))
    part = lambda k: F.when((F.lit(k) <= F.col(level)) & (F.col(f"__own{k}.at") > F.col(f"__cut{k}")), F.col(f"__own{k}.title"))
    path = F.concat_ws(" > ", *(part(k) for k in range(1, levels + 1)))
    return rows.withColumn("path", path).drop(*(f"__{n}{k}" for n in ("own", "cut") for k in range(1, levels + 1)))


def merged_spans(spans: DataFrame, keys: list[str], gap: int = 100) -> DataFrame:
    """keys, start, end: spans (start, end) less than gap apart put together."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("__new", F.when(reach.isNull() | (F.col("start") - reach >= gap), 1).otherwise(0))
    numbered = opened.withColumn("__n", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__n")


def first_contexts(mentions: DataFrame, keys: list[str], order: str, context: str, n: int = 3, least: int = 2) -> DataFrame:
    """keys, n, contexts: mentions counted, with the first n contexts in order, for those with at least least of them."""
    ranked = mentions.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, context)))
    few = F.array_sort(F.collect_list(F.when(F.col("__r") <= n, F.struct("__r", context))))
    got = ranked.groupBy(*keys).agg(F.count("*").alias("n"), few.alias("f")).where(F.col("n") >= least)
    return got.select(*keys, "n", F.transform("f", lambda x: x[context]).alias("contexts"))
