"""Entities by pattern, their frequency, and pairs of sentences or documents that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import lexicon as X
from quillstone.functions import text as T


def found(text: Column, patterns: tuple[str, ...]) -> Column:
    every = "|".join(f"(?:{p})" for p in patterns)
    return F.regexp_extract_all(text, F.lit(T.edged(f"(?iu){every}")), F.lit(0))


def mentions(docs: DataFrame, classes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, kind, entity (lower case) of every mention."""
    kinds = classes or X.ENTITIES

    def of(kind: str, patterns: tuple[str, ...]) -> Column:
        return F.transform(found(F.col("text"), patterns), lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("entity")))

    all_ = F.flatten(F.array(*(of(k, p) for k, p in kinds.items())))
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(all_).alias("e")).select("doc_id", "e.kind", "e.entity")


def frequent(mentioned: DataFrame, least: int = 2) -> DataFrame:
    return mentioned.groupBy("doc_id", "kind", "entity").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def co_mentions(mentioned: DataFrame) -> DataFrame:
    """kind pairs that share a document, with the number of documents: kinds are few, so a document gives a bounded number of pairs."""
    kinds = mentioned.groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("k"))
    first = kinds.select("k", F.posexplode("k").alias("i", "a"))
    pairs = first.select("a", F.explode(F.expr("slice(k, i + 2, size(k))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
