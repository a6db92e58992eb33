"""Corpus pipeline: quality rules, near-duplicate removal, repeated-passage removal, mixing, and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. The check and a production run write each stage's rows before the next one reads them; run() does so in
the shared folder of the cluster, so a lost executor repeats part of one stage and no more.

Defined cases, for every stage: an empty table gives an empty one; any column but text, doc_id and source may be null or
hold anything and passes, whatever its name; very long texts are read whole. What a stage does with nulls in those three,
ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import byte_bpe, jaccard_join, mixing, quality_rules, suffix_dedup
from quillstone.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go.

    A null or empty text fails the base rule. Rows are judged by their text alone, so rows that repeat one share its fate; a
    null doc_id is judged like any other. Without labels of both kinds the base rule decides.
    """
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at similarity 0.8 or more, one of each group stays.

    That of the least doc_id; of several rows of that id the one with the least hash. Of rows that repeat id and text one
    stays; two texts of one id are two documents. Rows without words, and rows with a null doc_id, stay.
    """
    return jaccard_join.one_of_each(docs, size=5, num=8, den=10)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of 100 bytes or more that also stand earlier go; n_chars follows the text.

    Earlier is by doc_id, null last, then by a hash of the text; rows that repeat both are one document and lose the same
    bytes. A null text stays null with a null n_chars; a text may become empty. A character cut at an edge goes whole.
    """
    return suffix_dedup.remove(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source, the last one; a null text has no words and is taken as its hash falls. Rows that repeat a
    doc_id (null too) share one hash and one fate. A document may leave, stay, or stand twice.
    """
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their count and the hash of what they decode to.

    Every row gives one row; a null text has no ids and the hash of nothing. Ids, languages and sources pass as they are.
    """
    coded = byte_bpe.encode_and_check(docs.select("doc_id", "lang", "source", "text"), *byte_bpe.public_vocabulary())
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixture),
    ("byte_bpe", encoded),
]

#: Learned rules, similarity joins and suffix sorting are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
