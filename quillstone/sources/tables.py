"""Readers. Schemas are given, never inferred, where the format does not carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents and questions as the engine works on them.
DOCUMENT = "doc_id long, policy_id string, path string, file_type string, text string"
QUESTION = "Id string, Questions string"
PREDICTIONS = "policy_id string, questions array<struct<request_id:string,question:string,outcome:string,outcome_justification:string,payment_justification:string>>"
GROUND_TRUTH = (
    "policy_id string, policy_requests array<struct<request:struct<request_id:string,content:string>,"
    "responses:array<struct<updated_at:string,response_outcome:string,response_outcome_justification:string,payout_justification:string>>>>"
)
RESULT_TSV = "store string, question_id string, question string, eligibility string, eligibility_text string, amount string, amount_text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def policy_id(path: Column) -> Column:
    """Leading digits and hyphens of the file name before an underscore, else the whole name without its extension."""
    name = stem(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^([\d-]+)_", 1), F.lit("")), name)


def index_policy_id(path: Column) -> Column:
    """As policy_id, but of digits only: the index knows no hyphens in ids."""
    name = stem(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(\d+)_", 1), F.lit("")), name)


def file_type(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".txt"), "txt").otherwise("unknown")


def policy_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, policy_id, file_type, content of the .pdf and .txt files of a folder (not of its subfolders)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,txt}").option("recursiveFileLookup", "false").load(folder)
    return files.select("path", policy_id(F.col("path")).alias("policy_id"), file_type(F.col("path")).alias("file_type"), "content", "length")


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Text files whole: UTF-8, or Latin-1 where the bytes are not UTF-8."""
    files = policy_files(spark, folder).where("file_type = 'txt'")
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.select("path", "policy_id", "file_type", text.alias("text"))


def pages_to_text(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """doc, text: pages (doc, page, text) joined in order; blank pages are left out."""
    rows = pages.where(F.trim("text") != "").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return rows.select("doc", F.array_join(F.transform("p", lambda x: x["text"]), separator).alias("text"))


def questions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Result documents of a folder tree, one row for each question, with the run's partition columns from the path."""
    files = spark.read.schema(PREDICTIONS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "policy_*_results.json").json(path)
    found = F.col("_metadata.file_path")
    rows = files.select(found.alias("path"), F.posexplode("questions").alias("ord", "q"))
    return rows.select("path", *partition_of(F.col("path")), "ord", "q.*")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema(PREDICTIONS).option("multiLine", True).option("pathGlobFilter", "GT_policy_*.json").json(path)
    rows = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"GT_policy_([\w-]+)\.json", 1).alias("policy_id"), F.posexplode("questions").alias("ord", "q"))
    return rows.select("policy_id", "ord", "q.*")


def run_time(name: Column) -> Column:
    """A run folder name as a time; null if it is none. Two-digit years from 69 are of the last century."""
    read = F.try_to_timestamp(name, F.lit("dd-MM-yy--HH-mm-ss"))
    return F.when(F.year(read) >= 2069, read - F.expr("interval 100 years")).otherwise(read)


def partition_of(path: Column) -> list[Column]:
    """model, k, complete_policy, run_ts, prompt and policy_id of an experiment path model/{k=N|complete-policy}/time/prompt/policy_id_results.json."""
    part = lambda i: F.element_at(F.split(path, "/"), i)
    return [
        F.try_element_at(F.split(path, "/"), F.lit(-5)).alias("model"),
        F.nullif(F.regexp_extract(path, r"/k=(\d+)/", 1), F.lit("")).cast("int").alias("k"),
        F.contains(path, F.lit("/complete-policy/")).alias("complete_policy"),
        run_time(F.nullif(F.regexp_extract(path, r"/(\d{2}-\d{2}-\d{2}--\d{2}-\d{2}-\d{2})/", 1), F.lit(""))).alias("run_ts"),
        F.try_element_at(F.split(path, "/"), F.lit(-2)).alias("prompt"),
        F.nullif(F.regexp_extract(part(-1), r"policy_(?:id-)?([\d-]+)_", 1), F.lit("")).alias("policy_id"),
    ]


def result_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_TSV).option("sep", "\t").csv(path)


def newest_bundle(files: DataFrame) -> DataFrame:
    """kind and path of the newest evaluation file of each kind; files: path, kind, run_ts."""
    return files.groupBy("kind").agg(F.max_by("path", F.struct("run_ts", "path")).alias("path"))
