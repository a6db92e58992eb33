"""Command line: answer questions over a folder of policies, evaluate results, overlap reports, tables, and conversion of files.

    python -m quillstone.cli answer --documents DIR --questions-file CSV --output-dir DIR [options]
    python -m quillstone.cli evaluate --predictions DIR --truth DIR --output-dir DIR
    python -m quillstone.cli overlap --predictions DIR --truth DIR --output-dir DIR
    python -m quillstone.cli convert --documents DIR --output-dir DIR --parser module:function
"""

from __future__ import annotations

import argparse
import importlib
import logging
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import client, prompt_texts
from quillstone.operators import evaluate, presets, reports
from quillstone.plans import answer
from quillstone.plans.verify import verify
from quillstone.sources import pages, sinks, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillstone")
    parts = top.add_subparsers(dest="task", required=True)
    a = parts.add_parser("answer")
    a.add_argument("--documents", required=True)
    a.add_argument("--questions-file", required=True)
    # The options of an answering run, by their public names.
    a.add_argument("--model", choices=client.PROVIDERS, default=None)
    a.add_argument("--model-name", default="microsoft/phi-4")
    a.add_argument("--batch", action="store_true", help="all policies in one run; without it only those of --policy-id, or each by itself")
    a.add_argument("--num-questions", type=int)
    a.add_argument("--output-dir", required=True)
    a.add_argument("--prompt", default="standard")
    a.add_argument("--log-level", choices=("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), default="INFO")
    a.add_argument("--persona", action="store_true")
    a.add_argument("--questions", help="ids, apart by commas")
    a.add_argument("--policy-id")
    a.add_argument("--k", type=int, default=3)
    a.add_argument("--filter-irrelevant", action="store_true")
    a.add_argument("--prompt-relevant", choices=prompt_texts.RELEVANCE_NAMES, default="relevance_filter_v1")
    a.add_argument("--rag-strategy", choices=tuple(presets.PARAMETERS), default="simple")
    a.add_argument("--complete-policy", action="store_true")
    a.add_argument("--verifier", action="store_true")
    a.add_argument("--verifier-iterations", type=int, default=1)
    for name in ("evaluate", "overlap"):
        p = parts.add_parser(name)
        p.add_argument("--predictions", required=True)
        p.add_argument("--truth", required=True)
        p.add_argument("--output-dir", required=True)
        p.add_argument("--model-name", default="model")
    c = parts.add_parser("convert")
    c.add_argument("--documents", required=True)
    c.add_argument("--output-dir", required=True)
    c.add_argument("--parser", required=True, help="module:function from a file's bytes to pages")
    c.add_argument("--no-page-marks", action="store_true")
    return top


def run_folder(now: float | None = None) -> str:
    """One name for a run: its time, as partitions are named."""
    return time.strftime("%d-%m-%y--%H-%M-%S", time.localtime(now))


def settings(args: argparse.Namespace) -> answer.Settings:
    model = client.client(args.model, args.model_name) if args.model else answer.rule_model
    return answer.Settings(
        strategy=args.rag_strategy,
        k=args.k,
        masked=not args.batch,
        persona=args.persona,
        irrelevant=("hello", "thanks") if args.filter_irrelevant else (),
        model=model,
        prompt=prompt_texts.prompt_or_standard(args.prompt) if args.model else answer.PROMPT,
        complete=args.complete_policy,
    )


def chosen_questions(asked: DataFrame, ids: str | None, most: int | None) -> DataFrame:
    rows = asked.where(F.col("Id").isin([i.strip() for i in ids.split(",")])) if ids else asked
    return rows.orderBy(*evaluate.numeric_order(F.col("Id"))).limit(most) if most is not None else rows


def answers(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Nested results of a run, a row for each policy."""
    texts = tables.text_documents(spark, args.documents)
    texts = texts.where(F.col("policy_id") == args.policy_id) if args.policy_id else texts
    docs = texts.select(F.xxhash64("path").alias("doc_id"), "policy_id", "text")
    asked = chosen_questions(tables.questions_csv(spark, args.questions_file), args.questions, args.num_questions)
    policies = docs.select("policy_id").distinct()
    n = policies.count()
    lists = policies.groupBy(F.pmod(F.xxhash64("policy_id"), F.lit(max(1, -(-n // 1000)))).alias("list")).agg(F.collect_list("policy_id").alias("p"))
    numbered = asked.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-n // 1000)) - 1).cast("long"))))
    pairs = numbered.join(lists.withColumn("list", F.col("list").cast("long")), "list").select("Id", F.col("Questions").alias("question"), F.explode("p").alias("policy_id"))
    pairs = pairs.withColumn("query_id", F.xxhash64("Id", "policy_id"))
    how = settings(args)
    got = answer.answer(pairs.select("query_id", "question", "policy_id"), docs, replace(how, masked=True))
    if args.verifier:
        rows = got.withColumnRenamed("outcome", "eligibility")
        got = verify(rows, "context", args.verifier_iterations, how.model if args.model else None, args.model_name).withColumnRenamed("eligibility", "outcome")
    rows = got.join(pairs.select("query_id", "Id", "policy_id"), "query_id")
    rows = rows.withColumn("ord", F.xxhash64("Id")).select("policy_id", "ord", F.col("Id").alias("request_id"), "question", "outcome", "outcome_justification", "payment_justification")
    return evaluate.nested(rows)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=getattr(args, "log_level", "INFO"))
    spark = SparkSession.builder.appName(f"quillstone-{args.task}").getOrCreate()
    if args.task == "answer":
        k = "complete-policy" if args.complete_policy else str(args.k)
        rows = answers(spark, args).withColumns({"model": F.lit(args.model_name), "k": F.lit(k), "run_ts": F.lit(run_folder()), "prompt": F.lit(args.prompt)})
        sinks.write_policy_results(rows, args.output_dir)
    elif args.task == "convert":
        module, function = args.parser.split(":")
        files = pages.not_converted(tables.policy_files(spark, args.documents), _converted(spark, args.output_dir))
        found = pages.parsed(files, getattr(importlib.import_module(module), function))
        texts = pages.documents(pages.page_texts(found, not args.no_page_marks))
        texts.withColumnRenamed("doc", "path").write.mode("append").parquet(args.output_dir)
        print(pages.conversion_counts(found).first().asDict())
    else:
        truth = tables.ground_truth(spark, args.truth)
        detail = evaluate.scored(evaluate.match(tables.predictions(spark, args.predictions), truth, ["policy_id", "request_id"]))
        if args.task == "overlap":
            reports.write_iou_report(detail, args.output_dir)
        else:
            summary, report = evaluate.summary(detail), evaluate.report(detail, "gt_outcome", "outcome", list(evaluate.OUTCOMES))
            sinks.write_evaluation(detail, summary, report, args.output_dir, args.model_name.replace("/", "_"))
            print(reports.summary_text(summary))
            print(reports.summary_table(summary, args.model_name))
            print(reports.report_table(report, args.model_name))
    return 0


def _converted(spark: SparkSession, folder: str) -> DataFrame:
    """Files converted by earlier runs; none if there was no earlier run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema("path string, text string").parquet(folder).select("path") if there else spark.createDataFrame([], "path string")


if __name__ == "__main__":
    raise SystemExit(main())
