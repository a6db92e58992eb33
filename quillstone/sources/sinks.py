"""Writers: all through Spark, so they work on any file system and survive a lost executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_model(name: Column) -> Column:
    """Model name as a folder: slashes and colons become underscores where there is a slash."""
    return F.when(F.contains(name, F.lit("/")), F.translate(name, "/:", "__")).otherwise(name)


def short_model_name(name: Column) -> Column:
    """Last part of a model path, lower case, with dots, blanks and underscores as hyphens and without tuning suffixes."""
    last = F.lower(F.element_at(F.split(name, "/"), -1))
    return F.regexp_replace(F.translate(last, "._ ", "---"), r"-(instruct|chat|hf)$", "")


def write_policy_results(results: DataFrame, folder: str) -> None:
    """Nested result documents partitioned by model, retrieval depth, run and prompt."""
    results.withColumn("model", clean_model(F.col("model"))).write.mode("append").partitionBy("model", "k", "run_ts", "prompt").json(folder)


def write_evaluation(detail: DataFrame, summary: DataFrame, metrics: DataFrame, folder: str, suffix: str) -> None:
    detail.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/evaluation_{suffix}")
    summary.write.mode("overwrite").json(f"{folder}/summary_{suffix}")
    metrics.write.mode("overwrite").json(f"{folder}/metrics_{suffix}")


def write_projections(chunks: DataFrame, folder: str) -> None:
    """The five views of one preprocessing result."""
    chunks.select("chunk_id", "chunk_type", "title", "page_number", "section_path").write.mode("overwrite").json(f"{folder}/structure")
    chunks.select("chunk_id", "text").write.mode("overwrite").json(f"{folder}/text")
    chunks.select("chunk_id", "quality_score", "language", "semantic_type").write.mode("overwrite").json(f"{folder}/quality")
    chunks.select("chunk_id", "metadata").write.mode("overwrite").json(f"{folder}/metadata")
    chunks.write.mode("overwrite").json(f"{folder}/full")


def review_status(outcome: Column) -> Column:
    return F.when(outcome == "Yes", "APPROVED").when(outcome == "Maybe", "UNDECIDED").otherwise("REJECTED")


def to_review_rows(results: DataFrame) -> DataFrame:
    rows = results.select("policy_id", F.posexplode("questions").alias("ord", "q"))
    return rows.select("policy_id", "ord", "q.request_id", "q.question", review_status(F.col("q.outcome")).alias("status"), "q.outcome_justification", "q.payment_justification")


def escape_latex(text: str) -> str:
    """Special characters for LaTeX, braces first so that later replacements keep theirs."""
    for mark in "{}&%$#_":
        text = text.replace(mark, "\\" + mark)
    return text.replace("~", r"\textasciitilde{}").replace("^", r"\textasciicircum{}")


def latex_table(rows: list, columns: list[str], caption: str) -> str:
    """A small aggregate (already collected) as a LaTeX table."""
    head = " & ".join(escape_latex(c) for c in columns) + r" \\"
    body = [" & ".join(escape_latex("" if r[c] is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c])) for c in columns) + r" \\" for r in rows]
    return "\n".join([r"\begin{table}[h]", rf"\caption{{{escape_latex(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"])
