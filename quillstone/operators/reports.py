"""Reports on evaluations and chunk quality: aggregates as DataFrames, and small tables of them as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources.sinks import latex_table

# Bounds of the steps of each measure, lower ones first.
STEPS = {"quality": (0.6, 0.8), "high_quality_share": (0.3, 0.6), "readability": (0.5, 0.7), "context_share": (0.5,), "general_share": (0.5, 0.7)}
#: What a report says to each step of a measure.
ADVICE = {
    "quality": ("chunks are poor on average: look at their sizes and at the source", "chunks are fair on average", "chunks are good on average"),
    "high_quality_share": ("few chunks are good: raise the least size or widen the types", "some chunks are good", "most chunks are good"),
    "readability": ("chunks are hard to read: simplify, or end sentences better", "chunks read as technical texts do", "chunks read well"),
    "context_share": ("few chunks carry context: let them overlap", "chunks carry context"),
    "general_share": ("types of chunks are told apart well", "many chunks have no type of their own", "most chunks have no type of their own: add patterns"),
}
NOTHING = "no chunks: look at the document and the settings"


def chunk_quality(chunks: DataFrame, good: float = 0.8) -> DataFrame:
    """One row of measures over chunks (quality, readability, has_context, kind); shares are null without chunks."""
    share = lambda c: F.avg(c.cast("double"))
    return chunks.agg(
        F.count("*").alias("n"),
        F.avg("quality").alias("quality"),
        share(F.col("quality") >= good).alias("high_quality_share"),
        F.avg("readability").alias("readability"),
        share(F.col("has_context")).alias("context_share"),
        share(F.col("kind") == "general").alias("general_share"),
    )


def recommendations(measures: DataFrame) -> DataFrame:
    """measure, step (0 lowest), advice for each measure; one row without a measure if there are no chunks. The upper bound of general_share belongs to the step below."""

    def row(name: str):
        value, step = F.coalesce(F.col(name), F.lit(0.0)), F.lit(0)
        for bound in STEPS[name]:
            step = step + ((value > bound) if name == "general_share" else (value >= bound)).cast("int")
        return F.struct(F.lit(name).alias("measure"), step.alias("step"), F.get(F.array(*map(F.lit, ADVICE[name])), step).alias("advice"))

    none = F.array(F.struct(F.lit(None).cast("string").alias("measure"), F.lit(None).cast("int").alias("step"), F.lit(NOTHING).alias("advice")))
    return measures.select(F.inline(F.when(F.col("n") == 0, none).otherwise(F.array(*map(row, STEPS)))))


def best_chunks(chunks: DataFrame, n: int = 5) -> DataFrame:
    """The n chunks of highest quality; of equal ones the smaller id."""
    return chunks.orderBy(F.desc("quality"), "chunk_id").limit(n)


def iou_report(detail: DataFrame, by: list[str]) -> DataFrame:
    """Mean overlap and the number of pairs by group (all together for none): the head of an overlap report, whose details are the rows."""
    return detail.groupBy(*by).agg(F.count("*").alias("n"), F.avg("justification_iou").alias("average_iou"), F.count_if(F.col("justification_iou") == 1).alias("n_same"))


def write_iou_report(detail: DataFrame, folder: str) -> None:
    """Average and details, as JSON in two folders."""
    iou_report(detail, []).write.mode("overwrite").json(f"{folder}/average")
    detail.write.mode("overwrite").json(f"{folder}/details")


def summary_text(summary: DataFrame) -> str:
    """The one row of an evaluation's summary as lines of name and value."""
    row = summary.first()
    return "\n".join(f"{c}: {row[c]:.4f}" if isinstance(row[c], float) else f"{c}: {row[c]}" for c in summary.columns)


def summary_table(summary: DataFrame, model: str) -> str:
    return latex_table(summary.limit(1).collect(), summary.columns, f"Evaluation of {model}")


def report_table(report: DataFrame, model: str) -> str:
    """A classification report (a row for each label and average) as a table."""
    return latex_table(report.collect(), report.columns, f"Outcomes by {model}")


def comparison_table(compared: DataFrame) -> str:
    """Metrics by model as a table."""
    return latex_table(compared.orderBy("metric").collect(), compared.columns, "Models compared")
