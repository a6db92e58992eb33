"""Evaluation of predictions against ground truth: joins, accuracy, confusion matrix, reports and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

#: The outcomes that matrices and reports count, and the codes of raw responses.
OUTCOMES = ("Yes", "No - Unrelated event", "No - condition(s) not met")
OUTCOME_CODES = {"APPROVED": "Yes", "REJECTED": "No - Unrelated event", "CONDITIONS_NOT_MET": "No - condition(s) not met", "UNDECIDED": "Maybe"}


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last by order."""
    others = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__r"))
    return got.select(*keys, "__r.*")


def match(predictions: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with their truth (columns prefixed gt_); of repeated truths the last by ord counts."""
    one = last_of(truth, keys, ["ord"])
    named = one.select(*keys, *(F.col(c).alias(f"gt_{c}") for c in one.columns if c not in keys))
    return predictions.join(named, keys, "inner")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def outcome_code(code: Column, codes: dict[str, str] | None = None) -> Column:
    """Codes that are not in the map stay as they are."""
    pairs = [F.lit(x) for item in (codes or OUTCOME_CODES).items() for x in item]
    return F.coalesce(F.create_map(*pairs)[code], code)


def scored(matched: DataFrame) -> DataFrame:
    """Detail rows: outcome_match is 0 where outcomes are equal and 1 where not (as the detail files have it); is_match says it plainly."""
    norm = lambda c: F.coalesce(T.normalise(F.col(c)), F.lit(""))
    j, gj = T.normalise(F.col("outcome_justification")), T.normalise(F.col("gt_outcome_justification"))
    p, gp = T.normalise(F.col("payment_justification")), T.normalise(F.col("gt_payment_justification"))
    rows = matched.withColumns(
        {
            "is_match": norm("outcome") == norm("gt_outcome"),
            "justification_similarity": T.edit_similarity(j, gj),
            "justification_iou": T.word_iou(j, gj),
            "payment_similarity": T.edit_similarity(p, gp),
        }
    )
    mean = (F.col("justification_similarity") + F.col("payment_similarity")) / 2
    return rows.withColumn("outcome_match", F.when(F.col("is_match"), 0).otherwise(1)).withColumn("avg_justification_similarity", mean)


def accuracy(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Share of equal outcomes over all rows; null for none."""
    same = F.coalesce(F.col(actual), F.lit("")) == F.coalesce(F.col(predicted), F.lit(""))
    return rows.agg(F.count("*").alias("n"), F.count_if(same).alias("n_equal"), F.avg(same.cast("double")).alias("accuracy"))


def confusion(rows: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """actual, predicted, n for every pair of labels; rows outside the labels are dropped, absent pairs are 0. One pass, no join."""
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.count_if((F.col(actual) == F.lit(a)) & (F.col(predicted) == F.lit(p))).alias("n")) for a in labels for p in labels]
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def confusion_totals(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts with row, column and grand totals (null stands for all)."""
    return rows.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).cube("actual", "predicted").agg(F.count("*").alias("n"))


def report(rows: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """label, precision, recall, f1, support, with macro and weighted averages; a ratio without cases is 0. Counts come from one pass."""
    a, p = F.col(actual), F.col(predicted)
    per = [
        F.struct(
            F.lit(str(x)).alias("label"),
            F.count_if((a == F.lit(x)) & (p == F.lit(x))).alias("tp"),
            F.count_if(p == F.lit(x)).alias("called"),
            F.count_if(a == F.lit(x)).alias("support"),
        )
        for x in labels
    ]
    ratio = lambda x, y: F.when(y == 0, F.lit(0.0)).otherwise(x / y)
    base = rows.agg(F.array(*per).alias("c")).select(F.inline("c"))
    each = base.select("label", ratio(F.col("tp"), F.col("called")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), "support")
    both = F.col("precision") + F.col("recall")
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both)).select("label", "precision", "recall", "f1", "support")
    macro = each.agg(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    weighted = each.agg(F.lit("weighted avg").alias("label"), *(ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted)


def summary(detail: DataFrame) -> DataFrame:
    """One row of means, match count and percentage, and the runs' k and prompt (`multiple` if several, `unknown` if none)."""

    def one(c: str) -> Column:
        found = F.collect_set(c)
        return F.when(F.size(found) == 1, found[0].cast("string")).when(F.size(found) > 1, "multiple").otherwise("unknown").alias(c)

    names = ("justification_similarity", "justification_iou", "payment_similarity", "avg_justification_similarity")
    return detail.agg(F.count("*").alias("total"), F.count_if("is_match").alias("matches"), (F.avg(F.col("is_match").cast("double")) * 100).alias("match_percent"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names), *(one(c) for c in ("k", "prompt") if c in detail.columns))


def compare(summaries: DataFrame, metrics: list[str], models: list[str]) -> DataFrame:
    """metric by model."""
    long = summaries.select("model", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))
    return long.groupBy("metric").pivot("model", models).agg(F.first("value"))


def ground_truth_rows(raw: DataFrame) -> DataFrame:
    """Raw requests with their latest response (greatest updated_at as text, the first of equals); requests without responses are dropped, blank payments are null."""
    rows = raw.select("policy_id", F.posexplode("policy_requests").alias("ord", "r")).where(F.size("r.responses") > 0)
    latest = F.array_max(F.transform("r.responses", lambda x, i: F.struct(F.coalesce(x["updated_at"], F.lit("")).alias("t"), (-i).alias("o"), x.alias("x"))))["x"]
    rows = rows.select("policy_id", "ord", F.col("r.request.request_id").alias("request_id"), F.col("r.request.content").alias("question"), latest.alias("x"))
    return rows.select(
        "policy_id",
        "ord",
        "request_id",
        "question",
        outcome_code(F.col("x.response_outcome")).alias("outcome"),
        F.col("x.response_outcome_justification").alias("outcome_justification"),
        F.nullif(F.col("x.payout_justification"), F.lit("")).alias("payment_justification"),
    )


def numeric_order(c: Column) -> list[Column]:
    """Sort keys: whole numbers by value first, then other texts."""
    return [F.try_to_number(F.when(c.rlike(r"^\d{1,18}$"), c), F.lit("9" * 18)).asc_nulls_last(), c.asc()]


def nested(rows: DataFrame) -> DataFrame:
    """Result documents: questions of a policy in order."""
    fields = ["request_id", "question", "outcome", "outcome_justification", "payment_justification"]
    got = rows.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("q"))
    return got.select("policy_id", F.transform("q", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("questions"))
