"""Verification of answers against the passages they were given, in rounds, as projections; a model may take part."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import jsonx as J
from quillstone.functions import prompt_texts as X
from quillstone.session import ship

FIELDS = ("eligibility", "outcome_justification", "payment_justification")


def corrected(eligibility: Column, outcome: Column, payment: Column, context: Column) -> dict[str, Column]:
    """The answer with what its passages do not hold word for word taken out, and whether that changed it.

    A justification that is no part of the passages becomes empty, a payment null; an approval without a justification
    becomes unrelated. Null counts as empty, an empty quotation is part of any text.
    """
    quote = F.coalesce(outcome, F.lit(""))
    kept = F.when(F.contains(F.coalesce(context, F.lit("")), quote), quote).otherwise("")
    paid = F.when((payment != "") & F.contains(F.coalesce(context, F.lit("")), payment), payment)
    verdict = F.when((eligibility == X.ELIGIBILITY[0]) & (kept == ""), X.ELIGIBILITY[1]).otherwise(eligibility)
    changes = F.concat_ws(
        ", ",
        F.when(~verdict.eqNullSafe(eligibility), "eligibility"),
        F.when(kept != quote, "outcome_justification"),
        F.when(~F.coalesce(paid, F.lit("")).eqNullSafe(F.coalesce(payment, F.lit(""))), "payment_justification"),
    )
    return {"eligibility": verdict, "outcome_justification": kept, "payment_justification": paid, "changes": changes}


def verify(rows: DataFrame, context: str = "context", iterations: int = 1, model: Callable[[list[str]], list[str]] | None = None, model_name: str = "", question: str = "question") -> DataFrame:
    """rows (with the three answer fields, their passages and question) with the verified fields, status (confirmed or corrected) and changes_made.

    Each round first asks the model, if one is given, for a corrected answer (a reply that cannot be read changes
    nothing), then takes out what the passages do not hold. Rounds after the first change something only through a
    model. A model's error leaves the row's answer as it was: see ask().
    """
    before = {f: F.col(f) for f in FIELDS}
    out = rows.withColumns({f"__{f}": c for f, c in before.items()}).withColumn("__changes", F.array().cast("array<string>"))
    for _ in range(max(1, iterations)):
        if model is not None:
            out = _asked(out, context, question, model, model_name)
        new = corrected(*(F.col(f) for f in FIELDS), F.col(context))
        out = out.withColumn("__new", F.struct(*(c.alias(k) for k, c in new.items())))
        out = out.withColumns({**{f: F.col("__new")[f] for f in FIELDS}, "__changes": F.array_append("__changes", F.col("__new.changes"))}).drop("__new")
    same = lambda f: F.coalesce(F.col(f), F.lit("")) == F.coalesce(F.col(f"__{f}"), F.lit(""))
    changed = F.concat_ws(", ", *(F.when(~same(f), f) for f in FIELDS))
    done = out.withColumns({"status": F.when(changed == "", "confirmed").otherwise("corrected"), "changes_made": F.when(changed == "", "none").otherwise(changed)})
    return done.drop("__changes", *(f"__{f}" for f in FIELDS))


def _asked(rows: DataFrame, context: str, question: str, model: Callable[[list[str]], list[str]], model_name: str) -> DataFrame:
    previous = F.to_json(F.struct(F.struct(*(F.col(f) for f in FIELDS)).alias("answer")))
    text = F.lit(X.verification_prompt(model_name))
    for mark, value in (("{{USER_QUESTION}}", F.col(question)), ("{{POLICY_CONTEXT}}", F.col(context)), ("{{PREVIOUS_RESULT}}", previous)):
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("")))
    said = ask(rows.withColumn("__prompt", text), model, "__prompt", "__said")
    read = J.answer(F.col("__said"))
    found = said.withColumn("__read", F.struct(*(c.alias(k) for k, c in read.items())))
    good = F.col("__read.eligibility").isin(*X.ELIGIBILITY)
    return found.withColumns({f: F.when(good, F.col("__read")[f]).otherwise(F.col(f)) for f in FIELDS}).drop("__prompt", "__said", "__read")


def ask(rows: DataFrame, model: Callable[[list[str]], list[str]], prompt: str, out: str) -> DataFrame:
    """rows with what a model says to a column of prompts, batch by batch; where it fails, null."""
    ship(rows.sparkSession)
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                said = model(b.column(prompt).to_pylist())
            except Exception:  # whatever a model client raises: the answers stay as they were
                said = [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], [*names, out])

    return rows.mapInArrow(task, schema)
