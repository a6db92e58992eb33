"""Names of models: families, folder of their settings, context windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import structure_rules as R


def is_qwen(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("qwen"))


def is_phi(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("phi"))


def is_hosted(name: Column) -> Column:
    return F.startswith(name, F.lit("openrouter/"))


def hosted_name(name: Column, known: dict[str, str]) -> Column:
    """The service's name of a model; a name that is not known stays."""
    return F.coalesce(F.create_map(*(F.lit(x) for item in known.items() for x in item))[name], name) if known else name


def token_limit(name: Column) -> Column:
    """Tokens of the first key that the name holds, in the fixed order; null if none does."""
    low, out = F.lower(name), None
    for key, limit in R.MODEL_LIMITS:
        out = F.when(F.contains(low, F.lit(key)), limit) if out is None else out.when(F.contains(low, F.lit(key)), limit)
    return out.cast("int")


def too_long(text: Column, name: Column, share: float = 0.8) -> Column:
    """Is a text, at four characters a token, beyond that share of the model's window? False for models without a known one."""
    return F.coalesce(F.length(text) / 4 > token_limit(name) * share, F.lit(False))
