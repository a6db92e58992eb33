"""Language by function words: distinct words of a text that speak for each language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import lexicon as X
from quillstone.functions import text as T


def scores(c: Column, languages: tuple[str, ...] = tuple(X.LANGUAGE_WORDS)) -> dict[str, Column]:
    """Number of the language's words that occur among the text's distinct words."""
    found = F.transform(F.array(T.word_set(F.coalesce(c, F.lit("")))), lambda w: F.struct(*(F.size(F.array_intersect(w, F.array(*map(F.lit, X.LANGUAGE_WORDS[k])))).alias(k) for k in languages)))[0]
    return {k: found[k] for k in languages}


def decide(counts: dict[str, Column], margin: float = 1.2) -> Column:
    """The language whose count is the greatest by the margin over every other, else `unknown`."""
    out = F.lit("unknown")
    for k, c in counts.items():
        best = F.greatest(*(v for o, v in counts.items() if o != k))
        out = F.when((c > 0) & (c >= margin * best), k).otherwise(out)
    return out
