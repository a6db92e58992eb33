"""Persons of a question by a model: its prompt, and its reply made whole where fields are missing or cannot be."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import jsonx as J
from quillstone.operators import persona as P
from quillstone.plans.verify import ask

TEXT = ("policy_user", "affected_person", "location", "relationship_to_policyholder", "mentioned_people", "relationship")
FLAGS = ("is_abroad", "is_affected_covered")
COUNTS = ("total_count", "claimant_count")
# Places by words of the affected person and the relationship, and words of foreign places.
PLACES = (("airport", "airport"), ("hotel|resort", "hotel/resort"), ("hospital|clinic", "hospital/medical facility"), ("home|house", "home"), ("abroad|foreign|overseas|international", "abroad (unspecified location)"))
NOWHERE = "unspecified location"
FOREIGN = "abroad|foreign|overseas|international|europe|asia|america|africa|australia"
KINSHIP = (("spouse|wife|husband|partner", "spouse/partner"), ("child|son|daughter", "child/dependent"), ("parent|father|mother", "parent"))
NO_KINSHIP = "unknown (inferred)"
COVERED = "self|spouse|partner|child|dependent"


def prompt(question: Column) -> Column:
    """Asks for the ten fields as one JSON object."""
    shape = ", ".join([*(f'"{f}": "..."' for f in TEXT), *(f'"{f}": true or false' for f in FLAGS), *(f'"{f}": a number' for f in COUNTS)])
    lead = "Who makes the claim in this question, whom did the event hit and where, how do they stand to each other, is that person insured, who else is named, how many people are there and how many of them claim?"
    return F.concat(F.lit(lead + '\nQuestion: "'), question, F.lit('"\nReply with one JSON object and nothing else: {"personas": {' + shape + "}}"))


def _ladder(rules, value: Column, other: str) -> Column:
    out = None
    for pattern, name in rules:
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return out.otherwise(other)


def whole(p: Column) -> dict[str, Column]:
    """The ten fields of a reply's personas (a struct of TEXT, FLAGS and COUNTS, null where missing): counts of 1 to 5, no more claimants than people, and what is missing inferred from the rest."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    total = F.when(p["total_count"].isNull() | p["total_count"].between(1, 5), p["total_count"]).otherwise(1)
    claimants = F.coalesce(F.when(p["claimant_count"] > total, total).otherwise(p["claimant_count"]), F.lit(1))
    user = F.coalesce(p["policy_user"], F.lit("policyholder (individual)"))
    person = F.coalesce(p["affected_person"], F.concat(user, F.lit(" (inferred)")))
    place = F.coalesce(p["location"], _ladder(PLACES, F.concat_ws(" ", low(person), low(p["relationship"])), NOWHERE))
    itself = (low(person) == low(user)) | F.contains(low(person), F.lit("self"))
    kin = F.coalesce(p["relationship_to_policyholder"], F.when(itself, "self").otherwise(_ladder(KINSHIP, low(person), NO_KINSHIP)))
    return {
        "policy_user": user,
        "affected_person": person,
        "location": place,
        "is_abroad": F.coalesce(p["is_abroad"], low(place).rlike(FOREIGN)),
        "relationship_to_policyholder": kin,
        "is_affected_covered": F.coalesce(p["is_affected_covered"], low(kin).rlike(COVERED)),
        "mentioned_people": p["mentioned_people"],
        "total_count": total,
        "claimant_count": claimants,
        "relationship": p["relationship"],
    }


def read(said: Column) -> Column:
    """The personas of a reply as a struct; a field of another type counts as missing."""
    v = J.parse(said)
    of = lambda f, t: F.try_variant_get(v, f"$.personas.{f}", t).alias(f)
    return F.struct(*(of(f, "string") for f in TEXT), *(of(f, "boolean") for f in FLAGS), *(of(f, "int") for f in COUNTS))


def personas(questions: DataFrame, model: Callable[[list[str]], list[str]], column: str = "question") -> DataFrame:
    """questions with the ten persona fields: by the model where its reply holds personas, else by rules."""
    said = ask(questions.withColumn("__prompt", prompt(F.coalesce(F.col(column), F.lit("")))), model, "__prompt", "__said")
    rules = P.personas(said, column)
    there = F.try_variant_get(J.parse(F.col("__said")), "$.personas", "variant").isNotNull()
    found = rules.withColumn("__p", read(F.col("__said"))).withColumn("__there", F.coalesce(there, F.lit(False)))
    return found.withColumns({k: F.when(F.col("__there"), c).otherwise(F.col(k)) for k, c in whole(F.col("__p")).items()}).drop("__prompt", "__said", "__p", "__there")
