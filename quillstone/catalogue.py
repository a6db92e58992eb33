"""Registered queries of the engine: name to function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import answer_queries, document_queries, evaluation_queries, question_queries, structure_queries, vector_queries

GROUPS = (vector_queries, evaluation_queries, document_queries, question_queries, structure_queries, answer_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for g in GROUPS for k, f in g.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for g in GROUPS for k, s in g.SQL.items()}
