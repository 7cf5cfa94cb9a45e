"""Registry of core queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kiln.operators import units
from kiln.plans import blocks, chunking, cleaning, evaluation, graph, normalization, relational, stages, vectors  # noqa: F401  (each module registers its queries)
from kiln.plans.base import QUERIES, SQL, Query
from kiln.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.found(table(spark, d, "chunks"))


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    return units.normalize(table(spark, d, "chunks"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_values": p1_values} | QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
