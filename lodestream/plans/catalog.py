"""All queries over the driver's tables but those of the training-data subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, context_queries, detail_queries, feed_queries, lookup_queries, rule_queries, scalar_queries, snapshot_queries, source_queries  # noqa: F401
from .registry import ORACLE, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that rules promote."""
    return QUERIES["r12_candidates"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
