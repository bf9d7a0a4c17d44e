"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_evidence, q_forest, q_lifecycle, q_metrics, q_more, q_structure

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (q_metrics, q_evidence, q_structure, q_lifecycle, q_forest, q_more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked roll-up of scored evidence by file."""
    return q_metrics.file_rollup(spark, sf_dir).orderBy("score", ascending=False)


def queries() -> dict[str, Query]:
    return {name: query for group in GROUPS for name, (query, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
