"""A vector store: Parquet rows and a one-row manifest that must match on opening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "schema_version int, dimension int, metric string, model string"
VERSION = 2


def create(rows: DataFrame, path: str, dimension: int, metric: str, model: str) -> None:
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(VERSION, dimension, metric, model)], MANIFEST).write.mode("errorifexists").parquet(f"{path}/manifest")


def open_store(spark: SparkSession, path: str, dimension: int, metric: str, model: str) -> DataFrame:
    """The rows, if the manifest is exactly the one expected."""
    found = [tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").limit(2).collect()]
    if found != [(VERSION, dimension, metric, model)]:
        raise ValueError(f"the store's manifest {found} isn't {(VERSION, dimension, metric, model)}")
    return spark.read.parquet(f"{path}/rows")
