"""Shared storage for iterative operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written to the folder that spark.checkpoint.dir names.
    Only a session on one machine that names none (tests) gets a local folder; on a cluster that is
    an error."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for checkpoints and for tables of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or f"file://{tempfile.gettempdir()}/checkpoints")
    return context.getCheckpointDir()


def numbered(df: DataFrame, keys: list[str], name: str = "number") -> DataFrame:
    """``df`` with its place (1 first) in the order of ``keys``: ranges are numbered by themselves and
    moved by the rows before them, so no task sees all rows.  Rows of equal keys get any order."""
    parts = cut(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each range
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return parts.withColumn("__inside", inside).join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__inside")).alias(name))
