"""Reports, benchmarks and artifacts from JSON, with explicit schemas and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_VERSION = 2
ITEM = "struct<id:string,display_name:string,level:string,location:struct<module:string,file:string,line:bigint,column:bigint>,category:string,score:double,priority:string,evidence_ids:array<string>,unavailable_evidence_ids:array<string>>"
AGGREGATION = "struct<id:string,level:string,location:struct<module:string,file:string,line:bigint,column:bigint>,member_item_ids:array<string>,score:double,priority:string>"
REPORT = f"schema_version int, items array<{ITEM}>, aggregations array<{AGGREGATION}>"
BENCHMARK = "analyzer string, workload_family string, input_sha256 string, command string, mode string, context string, wall_s double, peak_bytes long, pair_id string"
ARTIFACT_VERSION = 3
ARTIFACT = "schema_version int, snapshots array<struct<id:string,parent_id:string,revision:string,scope:string,engine:string>>, events array<struct<finding:string,event_id:string,snapshot_id:string,kind:string>>, detections array<struct<snapshot_id:string,id:string,rule:string,source:string,line:bigint,column:bigint,subject_digest:string,decl_digest:string>>"


def _versioned(df: DataFrame, version: int) -> DataFrame:
    ok = F.col("schema_version") == version
    return df.filter(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.format_string("schema version %s isn't supported", F.col("schema_version").cast("string")))))


def report_items(spark: SparkSession, path: str) -> DataFrame:
    raw = _versioned(spark.read.schema(REPORT).json(path, multiLine=True), REPORT_VERSION)
    return raw.select(F.explode("items").alias("i")).select("i.*")


def report_aggregations(spark: SparkSession, path: str) -> DataFrame:
    raw = _versioned(spark.read.schema(REPORT).json(path, multiLine=True), REPORT_VERSION)
    return raw.select(F.explode("aggregations").alias("a")).select("a.*")


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK).json(path, multiLine=True)


def artifact(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """snapshots, events and detections of an artifact."""
    raw = _versioned(spark.read.schema(ARTIFACT).json(path, multiLine=True), ARTIFACT_VERSION)
    return {k: raw.select(F.explode(k).alias("r")).select("r.*") for k in ("snapshots", "events", "detections")}
