"""Lifecycle artifacts of every schema, brought to the current one by a chain of migrations.

Schema 1 has lineages (a number for each snapshot and its predecessor) and the head of each; schema 2
has parent edges and the basis of each event; schema 3, the current one, has the contract under
which an event's evidence was written.  Each migration takes the tables of one schema to those of
the next and refuses what its schema can't hold, so an old artifact passes all of them in order.
Migrated events keep the contract of their old schema: they aren't replayed under today's rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import cut
from .reports import ARTIFACT_VERSION

Tables = dict[str, DataFrame]
LEGACY, CURRENT = "legacy-schema-two", "schema-three"
_SNAPSHOT = "id:string,revision:string,scope:string,engine:string"
_DETECTION = "array<struct<snapshot_id:string,id:string,rule:string,source:string,line:bigint,column:bigint,subject_digest:string,decl_digest:string>>"
_EVENT = "finding:string,event_id:string,snapshot_id:string,kind:string"
SCHEMAS = {
    1: f"schema_version int, snapshots array<struct<{_SNAPSHOT},lineage:string,sequence:bigint,predecessor:string>>, heads array<struct<lineage:string,snapshot_id:string,sequence:bigint>>, processed array<string>, events array<struct<{_EVENT},position:bigint>>, detections {_DETECTION}",
    2: f"schema_version int, snapshots array<struct<{_SNAPSHOT}>>, edges array<struct<child:string,parent:string>>, processed array<string>, events array<struct<{_EVENT},basis:string>>, detections {_DETECTION}",
    3: f"schema_version int, snapshots array<struct<{_SNAPSHOT},parent_id:string>>, processed array<string>, events array<struct<{_EVENT},basis:string,contract:string>>, detections {_DETECTION}",
}


class InvalidArtifact(ValueError):
    """An artifact that its own schema doesn't allow."""


def _refuse(rows: DataFrame, why: str) -> None:
    if not rows.isEmpty():
        raise InvalidArtifact(f"{why}: {rows.first()[0]}")


def _doubled(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def _one_to_two(t: Tables) -> Tables:
    """Edges from the predecessors, and each event's basis from the one before it of its finding."""
    snapshots, processed, heads = t["snapshots"], t["processed"], t["heads"]
    _refuse(_doubled(snapshots, "id"), "snapshots are listed twice")
    _refuse(_doubled(snapshots, "lineage", "sequence"), "a place of a lineage is taken twice")
    _refuse(_doubled(heads, "lineage"), "a lineage has two heads")
    _refuse(processed.join(snapshots.select("id"), "id", "left_anti"), "a processed snapshot is unknown")
    done = processed.withColumn("done", F.lit(True))
    later = snapshots.filter("sequence > 1").select("id", "lineage", "sequence", "predecessor").join(done, "id", "left")
    before = snapshots.join(done, "id", "left").select(F.col("id").alias("predecessor"), F.col("lineage").alias("their_lineage"), F.col("sequence").alias("their_sequence"), F.col("done").alias("their_done"))
    met = later.join(before, "predecessor", "left")
    known = F.col("their_lineage").isNotNull()
    _refuse(met.filter(known & ((F.col("lineage") != F.col("their_lineage")) | (F.col("their_sequence") + 1 != F.col("sequence")))).select("id"), "a predecessor isn't the one before")
    _refuse(met.filter(F.col("done") & F.col("their_done").isNull()).select("id"), "a snapshot was processed before its predecessor")
    last = snapshots.join(processed, "id").groupBy("lineage").agg(F.max(F.struct("sequence", "id")).alias("last"))
    odd = last.join(heads, "lineage", "full").filter(~F.col("last.id").eqNullSafe(F.col("snapshot_id")) | ~F.col("last.sequence").eqNullSafe(F.col("sequence")))
    _refuse(odd.select("lineage"), "a lineage's head isn't its last processed snapshot")
    in_order = Window.partitionBy("finding").orderBy("position")
    return {
        "snapshots": snapshots.select("id", "revision", "scope", "engine"), "edges": snapshots.filter("predecessor is not null").select(F.col("id").alias("child"), F.col("predecessor").alias("parent")), "processed": processed,
        "events": t["events"].withColumn("basis", F.lag("event_id").over(in_order)).drop("position"), "detections": t["detections"],
    }


def _two_to_three(t: Tables) -> Tables:
    """Parents as a column, and the old contract of every event."""
    _refuse(_doubled(t["snapshots"], "id"), "snapshots are listed twice")
    _refuse(_doubled(t["edges"], "child"), "a snapshot has two parents")
    _refuse(t["edges"].join(t["snapshots"].select(F.col("id").alias("child")), "child", "left_anti"), "an edge's child is unknown")
    _refuse(t["events"].filter("basis is not null").join(t["events"].select(F.col("event_id").alias("basis"), F.col("finding").alias("of")), ["basis"], "left").filter(~F.col("finding").eqNullSafe(F.col("of"))).select("event_id"), "an event's basis isn't an event of its finding")
    edges = t["edges"].select(F.col("child").alias("id"), F.col("parent").alias("parent_id"))
    return {"snapshots": t["snapshots"].join(edges, "id", "left"), "processed": t["processed"], "events": t["events"].withColumn("contract", F.lit(LEGACY)), "detections": t["detections"]}


#: Schema -> what takes it to the next.
MIGRATIONS: dict[int, Callable[[Tables], Tables]] = {1: _one_to_two, 2: _two_to_three}


def load(spark: SparkSession, path: str) -> Tables:
    """snapshots (with parent_id), processed, events (with basis and contract) and detections of the
    artifact at ``path``, whatever its schema."""
    text = spark.read.text(path, wholetext=True)
    versions = [r[0] for r in text.select(F.get_json_object("value", "$.schema_version").cast("int")).distinct().collect()]
    if len(versions) != 1 or versions[0] not in SCHEMAS:
        raise InvalidArtifact(f"schema versions {versions} aren't supported")
    version = versions[0]
    # A field of a later schema means that the version is wrong.
    own = {f.split(" ")[0] for f in _fields(SCHEMAS[version])}
    other = {f.split(" ")[0] for s in SCHEMAS.values() for f in _fields(s)} - own
    for name in sorted(other):
        _refuse(text.filter(F.get_json_object("value", f"$.{name}").isNotNull()).select(F.lit(name)), f"schema {version} can't have the field")
    for name in {1: ("basis", "contract"), 2: ("contract", "position"), 3: ()}[version]:
        _refuse(text.filter(F.get_json_object("value", f"$.events[*].{name}").isNotNull()).select(F.lit(name)), f"schema {version} can't have events with the field")
    raw = spark.read.schema(SCHEMAS[version]).json(path, multiLine=True)
    tables = {k: cut(raw.select(F.explode(k).alias("r")).select("r.*")) for k in own - {"schema_version", "processed"}}
    tables["processed"] = cut(raw.select(F.explode("processed").alias("id")))
    while version < ARTIFACT_VERSION:
        tables, version = MIGRATIONS[version](tables), version + 1
    return tables


def _fields(schema: str) -> list[str]:
    """The top-level fields of a schema text."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(schema[last:i].strip())
            last = i + 1
    return [*out, schema[last:].strip()]


def digest(*columns: str) -> Column:
    """Columns as one framed text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    return F.concat(*[F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)) for c in columns])
