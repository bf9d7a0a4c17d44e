"""Streaming ingest of snapshots: idempotent, with orphans waiting for their parents.

Each micro-batch is merged into the store of snapshots (a versioned table in a shared folder); a snapshot
is processed once its parent is, and waits otherwise.  This is the batch operator of
:mod:`codeledger.operators.lifecycle` applied per batch; a batch that is delivered again after a
failure writes nothing new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..sinks.versioned import VersionedTable

SNAPSHOT = "id string, parent_id string, digest string"


def ingest_batch(batch: DataFrame, store: str) -> int:
    """Merge one batch; conflicts (an id with other content) raise before anything is written."""
    table = VersionedTable(batch.sparkSession, store, SNAPSHOT)
    outcome = lifecycle.ingest(table.read(), batch)
    bad = outcome.filter("outcome = 'conflict'").limit(1).collect()
    if bad:
        raise ValueError(f"snapshot {bad[0].id} was stored with other content")
    return table.append_once(batch.select("id", "parent_id", "digest"), "id")


def states(spark: SparkSession, store: str) -> DataFrame:
    """(id, state): processed, or pending while an ancestor is missing."""
    return lifecycle.pending(VersionedTable(spark, store, SNAPSHOT).read())


def start(snapshots: DataFrame, store: str, checkpoint: str, available_now: bool = True):
    """Start the streaming query over a stream of SNAPSHOT rows."""
    writer = snapshots.writeStream.foreachBatch(lambda df, _: ingest_batch(df, store) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """An extension beyond batch evidence: counts per tumbling window with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("events"))
