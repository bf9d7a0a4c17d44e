"""Replay of an artifact's events, of the branches alone that a trusted digest doesn't cover.

A snapshot's digest holds its parent's digest, its detections and its events, each table summed up
by row digests (so the order of rows and the number of tasks don't count).  Two artifacts with equal
digests of a snapshot are equal on the whole path to it.  An audit skips the snapshots whose digest
was trusted before and replays the rest with the ordered reducer, from the findings that were
known at the last trusted ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lifecycle, reducer
from .shared import cut


def _summed(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(snapshot, name): how many rows a snapshot has, and two sums of their hashes, order aside."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    marks = rows.select("snapshot", F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring(F.sha2(text, 256), 16, 15), 16, 10).cast("decimal(38,0)").alias("b"))
    sums = marks.groupBy("snapshot").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select("snapshot", F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).alias(name))


def chain_digests(snapshots: DataFrame, detections: DataFrame, events: DataFrame) -> DataFrame:
    """(snapshot, digest) of all snapshots (id, parent_id) that hang on a root.

    ``detections``: snapshot, id and the reducer's PLACE; ``events``: finding, snapshot, kind, basis,
    detection.  A level of the forest is a round."""
    places = [c for c in reducer.PLACE if c in detections.columns]
    tree = cut(reducer.depths(snapshots.select(F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"))).filter("depth is not null"))
    own = tree.withColumnRenamed("id", "snapshot").join(_summed(detections, ["id", *places], "seen"), "snapshot", "left").join(_summed(events, ["finding", "kind", "basis", "detection"], "told"), "snapshot", "left")
    own = cut(own.select("snapshot", "parent_id", "depth", F.concat_ws("|", "snapshot", F.coalesce("seen", F.lit("")), F.coalesce("told", F.lit(""))).alias("text")))
    out = now = None
    for depth in range(int(own.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]) + 1):
        here = own.filter(F.col("depth") == depth)
        above = here.withColumn("above", F.lit("")) if now is None else here.join(now.select(F.col("snapshot").alias("parent_id"), F.col("digest").alias("above")), "parent_id")
        now = cut(above.select("snapshot", F.sha2(F.concat_ws("|", "above", "text"), 256).alias("digest")))
        out = now if out is None else out.unionByName(now)
    return out if out is not None else snapshots.sparkSession.createDataFrame([], "snapshot string, digest string")


def audit(snapshots: DataFrame, detections: DataFrame, events: DataFrame, renames: DataFrame | None = None, proofs: DataFrame | None = None, trusted: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((finding, snapshot_id, stored_kind, replayed_kind), (snapshot)): the events that a replay gives
    otherwise, and the snapshots that were replayed.

    ``trusted``: snapshot, digest of an earlier audit; ``known``: the reducer's findings at those
    snapshots.  Without them all is replayed.  After a wrong event the replay goes on from what the
    reducer says, not from what is stored."""
    stored = events.select("finding", F.col("snapshot").alias("snapshot_id"), "kind")
    if trusted is None or known is None:
        done = reducer.reduce_forest(snapshots, detections, renames, proofs)
    else:
        fine = chain_digests(snapshots, detections, events).join(trusted.select("snapshot", "digest"), ["snapshot", "digest"], "left_semi").select("snapshot")
        fine = cut(fine)
        done = reducer.reduce_forest(snapshots, detections, renames, proofs, known=known.join(fine, "snapshot", "left_semi"))
        stored = stored.join(fine.withColumnRenamed("snapshot", "snapshot_id"), "snapshot_id", "left_anti")
    replayed = done.events.select("finding", F.col("snapshot").alias("snapshot_id"), "kind")
    waiting = done.pending.withColumnRenamed("id", "snapshot_id")
    return lifecycle.replay_violations(stored.join(waiting, "snapshot_id", "left_anti"), replayed), done.order.select(F.col("id").alias("snapshot"))
