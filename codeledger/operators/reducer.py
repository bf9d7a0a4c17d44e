"""The ordered reducer: snapshots of a forest are processed level by level, each against its own parent.

A snapshot may be processed once its parent is.  All snapshots of one depth are independent of
each other, so they are reconciled at once: the findings known at their parents are copied to them
(a branch copies them more than once), and every key of the reconciliation carries the snapshot.
A level is one table (snapshot, finding, ...) that holds what is known after each snapshot and the
event that it gave; it is written to the shared folder, and the next level reads it alone.  Jobs
grow with the depth of the forest, not with its snapshots.

Whether an unresolved group is ambiguous or unverified takes the components of its pairs.  It changes
no state, only an event's kind, so it is found out for all levels at once, behind the last one.

Snapshots whose chain of parents has a gap are pending and give nothing until it is closed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lifecycle
from .components import connected_components
from .shared import cut, shared_folder

#: What a finding is matched by: that of the detection it was last observed as.
PLACE = ["rule", "source", "line", "column", "subject_digest", "decl_digest", "semantics"]
LEVEL = "snapshot string, finding string, rule string, source string, line long, column long, subject_digest string, decl_digest string, semantics string, state string, last_event string, kind string, detection string, basis string"
#: The same while the kinds of unresolved groups are open: events are their snapshot and kind.
_EVENT = "struct<at:string,kind:string>"
_OPEN = LEVEL.replace("last_event string", f"last_event {_EVENT}").replace("basis string", f"basis {_EVENT}")
_RELATED = "at string, finding string, detection string, relation string"
_GROUPED = "grouped"


@dataclass
class Reduction:
    """``events``: finding, snapshot, kind, event_id, basis, detection; ``known``: each processed
    snapshot's findings with state and last event; ``unresolved``: snapshot, detection; ``order``: id,
    parent_id, depth of what is processed; ``pending``: id."""

    events: DataFrame
    known: DataFrame
    unresolved: DataFrame
    order: DataFrame
    pending: DataFrame


def depths(snapshots: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, parent_id, depth): how far each snapshot (id, parent_id) is from its root; null where an
    ancestor is missing.  Pointers jump twice as far in every round."""
    present = snapshots.select(F.col("id").alias("at"), F.lit(True).alias("there"))
    first = snapshots.join(present, snapshots["parent_id"] == present["at"], "left")
    now = cut(first.select(
        "id", "parent_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.when(F.col("parent_id").isNull(), "root").when(F.col("there").isNull(), "gap").alias("end"),
    ))
    for _ in range(most_rounds):
        if now.filter("end is null").isEmpty():
            return now.select("id", "parent_id", F.when(F.col("end") == "root", F.col("depth")).alias("depth"))
        up = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("end").alias("known"))
        moved = now.filter("end is null").join(up, "up").select("id", "parent_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("known").alias("end"))
        now = cut(now.filter("end is not null").select("id", "parent_id", "up", "depth", "end").unionByName(moved))
    raise RuntimeError("the snapshots have a cycle")


def _keyed(rows: DataFrame, at: str, key: str) -> DataFrame:
    """``rows`` as the reconciliation takes them, every key with its snapshot."""
    both = lambda c: F.struct(F.col(at).alias("at"), F.col(c).alias("of"))
    return rows.select(both(key).alias("id"), both("rule").alias("rule"), both("source").alias("source"), "line", "column", "subject_digest", "decl_digest", "semantics")


def _related(candidates: DataFrame, detections: DataFrame, renames: DataFrame | None) -> DataFrame:
    """(at, finding, detection, relation) of one level.  A candidate and a detection of different
    semantics are incomparable, whatever their digests: their relation is unverified."""
    first = lifecycle.relations(candidates, detections, renames)
    c, d = (x.select(F.col("id").alias(name), F.col("semantics").alias(f"{name}_is")) for x, name in ((candidates, "candidate"), (detections, "detection")))
    met = first.join(c, "candidate").join(d, "detection")
    first = cut(met.select("candidate", "detection", F.when(F.col("candidate_is").eqNullSafe(F.col("detection_is")), F.col("relation")).otherwise("unverified").alias("relation"), "reasons"))
    every = first.unionByName(lifecycle.divergence(candidates, detections, first))
    return every.select("candidate.at", F.col("candidate.of").alias("finding"), F.col("detection.of").alias("detection"), "relation")


def _matched(related: DataFrame) -> DataFrame:
    """(at, finding, detection): supported pairs that are the only relation of both their sides."""
    one = lambda side: related.groupBy("at", side).agg(F.count("*").alias("n")).filter("n = 1").select("at", side)
    return related.filter("relation = 'supported'").join(one("finding"), ["at", "finding"], "left_semi").join(one("detection"), ["at", "detection"], "left_semi").select("at", "finding", "detection")


def _unverified(rest: DataFrame) -> DataFrame:
    """(at, finding): those of groups without any ambiguous or supported pair.  Such a group is a
    component of unverified pairs alone, none of whose sides has another pair."""
    node = lambda side: F.struct("at", F.lit(side).alias("side"), F.col(side).alias("id"))
    edges = cut(rest.filter("relation = 'unverified'").select(node("finding").alias("u"), node("detection").alias("v")))
    roots = connected_components(edges)
    clear = rest.filter("relation <> 'unverified'")
    touched = clear.select(node("finding").alias("node")).unionByName(clear.select(node("detection").alias("node"))).distinct()
    other = roots.join(touched, "node", "left_semi").select("root").distinct()
    return roots.join(other, "root", "left_anti").filter("node.side = 'finding'").select("node.at", F.col("node.id").alias("finding"))


def _level(known: DataFrame, here: DataFrame, detections: DataFrame, renames: DataFrame | None, proofs: DataFrame | None, folder: str, depth: int) -> None:
    """Write the level's relations and its table.  ``known``: the level before; ``here``: at, parent."""
    spark = known.sparkSession
    before = cut(known.drop("kind", "detection", "basis").join(here, known["snapshot"] == here["parent"]).drop("snapshot", "parent"))
    shown = detections.withColumnRenamed("snapshot", "at").join(here.select("at"), "at", "left_semi")
    moved = None
    if renames is not None:
        own = renames.withColumnRenamed("snapshot", "at").join(here.select("at"), "at", "left_semi")
        moved = own.select(*[F.struct("at", F.col(c).alias("of")).alias(c) for c in ("prior", "current")])
    _related(_keyed(before, "at", "finding"), _keyed(shown, "at", "id"), moved).write.parquet(f"{folder}/related/depth={depth}")
    related = spark.read.schema(_RELATED).parquet(f"{folder}/related/depth={depth}")
    grouped = related.select("at", "finding").distinct().withColumn("grouped", F.lit(True))
    seen = shown.select("at", "rule").distinct().withColumn("seen", F.lit(True))
    full = before.join(_matched(related), ["at", "finding"], "left").join(grouped, ["at", "finding"], "left").join(seen, ["at", "rule"], "left")
    proven = F.lit(False)
    if proofs is not None:
        full = full.join(proofs.select(F.col("snapshot").alias("at"), "rule").distinct().withColumn("proven", F.lit(True)), ["at", "rule"], "left")
        proven = F.col("proven") & F.col("seen").isNull()
    is_open = F.col("state") == "open"
    kind = (
        F.when(F.col("detection").isNotNull(), F.when(is_open, "observed").otherwise("reopened"))
        .when(is_open & F.col("grouped"), _GROUPED).when(is_open & proven, "resolved").when(is_open, "unverified")
    )
    full = full.withColumn("kind", kind)
    event = F.when(F.col("kind").isNotNull(), F.struct("at", "kind"))
    state = F.when(F.col("kind").isin("observed", "reopened"), "open").when(F.col("kind") == "resolved", "resolved").otherwise(F.col("state"))
    now = shown.select("at", F.col("id").alias("detection"), *[F.col(c).alias(f"now_{c}") for c in PLACE])
    place = [F.when(F.col("detection").isNull(), F.col(c)).otherwise(F.col(f"now_{c}")).alias(c) for c in PLACE]
    kept = full.join(now, ["at", "detection"], "left").select(F.col("at").alias("snapshot"), "finding", *place, state.alias("state"), F.coalesce(event, "last_event").alias("last_event"), "kind", "detection", F.when(F.col("kind").isNotNull(), F.col("last_event")).alias("basis"))
    new = shown.join(related.select("at", F.col("detection").alias("id")).distinct(), ["at", "id"], "left_anti").withColumn("kind", F.lit("opened"))
    opened = new.select(F.col("at").alias("snapshot"), F.concat_ws(":", F.lit("finding"), "at", "id").alias("finding"), *PLACE, F.lit("open").alias("state"), F.struct("at", "kind").alias("last_event"), "kind", F.col("id").alias("detection"), F.lit(None).cast(_EVENT).alias("basis"))
    kept.unionByName(opened).write.parquet(f"{folder}/known/depth={depth}")


def _named(table: DataFrame, odd: DataFrame) -> DataFrame:
    """``table`` with the kinds of unresolved groups, and events by their ids."""
    odd = cut(odd.select(F.col("at").alias("odd_at"), F.col("finding").alias("odd_finding")))
    out = table
    for name, at, kind in (("kind", F.col("snapshot"), F.col("kind")), ("last_event", F.col("last_event.at"), F.col("last_event.kind")), ("basis", F.col("basis.at"), F.col("basis.kind"))):
        met = out.withColumn("k", kind).withColumn("a", at).join(odd, (F.col("a") == odd["odd_at"]) & (out["finding"] == odd["odd_finding"]), "left")
        k = F.when(F.col("k") != _GROUPED, F.col("k")).when(F.col("k").isNotNull(), F.when(F.col("odd_at").isNotNull(), "unverified").otherwise("continuity-ambiguous"))
        event = F.when(F.col("k").isNotNull() & F.col("a").isNull(), F.col("k")).when(F.col("k") == "opened", F.concat_ws(":", F.lit("event"), "finding", F.lit("opened"))).when(F.col("k").isNotNull(), F.concat_ws(":", F.lit("event"), "finding", "a", k))
        out = met.withColumn("now", k if name == "kind" else event).drop("k", "a", "odd_at", "odd_finding", name).withColumnRenamed("now", name)
    return out.select(*[c.split(" ")[0] for c in LEVEL.split(", ")])


def reduce_forest(snapshots: DataFrame, detections: DataFrame, renames: DataFrame | None = None, proofs: DataFrame | None = None, known: DataFrame | None = None) -> Reduction:
    """Process all snapshots (id, parent_id) that can be.

    ``detections``: snapshot, id and PLACE (semantics may be left out: all comparable); ``renames``:
    snapshot, prior, current; ``proofs``: snapshot, rule: rules whose absence a snapshot proves if it
    detects none of them (:func:`lifecycle.verified_absence` has the conditions).  A finding without a
    proof, or whose rule is still detected, is unverified.  ``known`` (the ``known`` of an earlier
    reduction) has the snapshots that are processed already: they aren't processed again.

    Ids must be unique within their snapshot; null digests are missing evidence."""
    if "semantics" not in detections.columns:
        detections = detections.withColumn("semantics", F.lit(None).cast("string"))
    text = [c for c in PLACE if c not in ("line", "column")]
    detections = cut(detections.select(*[F.col(c).cast("string").alias(c) for c in ("snapshot", "id", *text)], F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column")))
    tree = cut(depths(snapshots.select(F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"))))
    spark = snapshots.sparkSession
    done = None if known is None else known.select(F.col("snapshot").alias("id")).distinct()
    todo = tree.filter("depth is not null") if done is None else tree.filter("depth is not null").join(done, "id", "left_anti")
    todo = cut(todo)
    folder = f"{shared_folder(spark)}/reduction-{uuid.uuid4().hex}"
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}").select(*_names(schema)) if _there(spark, f"{folder}/{name}") else spark.createDataFrame([], schema)
    old = None
    if known is not None:  # their events have their ids already
        as_event = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit(None).cast("string").alias("at"), F.col(c).alias("kind")))
        old = known.withColumn("last_event", as_event("last_event")).withColumn("basis", F.lit(None).cast(_EVENT)).select(*_names(_OPEN))
    for depth in [r.depth for r in todo.select("depth").distinct().orderBy("depth").collect()]:  # a number for each level
        here = todo.filter(F.col("depth") == depth).select(F.col("id").alias("at"), F.col("parent_id").alias("parent"))
        last = read(f"known/depth={depth - 1}", _OPEN)
        _level(last if old is None else last.unionByName(old), here, detections, renames, proofs, folder, depth)
    raw, related = read("known", _OPEN), read("related", _RELATED)
    done_here = raw.filter("kind in ('observed', 'reopened')").select(F.col("snapshot").alias("at"), "finding")
    rest = cut(related.join(done_here, ["at", "finding"], "left_anti"))
    table = cut(_named(raw, _unverified(rest)))
    events = table.filter("kind is not null").select("finding", "snapshot", "kind", F.col("last_event").alias("event_id"), "basis", "detection")
    unresolved = rest.select(F.col("at").alias("snapshot"), "detection").distinct()
    return Reduction(events, table, unresolved, todo.select("id", "parent_id", "depth"), tree.filter("depth is null").select("id"))


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.replace(_EVENT, "event").split(", ")]


def _there(spark, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
