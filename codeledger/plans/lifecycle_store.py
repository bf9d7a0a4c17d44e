"""A history of analyses: each becomes a snapshot, is placed, reconciled with its parent and appended.

All of it is one versioned table (id, kind, payload), so a snapshot comes with its detections,
events and findings in one commit or not at all, and recording the same snapshot again writes
nothing.  Each kind has a schema of its own, in which its payloads are read back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import facts as extract
from ..operators import digest_tree, introduction, lifecycle, reducer
from ..operators.shared import cut
from ..sinks.versioned import VersionedTable
from . import analysis

ROWS = "id string, kind string, payload string"
KINDS = {
    "snapshot": "id string, parent_id string, revision string, clean boolean, scope string, digest string",
    "detection": f"snapshot string, id string, {', '.join(f'{c} {"long" if c in ("line", "column") else "string"}' for c in reducer.PLACE)}",
    "known": reducer.LEVEL,
    "event": "finding string, snapshot string, kind string, event_id string, basis string, detection string",
    "unresolved": "snapshot string, detection string",
    "rename": "snapshot string, prior string, current string",
    "proof": "snapshot string, rule string",
}
KEYS = {"snapshot": ("id",), "detection": ("snapshot", "id"), "known": ("snapshot", "finding"), "event": ("event_id",), "unresolved": ("snapshot", "detection"), "rename": ("snapshot", "prior", "current"), "proof": ("snapshot", "rule")}


@dataclass
class Snapshot:
    """What is observed at one revision.  ``detections``: id and the reducer's PLACE; ``proofs``: rules
    that ran over all sources; ``renames``: prior, current."""

    id: str
    detections: DataFrame
    proofs: DataFrame
    revision: str | None = None
    parents: tuple[str, ...] = ()
    clean: bool = True
    scope: str = "repository"
    digest: str = ""
    renames: DataFrame | None = None


class Refused(ValueError):
    """A snapshot that has no place in the history, or that was recorded with other content."""


class LifecycleStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path, ROWS)

    def read(self, kind: str) -> DataFrame:
        rows = self.table.read().filter(F.col("kind") == kind)
        return rows.select(F.from_json("payload", KINDS[kind]).alias("p")).select("p.*")

    def _rows(self, kind: str, rows: DataFrame) -> DataFrame:
        names = [c.split(" ")[0] for c in KINDS[kind].split(", ")]
        return rows.select(F.concat_ws("\x1f", F.lit(kind), *KEYS[kind]).alias("id"), F.lit(kind).alias("kind"), F.to_json(F.struct(*names)).alias("payload"))

    def record(self, snapshot: Snapshot) -> tuple[str, DataFrame]:
        """(outcome, events): recorded, or already-present; the events that it gave."""
        stored = self.read("snapshot")
        arriving = self.spark.createDataFrame([(snapshot.id, snapshot.revision, snapshot.clean, list(snapshot.parents))], "id string, revision string, clean boolean, parents array<string>")
        placed = lifecycle.place(arriving, stored.select("id", "revision", "clean", F.lit(True).alias("processed"))).first()
        if placed.placement == "existing":
            if stored.filter((F.col("id") == snapshot.id) & (F.col("digest") == snapshot.digest)).isEmpty():
                raise Refused(f"snapshot {snapshot.id} was recorded with other content")
            return "already-present", self.read("event").filter(F.lit(False))
        if placed.placement not in ("root", "successor"):
            raise Refused(f"snapshot {snapshot.id} has no place in the history: {placed.placement}")
        one = self.spark.createDataFrame([(snapshot.id, placed.predecessor, snapshot.revision, snapshot.clean, snapshot.scope, snapshot.digest)], KINDS["snapshot"])
        here = lambda df: df.withColumn("snapshot", F.lit(snapshot.id))
        detections = cut(here(snapshot.detections if "semantics" in snapshot.detections.columns else snapshot.detections.withColumn("semantics", F.lit(None).cast("string"))))
        proofs = here(snapshot.proofs.select("rule").distinct()) if snapshot.scope == "repository" else self.read("proof").filter(F.lit(False))
        renames = here(snapshot.renames.select("prior", "current")) if snapshot.renames is not None else self.read("rename").filter(F.lit(False))
        done = reducer.reduce_forest(stored.select("id", "parent_id").unionByName(one.select("id", "parent_id")), detections, renames, proofs, known=self.read("known"))
        out = None
        for kind, rows in (("snapshot", one), ("detection", detections), ("rename", renames), ("proof", proofs), ("known", done.known), ("event", done.events), ("unresolved", done.unresolved)):
            out = self._rows(kind, rows) if out is None else out.unionByName(self._rows(kind, rows))
        self.table.append_once(out, "id")
        return "recorded", done.events

    def introductions(self, finding: str | None = None) -> DataFrame:
        """(finding, start, kind, revision, steps, reasons): where each finding that is open at a head came
        in, of all of them or of one."""
        snapshots, known = self.read("snapshot"), self.read("known")
        if finding is not None:
            known = known.filter(F.col("finding") == finding)
        shown = F.col("kind").isin("opened", "observed", "reopened")
        told = known.select("finding", F.col("snapshot").alias("revision"), F.when(shown, "present").when(F.col("state") == "resolved", "absent").otherwise("incomplete").alias("outcome"))
        # Where a finding isn't known yet, its absence is proven if its rule ran there over all sources.
        rules = known.select("finding", "rule").distinct()
        unborn = rules.join(self.read("proof"), "rule").select("finding", F.col("snapshot").alias("revision")).join(told.select("finding", "revision"), ["finding", "revision"], "left_anti").withColumn("outcome", F.lit("absent"))
        edges = snapshots.filter("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("parent"))
        heads = lifecycle.heads(edges, snapshots.select("id"))
        starts = told.filter("outcome = 'present'").join(heads.select(F.col("id").alias("revision")), "revision", "left_semi").select("finding", "revision")
        return introduction.trace_all(edges, told.unionByName(unborn), starts)

    def inspect(self, snapshot: str) -> DataFrame:
        """(id, rule, source, line, column, finding, kind): a snapshot's detections and what became of each;
        those of unresolved groups have kind ``unresolved``."""
        seen = self.read("event").filter((F.col("snapshot") == snapshot) & F.col("detection").isNotNull()).select(F.col("detection").alias("id"), "finding", "kind")
        open_ = self.read("unresolved").filter(F.col("snapshot") == snapshot).select(F.col("detection").alias("id"), F.lit(None).cast("string").alias("finding"), F.lit("unresolved").alias("kind"))
        rows = self.read("detection").filter(F.col("snapshot") == snapshot).select("id", "rule", "source", "line", "column")
        return rows.join(seen.unionByName(open_), "id", "left")


def snapshot_of(done: analysis.Analysis, sources: DataFrame, revision: str | None = None, parents: tuple[str, ...] = (), clean: bool = True, scope: str = "repository") -> Snapshot:
    """An analysis as a snapshot: its detections numbered in order, with their structural digests."""
    digest = digest_tree.root_digest(digest_tree.tree(digest_tree.leaves(sources)))
    places = extract.structural_digests(done.facts).withColumnRenamed("path", "source")
    detections = lifecycle.numbered_detections(places).select("id", "rule", "source", "line", "column", "subject_digest", "decl_digest")
    results = analysis.rule_results(done.facts, [r.identity for r in analysis.BUILT_IN])
    proofs = results.groupBy("rule").agg(F.min(F.col("outcome") == "committed").alias("complete")).filter("complete").select("rule")
    return Snapshot(f"snapshot:{revision or digest}", detections, proofs, revision, tuple(parents), clean, scope, digest)
