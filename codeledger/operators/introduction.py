"""When a finding came in: a bounded search over a history graph, and its trace.

Edges: (child, parent) of revisions; a revision may have several parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def search(edges: DataFrame, start: DataFrame, most_revisions: int) -> dict[str, DataFrame]:
    """Breadth first from ``start`` (id) over parents: revisions (id, depth), and the frontier of
    those that the budget left unvisited.  A level is taken as a whole or, if it would pass the
    budget, in order of id up to it."""
    seen = cut(start.select("id", F.lit(0).cast("long").alias("depth")).distinct())
    level, n = seen, seen.count()
    depth = 0
    while True:
        depth += 1
        nxt = cut(level.join(edges.select(F.col("child").alias("id"), "parent"), "id").select(F.col("parent").alias("id")).distinct().join(seen.select("id"), "id", "left_anti"))
        more = nxt.count()
        if not more:
            return {"revisions": seen, "frontier": nxt}
        if n + more > most_revisions:
            taken = cut(nxt.orderBy("id").limit(most_revisions - n))  # the budget is the feature
            left = nxt.join(taken, "id", "left_anti")
            return {"revisions": seen.unionByName(taken.withColumn("depth", F.lit(depth).cast("long"))), "frontier": left}
        level = nxt
        seen = cut(seen.unionByName(nxt.withColumn("depth", F.lit(depth).cast("long"))))
        n += more


def assess(revisions: DataFrame, detections: DataFrame, blockers: dict[str, str]) -> DataFrame:
    """(revision, outcome, reasons): incomplete if any blocker column of ``revisions`` holds,
    else present if the finding's digests were seen there (``detections``: revision), else absent."""
    codes = F.array_sort(F.filter(F.array(*[F.when(F.col(c), F.lit(code)) for code, c in blockers.items()]), lambda x: x.isNotNull()))
    hits = detections.groupBy("revision").agg(F.count("*").alias("n"))
    full = revisions.withColumn("reasons", codes).join(hits, "revision", "left")
    n = F.coalesce("n", F.lit(0))
    many = F.when(n > 1, F.array_union("reasons", F.array(F.lit("historical-continuity-ambiguous")))).otherwise(F.col("reasons"))
    return full.select("revision", F.when(F.size(many) > 0, "incomplete").when(n == 1, "present").otherwise("absent").alias("outcome"), many.alias("reasons"))


#: Why a trace ends where it does.
ROOT, PARENTS_ABSENT, MANY, NO_PARENT, NO_BUDGET, NO_ANCESTRY, FOLLOWED = "verified-repository-root", "verified-parent-absence", "multiple-positive-parent-lineages", "history-parent-missing", "history-budget-exhausted", "history-ancestry-incomplete", "positive-parent-followed"


def trace_all(edges: DataFrame, assessed: DataFrame, starts: DataFrame, frontier: DataFrame | None = None) -> DataFrame:
    """(finding, start, kind, revision, steps, reasons): where each finding came in, all at once.

    ``edges``: child, parent; ``assessed``: finding, revision, outcome (present, absent, incomplete) and,
    if there are any, reasons (array); ``starts``: finding, revision; ``frontier``: revisions that the
    search's budget left out.  From a revision that shows the finding the single parent that shows it
    too is followed.  exact: a root, or all parents prove absence; bounded: a parent is incomplete or
    wasn't assessed, or several show it, or the history has a cycle.

    Each (finding, revision) has one pointer, to its parent or to itself where a trace ends.  Pointers
    jump twice as far in every round and carry the steps they stand for, so rounds grow with the
    logarithm of the longest history, and no path is ever listed."""
    if "reasons" not in assessed.columns:
        assessed = assessed.withColumn("reasons", F.array().cast("array<string>"))
    present = assessed.filter("outcome = 'present'").select("finding", "revision")
    known = assessed.select("finding", F.col("revision").alias("parent"), "outcome", "reasons")
    left_out = (frontier if frontier is not None else edges.select(F.col("parent").alias("revision")).limit(0)).select(F.col("revision").alias("parent")).distinct().withColumn("cut", F.lit(True))
    up = present.join(edges.select(F.col("child").alias("revision"), "parent").distinct(), "revision", "left").join(known, ["finding", "parent"], "left").join(left_out, "parent", "left")
    why = F.when(F.col("parent").isNull(), F.array().cast("array<string>")).when(F.col("outcome").isNull(), F.array(F.when(F.col("cut"), F.lit(NO_BUDGET)).otherwise(F.lit(NO_PARENT)))).when(F.col("outcome") == "incomplete", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit(NO_ANCESTRY))))
    sums = up.select("finding", "revision", "parent", "outcome", F.explode_outer(F.coalesce(why, F.array().cast("array<string>"))).alias("why")).groupBy("finding", "revision").agg(
        F.count_distinct("parent").alias("parents"), F.count_distinct(F.when(F.col("outcome") == "present", F.col("parent"))).alias("positive"),
        F.min(F.when(F.col("outcome") == "present", F.col("parent"))).alias("next"), F.array_sort(F.collect_set("why")).alias("blockers"),  # a few codes
    )
    end = F.when(F.col("parents") == 0, F.array(F.lit(ROOT))).when(F.size("blockers") > 0, F.col("blockers")).when(F.col("positive") == 0, F.array(F.lit(PARENTS_ABSENT))).when(F.col("positive") > 1, F.array(F.lit(MANY)))
    now = cut(sums.select("finding", "revision", F.when(end.isNull(), F.col("next")).otherwise(F.col("revision")).alias("at"), F.when(end.isNull(), 1).otherwise(0).cast("long").alias("steps"), end.alias("end")))
    rows, reach = now.count(), 1
    while reach <= 2 * rows and not now.filter("end is null").isEmpty():
        ahead = now.select("finding", F.col("revision").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("end").alias("known"))
        moved = now.filter("end is null").join(ahead, ["finding", "at"]).select("finding", "revision", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("known").alias("end"))
        now, reach = cut(now.filter("end is not null").unionByName(moved)), 2 * reach
    asked = starts.select("finding", F.col("revision").alias("start")).distinct().join(now.withColumnRenamed("revision", "start"), ["finding", "start"], "left")
    exact = F.array_contains("end", ROOT) | F.array_contains("end", PARENTS_ABSENT)
    reasons = F.when(F.col("end").isNull(), F.array(F.lit(NO_ANCESTRY))).when(F.col("steps") > 0, F.array_sort(F.array_union("end", F.array(F.lit(FOLLOWED))))).otherwise(F.col("end"))
    ended = F.col("end").isNotNull()
    return asked.select("finding", "start", F.when(exact, "exact").otherwise("bounded").alias("kind"), F.when(ended, F.col("at")).otherwise(F.col("start")).alias("revision"), F.when(ended, F.col("steps")).otherwise(0).cast("long").alias("steps"), reasons.alias("reasons"))


def trace(edges: DataFrame, assessed: DataFrame, start: str) -> dict[str, object]:
    """The trace of one finding (``assessed``: revision, outcome) from one revision that shows it: kind,
    revision, steps, reasons."""
    one = F.lit("finding").alias("finding")
    shown = edges.sparkSession.createDataFrame([(start, "present")], "revision string, outcome string")
    rows = assessed.select("revision", "outcome").filter(F.col("revision") != start).unionByName(shown)
    row = trace_all(edges, rows.select(one, "revision", "outcome"), edges.sparkSession.createDataFrame([("finding", start)], "finding string, revision string")).first()
    return {"kind": row.kind, "revision": row.revision, "steps": row.steps, "reasons": list(row.reasons)}


def reusable(history: DataFrame, key: str = "revision") -> DataFrame:
    """Complete historical snapshots without detections: their absence needn't be looked up anew."""
    return history.filter("complete and detections = 0").select(key).distinct()
