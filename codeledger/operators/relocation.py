"""Where sources went along a line of snapshots, and whether their absence is covered there.

Events are renames and deletions of a path at a position of a line.  Each event is followed by the
first later event of the path that it gives, so events form a forest.  Its pointers are composed
with themselves (1, 2, 4, ... steps), and a request (from a path and position up to a position)
takes the longest jump that stays within its bound, then half of it, and so on: rounds grow with
the logarithm of the longest chain of renames, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: What a trace and the scope of the later snapshot say.
RELOCATED, DELETED, COVERED, OUT_OF_SCOPE, INCOMPLETE = "source-relocated", "source-deleted", "complete-relocation-coverage", "prior-source-out-of-scope", "relocation-coverage-incomplete"


def _events(renames: DataFrame, deletions: DataFrame) -> DataFrame:
    """(event, line, position, path, target): one event at most of a path at a position; a deletion has
    no target and comes before a rename."""
    every = renames.select("line", F.col("position").cast("long").alias("position"), F.col("prior").alias("path"), F.col("current").alias("target")).unionByName(
        deletions.select("line", F.col("position").cast("long").alias("position"), F.col("prior").alias("path"), F.lit(None).cast("string").alias("target"))
    )
    one = every.groupBy("line", "position", "path").agg(F.max(F.col("target").isNull()).alias("gone"), F.min("target").alias("target"))
    return one.select(F.struct("line", "position", "path").alias("event"), "line", "position", "path", F.when(~F.col("gone"), F.col("target")).alias("target"))


def _first_after(asked: DataFrame, events: DataFrame) -> DataFrame:
    """(key, event): the first event of each asked (key, line, path, position) behind its position; null
    if there is none."""
    both = asked.select("key", "line", "path", "position", F.lit(0).alias("is_event"), F.lit(None).cast(events.schema["event"].dataType).alias("event")).unionByName(
        events.select(F.lit(None).cast(asked.schema["key"].dataType).alias("key"), "line", "path", "position", F.lit(1).alias("is_event"), "event")
    )
    # From the end: an event stands behind the requests of its own position.
    behind = Window.partitionBy("line", "path").orderBy(F.desc("position"), "is_event").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("event", F.last("event", ignorenulls=True).over(behind)).filter("is_event = 0").select("key", "event")


def trace_sources(requests: DataFrame, renames: DataFrame, deletions: DataFrame) -> DataFrame:
    """(id, path, outcome, steps): where each source is at the end of its request.

    ``requests``: id, line, path, after, through (null: to the end of the line); ``renames``: line, position,
    prior, current; ``deletions``: line, position, prior.  An event counts if after < position <= through.
    outcome: unchanged, relocated or deleted; a deleted source keeps its last path; steps are its renames."""
    events = cut(_events(renames, deletions))
    given = events.filter("target is not null").select(F.col("event").alias("key"), "line", F.col("target").alias("path"), "position")
    following = _first_after(given, events).filter("event is not null")
    jumps = [cut(following.select(F.col("key").alias("from"), F.col("event").alias("to")))]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        jumps.append(cut(last.join(last.select(F.col("from").alias("to"), F.col("to").alias("next")), "to").select("from", F.col("next").alias("to"))))
    asked = requests.select(F.col("id").alias("key"), "line", "path", F.col("after").cast("long").alias("position"), F.col("through").cast("long").alias("through"))
    within = F.col("through").isNull() | (F.col("event.position") <= F.col("through"))
    first = _first_after(asked, events).join(asked.select("key", "through", F.col("path").alias("start")), "key")
    now = first.select("key", "start", "through", F.when(within, F.col("event")).alias("event")).withColumn("steps", F.lit(0).cast("long"))
    for k in range(len(jumps) - 2, -1, -1):
        to = F.col("to")
        fits = to.isNotNull() & (F.col("through").isNull() | (to["position"] <= F.col("through")))
        now = cut(now.join(jumps[k], now["event"] == jumps[k]["from"], "left").select("key", "start", "through", F.when(fits, to).otherwise(F.col("event")).alias("event"), (F.col("steps") + F.when(fits, 1 << k).otherwise(0)).alias("steps")))
    ended = now.join(events.select("event", "target"), "event", "left")
    gone = F.col("event").isNotNull() & F.col("target").isNull()
    steps = F.when(F.col("event").isNull(), 0).when(gone, F.col("steps")).otherwise(F.col("steps") + 1).cast("long")
    return ended.select(F.col("key").alias("id"), F.coalesce("target", "event.path", "start").alias("path"), F.when(F.col("event").isNull(), "unchanged").when(gone, "deleted").otherwise("relocated").alias("outcome"), steps.alias("steps"))


def _prefixes(path: Column) -> Column:
    """The path itself and every folder that it lies in; the empty text is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def relocation_coverage(traced: DataFrame, scopes: DataFrame, selected: DataFrame, excluded: DataFrame) -> DataFrame:
    """(id, blockers, proofs): whether the later snapshot covers what became of each source.

    ``traced``: id, path, outcome, steps (of :func:`trace_sources`) and scope; ``scopes``: scope, complete;
    ``selected`` and ``excluded``: scope, prefix (a folder or a file; a scope without selected rows takes
    all).  A complete scope proves it; a partial one never does, and says why."""
    flat = traced.select("id", "scope", "path", "outcome", "steps").withColumn("prefix", F.explode(_prefixes(F.col("path"))))
    hit = lambda rules, name: flat.join(rules.select("scope", "prefix").distinct(), ["scope", "prefix"], "left_semi").select("id").distinct().withColumn(name, F.lit(True))
    narrowed = selected.select("scope").distinct().withColumn("narrowed", F.lit(True))
    full = traced.join(scopes.select("scope", "complete"), "scope", "left").join(hit(excluded, "out"), "id", "left").join(hit(selected, "inside"), "id", "left").join(narrowed, "scope", "left")
    gone = F.col("outcome") == "deleted"
    said = [F.when(F.col("steps") > 0, F.lit(RELOCATED)), F.when(gone, F.lit(DELETED))]
    outside = ~gone & (F.coalesce("out", F.lit(False)) | (F.coalesce("narrowed", F.lit(False)) & ~F.coalesce("inside", F.lit(False))))
    kept = lambda *codes: F.array_sort(F.filter(F.array(*codes), lambda x: x.isNotNull()))
    complete, moved = F.coalesce("complete", F.lit(False)), (F.col("steps") > 0) | gone
    none = F.array().cast("array<string>")
    return full.select("id", F.when(complete, none).otherwise(kept(*said, F.when(outside, F.lit(OUT_OF_SCOPE)), F.lit(INCOMPLETE))).alias("blockers"), F.when(complete & moved, kept(*said, F.lit(COVERED))).otherwise(none).alias("proofs"))
