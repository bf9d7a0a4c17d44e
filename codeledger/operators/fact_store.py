"""The incremental fact store: each content is parsed once, and an edit costs what it changes.

* ``contents``: facts by content (a digest of module and text), append-only; equal files share them.
* ``entries``: for each run and source its content and the budget that was left when its turn came.

A run parses the contents that the store doesn't have, sums the budgeted facts of the sources in
order of their path (ranges are summed by themselves and moved by what stands before them), and
takes of each source what its incoming budget allows.  A source is invalid if its module, its content
or its incoming budget differs from the last run's; the others are reused.  What the store
returns equals a fresh run, whatever was edited.  Both tables are versioned: a run that dies leaves
nothing that the next one sees, and runs at the same time don't lose each other's contents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sinks.versioned import VersionedTable
from . import cache
from .shared import cut

CONTENTS = "id string, content string, fact string, ord long, payload string"
ENTRIES = "id string, run long, path string, module string, digest string, budget long"
#: A row that says that a content was parsed, even if it has no facts.
PARSED = "parsed"


@dataclass
class Run:
    """``facts``: path, module, fact, ord, payload; ``invalid``: path, reason; ``parsed``: contents that
    were parsed; ``reused``: sources whose entry is as it was; ``number``: of the run."""

    facts: DataFrame
    entries: DataFrame
    invalid: DataFrame
    parsed: int
    reused: int
    number: int
    disposition: str


def incoming_budgets(counts: DataFrame, limit: int) -> DataFrame:
    """(path, budget): what is left of ``limit`` before each source (path, n), in order of the path."""
    per = cut(counts.repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    ranges = per.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each range
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("inside", inside).join(ranges, "part").select("path", F.greatest(F.lit(limit) - F.col("before") - F.col("inside"), F.lit(0)).cast("long").alias("budget"))


class FactStore:
    """Facts of a tree of sources, kept in ``path``.

    ``parse`` takes sources (path, module, content) to (path, fact, ord, payload), ord counting the
    facts of a kind in a source from 0; ``budgeted`` are the kinds that the budget counts."""

    def __init__(self, spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], budgeted: tuple[str, ...], limit: int):
        self.spark, self.parse, self.budgeted, self.limit = spark, parse, budgeted, limit
        self.contents = VersionedTable(spark, f"{path}/contents", CONTENTS)
        self.entries = VersionedTable(spark, f"{path}/entries", ENTRIES)

    def _last(self) -> tuple[DataFrame, int]:
        every = self.entries.read()
        number = every.agg(F.max("run")).first()[0] or 0
        return every.filter(F.col("run") == number).select("path", "module", "digest", "budget"), number

    def run(self, sources: DataFrame) -> Run:
        """Resolve the facts of ``sources`` (path, module, content; paths are unique)."""
        framed = F.concat(F.length(F.coalesce("module", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("module", F.lit("")), F.coalesce("content", F.lit("")))
        now = sources.select("path", "module", F.coalesce("content", F.lit("")).alias("content"), F.sha2(framed, 256).alias("digest"))
        retained, number = self._last()
        have = self.contents.read().filter(F.col("fact") == PARSED).select(F.col("content").alias("digest"))
        fresh = now.dropDuplicates(["digest"]).join(have, "digest", "left_anti").select(F.col("digest").alias("path"), "module", "content")
        made = self.parse(fresh).select(F.col("path").alias("content"), "fact", F.col("ord").cast("long").alias("ord"), "payload")
        marks = fresh.select(F.col("path").alias("content"), F.lit(PARSED).alias("fact"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("payload"))
        rows = made.unionByName(marks).select(F.concat_ws("|", "content", "fact", F.col("ord").cast("string")).alias("id"), "content", "fact", "ord", "payload")
        before = self.contents.folders()
        self.contents.append_once(rows, "id")
        added = [f for f in self.contents.folders() if f not in before]
        parsed = self.spark.read.schema(CONTENTS).parquet(*[f"{self.contents.path}/{f}" for f in added]).filter(F.col("fact") == PARSED).count() if added else 0
        stored = self.contents.read()
        units = stored.filter(F.col("fact").isin(*self.budgeted)).groupBy(F.col("content").alias("digest")).agg(F.count("*").alias("n"))
        keyed = cut(now.select("path", "module", "digest"))
        counts = keyed.join(units, "digest", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))
        current = cut(keyed.join(incoming_budgets(counts, self.limit), "path"))
        invalid = cut(cache.invalidations(current, retained)) if number else cut(current.select("path", F.lit("source-added").alias("reason")))
        changed = invalid.filter("reason <> 'source-removed'").count()
        disposition = "cold-rebuild" if not number else "warm-reuse" if invalid.isEmpty() else "partial-rebuild"
        if disposition != "warm-reuse":
            number += 1
            self.entries.append_once(current.select(F.concat_ws("|", F.lit(number).cast("string"), "path").alias("id"), F.lit(number).cast("long").alias("run"), "path", "module", "digest", "budget"), "id")
        facts = current.join(stored.filter(F.col("fact") != PARSED).withColumnRenamed("content", "digest"), "digest")
        facts = facts.filter(~F.col("fact").isin(*self.budgeted) | (F.col("ord") < F.col("budget"))).select("path", "module", "fact", "ord", "payload")
        return Run(facts, current, invalid, parsed, current.count() - changed, number, disposition)
