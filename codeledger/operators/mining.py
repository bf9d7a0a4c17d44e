"""Repository-wide mining: closed itemsets of shared elements, repeated ordered shapes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from .shared import cut


@dataclass
class Mined:
    """A rule's outcome: groups, whether it is complete, and the issue codes."""

    groups: DataFrame
    complete: bool
    issues: list[str]


_GROUPS = "items array<string>, support long, units array<string>"


def closed_itemsets(units: DataFrame, unit: str = "unit", items: str = "items", min_items: int = 3, min_support: int = 2, max_comparisons: int | None = policy.REPOSITORY_LIMITS["comparisons"], max_units: int | None = policy.REPOSITORY_LIMITS["units"], max_groups: int | None = policy.REPOSITORY_LIMITS["detections"], name_units: bool = True) -> Mined:
    """Closed itemsets of at least ``min_items`` elements that ``min_support`` units hold.

    Each closed set is extended by every later element that enough of its units hold, and closed again
    (all elements that those units share); the extension counts only if the closure brings no
    element before the one that was added, so each closed set is made exactly once, from one other.
    A level of extensions is a few aggregations over (closed set, unit set, element): sets never meet
    sets, so an element of very many units costs its rows, not their pairs.  Equal unit sets are one
    row with a count.

    Budgets (None: none) fail closed: past ``max_comparisons`` the result is incomplete and empty.
    The comparisons are those of an enumeration that meets every candidate (closed set of enough
    elements) with every unit twice and its holders once more; they follow from the counts, and are
    checked after each level.  ``name_units``: list the units of each group, which grows with them."""
    spark = units.sparkSession
    nothing = spark.createDataFrame([], _GROUPS)
    every = units.count() if max_units is not None or max_comparisons is not None else 0
    if max_units is not None and every > max_units:
        return Mined(nothing, False, ["analysis-unit-budget-exceeded"])
    clean = units.select(F.col(unit).cast("string").alias("unit"), F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("items")).filter(F.size("items") >= min_items)
    sets = cut(clean.groupBy("items").agg(F.count("*").alias("n")).withColumn("set", F.xxhash64("items")).withColumn("set", F.struct("set", "items")))
    least = 1 if max_comparisons is not None else min_support  # candidates of one unit cost comparisons too
    flat = cut(sets.select("set", "n", F.explode("items").alias("element")))
    total, units_in = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if units_in < least or not total:
        return Mined(nothing, True, [])
    shared = sorted(r.element for r in flat.groupBy("element").agg(F.count("*").alias("k")).filter(F.col("k") == total).select("element").collect())  # no more than one unit has
    start = F.array(*map(F.lit, shared)).cast("array<string>")
    held = cut(sets.select(start.alias("closed"), F.lit(None).cast("string").alias("core"), "set", "n"))
    levels, candidates = [held], 0
    while True:
        size = levels[-1].filter(F.size("closed") >= min_items).select("closed").distinct().count() if max_comparisons is not None else 0
        candidates += size
        if max_comparisons is not None and 2 * candidates * every > max_comparisons:
            return Mined(nothing, False, ["comparison-budget-exceeded"])
        last = levels[-1]
        grown = last.join(flat.drop("n"), "set").filter((F.col("core").isNull() | (F.col("element") > F.col("core"))) & ~F.array_contains("closed", F.col("element"))).select("closed", F.col("element").alias("added"), "set", "n")
        enough = grown.groupBy("closed", "added").agg(F.sum("n").alias("support"), F.count("*").alias("k")).filter(F.col("support") >= least)
        grown = cut(grown.join(enough.select("closed", "added", "k"), ["closed", "added"]))
        if grown.isEmpty():
            break
        inside = grown.join(flat.drop("n"), "set").groupBy("closed", "added", "element").agg(F.count("*").alias("have"), F.first("k").alias("k")).filter("have = k")
        made = inside.groupBy("closed", "added").agg(F.array_sort(F.collect_list("element")).alias("made"))  # no more than one unit has
        before = lambda c: F.size(F.filter(c, lambda x: x < F.col("added")))
        made = made.filter(before("made") == before("closed"))
        levels.append(cut(grown.join(made, ["closed", "added"]).select(F.col("made").alias("closed"), F.col("added").alias("core"), "set", "n")))
    holders = levels[0]
    for level in levels[1:]:
        holders = holders.unionByName(level)
    holders = holders.filter(F.size("closed") >= min_items)
    supports = cut(holders.groupBy("closed").agg(F.sum("n").alias("support")).filter(F.col("support") >= min_support))
    if max_comparisons is not None:
        spent = 2 * candidates * every + int(supports.agg(F.coalesce(F.sum("support"), F.lit(0))).first()[0])
        if spent > max_comparisons:
            return Mined(nothing, False, ["comparison-budget-exceeded"])
    groups = supports.select(F.col("closed").alias("items"), "support")
    if name_units:
        named = holders.join(supports.select("closed"), "closed", "left_semi").select("closed", F.col("set.items").alias("items")).join(clean, "items")
        groups = groups.join(named.groupBy(F.col("closed").alias("items")).agg(F.array_sort(F.collect_list("unit")).alias("units")), "items")
    if max_groups is not None and supports.count() > max_groups:
        return Mined(groups.orderBy("items").limit(max_groups), False, ["detection-budget-exceeded"])
    return Mined(groups, True, [])


def repeated_shapes(units: DataFrame, by: list[str], min_occurrences: int = 2, order: str | None = None) -> DataFrame:
    """Groups of equal keys (an ordered array may be one) with occurrences and first place."""
    aggs = [F.count("*").alias("occurrences")] + ([F.min(order).alias("first")] if order else [])
    return units.groupBy(*by).agg(*aggs).filter(F.col("occurrences") >= min_occurrences)


def conditional_issues(units: DataFrame, flag: str = "conditional") -> bool:
    """Whether any unit stands under a compilation condition (the rule is then incomplete)."""
    return not units.filter(F.col(flag)).limit(1).isEmpty()


def fingerprint(*parts: str):
    """SHA-256 over length-framed parts of a row."""
    framed = [F.concat(F.length(F.coalesce(F.col(p).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(p).cast("string"), F.lit(""))) for p in parts]
    return F.sha2(F.concat_ws("|", *framed), 256)


def snapshot_digest(sources: DataFrame) -> DataFrame:
    """(digest, files): an identity of all sources.  Each file is digested where it is read; the
    digests are folded per two-digit prefix, then over the 256 prefixes."""
    one = sources.select(F.sha2(F.concat_ws("\n", "path", "module", F.sha2("content", 256)), 256).alias("d"))
    part = one.groupBy(F.substring("d", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"), F.count("*").alias("n"))
    return part.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "d"))), ""), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def within_budget(files: DataFrame, size: str = "bytes", max_files: int = policy.REPOSITORY_LIMITS["files"], max_bytes: int = policy.REPOSITORY_LIMITS["bytes"]) -> None:
    """Raise if there are too many files or bytes."""
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n > max_files or total > max_bytes:
        raise RuntimeError(f"repository budget exceeded: {n} files, {total} bytes")


def budgeted_units(units: DataFrame, file: str, limit: int) -> DataFrame:
    """Units of files in order while the running count is within ``limit`` + 1.

    Counts per file are dealt out by ranges of the file; a range's count before it is added to the
    running counts inside the range, so no task sees all files."""
    per = cut(units.groupBy(file).agg(F.count("*").alias("n")).repartitionByRange(file).withColumn("__part", F.spark_partition_id()))
    ranges = per.groupBy("__part").agg(F.sum("n").alias("__sum"))  # a row for each range
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__part").orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = per.filter(F.lit(True)).withColumn("__inside", inside).join(F.broadcast(ranges.select("__part", "__before")), "__part")
    return units.join(before.filter(F.col("__before") + F.col("__inside") <= limit).select(file), file, "left_semi")


def stale_sources(current: DataFrame, cached: DataFrame, keys: tuple[str, ...] = ("path", "module", "digest", "budget")) -> DataFrame:
    """Sources whose facts must be made anew: no cached row of equal identity."""
    return current.join(cached.select(*keys), list(keys), "left_anti")


SELECTOR = ("rule", "revision", "snapshot_digest", "path", "line", "column", "fingerprint")


def lookup(detections: DataFrame, selector: dict[str, object]) -> DataFrame:
    """The repository detections that a whole selector names: equal in all its parts."""
    if set(selector) != set(SELECTOR):
        raise ValueError(f"a selector has exactly {', '.join(SELECTOR)}")
    out = detections
    for k, v in selector.items():
        out = out.filter(F.col(k) == F.lit(v))
    return out
