"""Report comparison, improvement validation and performance gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_each(items: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order`` (duplicates in a report: the last wins)."""
    return items.groupBy(key).agg(F.max_by(F.struct(*[c for c in items.columns if c != key]), order).alias("__r")).select(key, "__r.*")


def compare_items(before: DataFrame, after: DataFrame, key: str = "id", sets: tuple[str, ...] = (), values: tuple[str, ...] = ("location", "priority"), score: str = "score") -> DataFrame:
    """(key, status, score_before, score_after, score_delta, and for each set its added and
    removed): added, removed, changed or unchanged.  A delta is null if either side is."""
    cols = [score, *values, *sets]
    a = before.select(key, *[F.col(c).alias(f"{c}_before") for c in cols], F.lit(True).alias("__a"))
    b = after.select(key, *[F.col(c).alias(f"{c}_after") for c in cols], F.lit(True).alias("__b"))
    both = a.join(b, key, "full")
    same = F.lit(True)
    for c in (score, *values):
        same = same & F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    deltas = []
    for c in sets:
        x, y = F.coalesce(f"{c}_before", F.array()), F.coalesce(f"{c}_after", F.array())
        deltas += [F.array_sort(F.array_except(y, x)).alias(f"{c}_added"), F.array_sort(F.array_except(x, y)).alias(f"{c}_removed")]
        same = same & (F.size(F.array_except(y, x)) == 0) & (F.size(F.array_except(x, y)) == 0)
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select(key, status.alias("status"), F.col(f"{score}_before").alias("score_before"), F.col(f"{score}_after").alias("score_after"), (F.col(f"{score}_after") - F.col(f"{score}_before")).alias("score_delta"), *deltas)


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row: counts by status, total scores (null as 0) and their delta."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return compared.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")],
        zero("score_before").alias("total_before"), zero("score_after").alias("total_after"), (zero("score_after") - zero("score_before")).alias("total_delta"),
    )


def missing_evidence_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(evidence, change): ids that are missing on one side only."""
    return before.exceptAll(after).distinct().withColumn("change", F.lit("resolved")).unionByName(after.exceptAll(before).distinct().withColumn("change", F.lit("introduced")))


def validate_improvement(summary: DataFrame, minimum: float = 0.0) -> DataFrame:
    """``summary`` with improvement, passed and exit_status (0 or 1)."""
    if minimum < 0:
        raise ValueError("the minimum improvement must not be negative")
    gain = F.col("total_before") - F.col("total_after")
    return summary.withColumn("improvement", gain).withColumn("passed", gain >= minimum).withColumn("exit_status", F.when(gain >= minimum, 0).otherwise(1))


WORKLOAD = ("analyzer", "workload_family", "input_sha256", "command", "mode", "context")
#: What is said of each part of the workload's identity, in the order of WORKLOAD.
DIFFERS = ("analyzer differs", "workload family differs", "input checksum differs", "command fingerprint differs", "analysis mode differs", "optional context differs")


def _regression(base: Column, new: Column) -> Column:
    return F.when(base > 0, (new - base) / F.nullif(base, F.lit(0.0)) * 100).when(new > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def performance_gate(pairs: DataFrame, wall_percent: float = 10.0, wall_seconds: float = 0.010, memory_percent: float = 15.0, memory_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """``pairs`` (columns of both sides as base_* and new_*: WORKLOAD, pair_id, wall_s,
    peak_bytes) with comparable, passed, wall_percent, memory_percent, memory_bytes, reasons.

    A side fails only beyond the percentage *and* the absolute floor."""
    reasons = [F.when(~F.col(f"base_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(said)) for c, said in zip(WORKLOAD, DIFFERS, strict=True)]
    reasons.append(F.when(~F.col("base_pair_id").eqNullSafe(F.col("new_pair_id")), F.lit("measurement pair generation differs")))
    differ = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    ok = F.size(differ) == 0
    wall = _regression(F.col("base_wall_s"), F.col("new_wall_s"))
    peak = _regression(F.col("base_peak_bytes").cast("double"), F.col("new_peak_bytes").cast("double"))
    more = F.greatest(F.lit(0).cast("long"), F.col("new_peak_bytes") - F.col("base_peak_bytes"))
    slow = (wall > wall_percent) & (F.col("new_wall_s") - F.col("base_wall_s") > wall_seconds)
    fat = (peak > memory_percent) & (more > memory_bytes)
    over = F.filter(F.array(F.when(slow, F.lit("wall-clock")), F.when(fat, F.lit("peak-memory"))), lambda r: r.isNotNull())
    return (
        pairs.withColumn("comparable", ok).withColumn("passed", ok & ~slow & ~fat)
        .withColumn("wall_regression_percent", F.when(ok, wall)).withColumn("memory_regression_percent", F.when(ok, peak)).withColumn("memory_regression_bytes", F.when(ok, more))
        .withColumn("reasons", F.when(ok, over).otherwise(differ))
    )


def exit_status(complete: Column, gate_passed: Column) -> Column:
    """2: incomplete; 1: the gate failed; 0: fine."""
    return F.when(~complete, 2).when(~gate_passed, 1).otherwise(0)
