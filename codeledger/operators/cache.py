"""Incremental fact cache: which sources can be reused, and why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dispositions(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, disposition, reasons): reused, recomputed, new or removed.  Both sides: path,
    module, digest, budget, schema_version, engine."""
    c = current.select("path", *[F.col(k).alias(f"c_{k}") for k in ("module", "digest", "budget", "schema_version", "engine")], F.lit(True).alias("c"))
    o = cached.select("path", *[F.col(k).alias(f"o_{k}") for k in ("module", "digest", "budget", "schema_version", "engine")], F.lit(True).alias("o"))
    both = c.join(o, "path", "full")
    checks = (("module", "module-changed"), ("digest", "content-changed"), ("budget", "incoming-budget-changed"), ("schema_version", "schema-changed"), ("engine", "engine-changed"))
    reasons = F.filter(F.array(*[F.when(~F.col(f"c_{k}").eqNullSafe(F.col(f"o_{k}")), F.lit(code)) for k, code in checks]), lambda x: x.isNotNull())
    state = F.when(F.col("o").isNull(), "new").when(F.col("c").isNull(), "removed").when(F.size(reasons) == 0, "reused").otherwise("recomputed")
    both_sides = F.col("c").isNotNull() & F.col("o").isNotNull()
    return both.select("path", state.alias("disposition"), F.when(both_sides, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"))


#: What a cache's header must agree in, and the reason if it doesn't.
HEADER = {"schema": "schema-mismatch", "fact_schema": "fact-schema-mismatch", "projection": "projection-changed", "provider": "provider-changed", "rule_semantics": "rule-semantics-changed", "configuration": "configuration-changed"}


def invalidations(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, reason): sources whose facts are made anew or go, each with its first reason.  Both
    sides: path, module, digest, budget (the facts that came before)."""
    keys = ("module", "digest", "budget")
    c = current.select("path", *[F.col(k).alias(f"c_{k}") for k in keys], F.lit(True).alias("c"))
    o = cached.select("path", *[F.col(k).alias(f"o_{k}") for k in keys], F.lit(True).alias("o"))
    differ = lambda k: ~F.col(f"c_{k}").eqNullSafe(F.col(f"o_{k}"))
    reason = (
        F.when(F.col("o").isNull(), "source-added").when(F.col("c").isNull(), "source-removed").when(differ("module"), "source-metadata-changed")
        .when(differ("digest"), "source-content-changed").when(differ("budget"), "dependency-changed")
    )
    return c.join(o, "path", "full").select("path", reason.alias("reason")).filter("reason is not null")


def plan(current: DataFrame, cached: DataFrame | None, header: dict[str, str], stored: dict[str, str] | None, mode: str = "reuse", corrupt: bool = False) -> tuple[str, dict[str, int]]:
    """(disposition, sources by reason) of a run over ``current``: what the cache is good for.

    ``mode``: reuse, rebuild or disabled; ``stored``: the header of the cache, None if there is no
    cache; ``corrupt``: the cache couldn't be read back as it was written."""
    n = current.count()
    if mode == "disabled":
        return "disabled", {"cache-disabled": n}
    if mode == "rebuild":
        return "forced-rebuild", {"forced-rebuild": n}
    if corrupt:
        return "recovered-corruption", {"cache-corrupt": n}
    if cached is None or stored is None:
        return "cold-rebuild", {"cache-missing": n}
    wrong = [code for key, code in HEADER.items() if header.get(key) != stored.get(key)]
    if wrong:
        return "incompatible-rebuild", dict.fromkeys(wrong, n)
    counts = {r.reason: r["count"] for r in invalidations(current, cached).groupBy("reason").count().collect()}
    return ("partial-rebuild" if counts else "warm-reuse"), counts
