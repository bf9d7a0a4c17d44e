"""Evidence, composite scores, filters, ranking and roll-ups.

Evidence rows: item_id, id, kind, requirement (required/optional), state, reason, weight,
normalized_score, raw_value.  A missing score is null and stays null; it is never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy

EVIDENCE = "item_id string, id string, kind string, requirement string, state string, reason string, weight double, normalized_score double, raw_value string"


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Clamp that keeps null (``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def normalised(value: Column, threshold: float) -> Column:
    """min(100, value * 100 / threshold); a threshold of zero is met by any positive value."""
    if threshold <= 0:
        return F.when(value > 0, F.lit(100.0)).when(value.isNotNull(), F.lit(0.0))
    return F.when(value.isNotNull(), F.least(F.lit(100.0), value * 100.0 / threshold))


def structural_evidence(items: DataFrame, item_id: str, rules: list[tuple[str, str, float, float]]) -> DataFrame:
    """One evidence row for each item and rule (suffix, column, threshold, weight)."""
    rows = F.array(*[
        F.struct(
            F.concat(F.col(item_id), F.lit(f":{suffix}")).alias("id"), F.lit(policy.KIND_PREFIX + suffix).alias("kind"), F.lit(weight).alias("weight"),
            normalised(F.col(column).cast("double"), limit).alias("normalized_score"), F.col(column).cast("string").alias("raw_value"),
        )
        for suffix, column, limit, weight in rules
    ])
    flat = items.select(F.col(item_id).alias("item_id"), F.explode(rows).alias("e"))
    return flat.select("item_id", "e.id", "e.kind", F.lit("optional").alias("requirement"), F.lit("available").alias("state"), F.lit(None).cast("string").alias("reason"), "e.weight", "e.normalized_score", "e.raw_value")


def oversized_type_evidence(types: DataFrame, item_id: str) -> DataFrame:
    """The greatest of the four type scores, as evidence of its own."""
    scores = [normalised(F.col(c).cast("double"), t) for _, c, t, _ in policy.TYPE_EVIDENCE]
    return types.select(
        F.col(item_id).alias("item_id"), F.concat(F.col(item_id), F.lit(":oversized-type")).alias("id"), F.lit(policy.KIND_PREFIX + "oversized-type").alias("kind"),
        F.lit("optional").alias("requirement"), F.lit("available").alias("state"), F.lit(None).cast("string").alias("reason"), F.lit(1.0).alias("weight"),
        F.greatest(*scores).alias("normalized_score"), F.greatest(*scores).cast("string").alias("raw_value"),
    )


def _weight_of(category: str, weights: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(category))


def effect_evidence(effects: DataFrame, function: str = "function", category: str = "category") -> DataFrame:
    """(function, category, n, score): side effects, min(100, n * weight * 12)."""
    counted = effects.groupBy(function, category).agg(F.count("*").alias("n"))
    return counted.withColumn("score", F.least(F.lit(100.0), F.col("n") * _weight_of(category, policy.SIDE_EFFECT_WEIGHTS) * 12))


def pure_functions(functions: DataFrame, effects: DataFrame, function: str = "function") -> DataFrame:
    """Functions without any effect (purity evidence of score 0)."""
    return functions.join(effects.select(function).distinct(), function, "left_anti")


def composition_evidence(compositions: DataFrame, function: str = "function", impure: str = "impure") -> DataFrame:
    """(function, n, score): 15 for each functional operation with an impure closure."""
    return compositions.groupBy(function).agg(F.count("*").alias("n"), (F.count_if(F.col(impure)) * 15.0).alias("score"))


def risk_evidence(risks: DataFrame, function: str = "function", category: str = "category") -> DataFrame:
    """(function, category, n, kind, score): min(100, n * weight * 15)."""
    counted = risks.groupBy(function, category).agg(F.count("*").alias("n"))
    kind = F.when(F.col(category) == "mutableSharedState", F.lit(policy.SHARED_STATE_KIND)).otherwise(F.concat(F.lit(policy.RISK_KIND_PREFIX), F.col(category)))
    return counted.withColumn("kind", kind).withColumn("score", F.least(F.lit(100.0), F.col("n") * _weight_of(category, policy.RISK_WEIGHTS) * 15))


def api_risk(functions: DataFrame) -> DataFrame:
    """``functions`` with parameter_surface, public_boundary and pattern_consistency (null: no
    evidence).  Needs complexity, parameters, code_lines, access_level, effect_kinds."""
    c, p, lines = (F.col(x).cast("double") for x in ("complexity", "parameters", "code_lines"))
    zero = F.lit(0.0)
    boundary = 8 * c + 6 * p + 2 * F.greatest(zero, lines - 12)
    public = F.col("access_level").isin("open", "public", "package")
    pattern = 6 * c + 4 * p + 10 * F.col("effect_kinds") + 3 * F.greatest(zero, lines - 8)
    return (
        functions.withColumn("parameter_surface", F.when(p >= 6, F.least(F.lit(100.0), (p - 5) * 20)))
        .withColumn("public_boundary", F.when(public & (boundary >= 40), F.least(F.lit(100.0), boundary)))
        .withColumn("pattern_consistency", F.least(F.lit(100.0), pattern))
    )


def unavailable_evidence(items: DataFrame, item_id: str, kind: str, reason: str, weight: float = 1.0) -> DataFrame:
    """Explicit rows for evidence that couldn't be had."""
    return items.select(
        F.col(item_id).alias("item_id"), F.concat(F.col(item_id), F.lit(f":{kind}")).alias("id"), F.lit(kind).alias("kind"), F.lit("optional").alias("requirement"),
        F.lit("unavailable").alias("state"), F.lit(reason).alias("reason"), F.lit(weight).alias("weight"), F.lit(None).cast("double").alias("normalized_score"), F.lit(None).cast("string").alias("raw_value"),
    )


def _positive(weight: Column) -> Column:
    return F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))


def composite_scores(evidence: DataFrame, by: str | list[str] = "item_id") -> DataFrame:
    """One row for each item: value (null if undefined), base, configured and available weight,
    and the numbers of available and unavailable rows.

    Weights are renormalised over available primary evidence.  Dampeners (kinds ``coverage.*``)
    multiply the base one after another and never raise it.  Partial sums run before the
    shuffle; of an item's rows only its dampener factors are multiplied."""
    w = _positive(F.col("weight"))
    ok = F.col("state").isin(*policy.AVAILABLE_STATES) & F.col("normalized_score").isNotNull() & (w > 0)
    damp = F.col("kind").startswith(policy.DAMPENER_PREFIX)
    score = clamp(F.col("normalized_score"))
    keys = [by] if isinstance(by, str) else by
    # Products of dampeners as sums of logarithms would lose zero; product() is a built-in.
    sums = evidence.groupBy(*keys).agg(
        F.sum(w).alias("configured_weight"),
        F.coalesce(F.sum(F.when(ok & ~damp, w)), F.lit(0.0)).alias("available_weight"),
        F.sum(F.when(ok & ~damp, w * score)).alias("__weighted"),
        F.coalesce(F.product(F.when(ok & damp, score / 100)), F.lit(1.0)).alias("__factor"),
        F.count_if(~ok & (F.col("requirement") == "required")).alias("__required_missing"),
        F.count_if(ok).alias("available_count"),
        F.count_if(~ok).alias("unavailable_count"),
    )
    base = F.when(F.col("available_weight") > 0, F.col("__weighted") / F.nullif(F.col("available_weight"), F.lit(0.0)))
    value = F.when((F.col("__required_missing") == 0) & base.isNotNull(), F.greatest(F.lit(0.0), base * F.col("__factor")))
    return sums.select(*keys, value.alias("score"), base.alias("base"), "configured_weight", "available_weight", "available_count", "unavailable_count")


def contributions(evidence: DataFrame) -> DataFrame:
    """(item_id, id, effective_weight, contribution) of the available primary evidence."""
    w = _positive(F.col("weight"))
    ok = F.col("state").isin(*policy.AVAILABLE_STATES) & F.col("normalized_score").isNotNull() & (w > 0) & ~F.col("kind").startswith(policy.DAMPENER_PREFIX)
    live = evidence.filter(ok).withColumn("__w", w)
    total = live.groupBy("item_id").agg(F.sum("__w").alias("__total"))
    share = F.col("__w") / F.col("__total")
    return live.join(total, "item_id").select("item_id", "id", share.alias("effective_weight"), (share * clamp(F.col("normalized_score"))).alias("contribution"))


def priority(score: Column, preset: str = "balanced") -> Column:
    """critical, high, medium or low; null for a null score."""
    critical, high, medium = policy.PRIORITY_CUTS[preset]
    return F.when(score >= critical, "critical").when(score >= high, "high").when(score >= medium, "medium").when(score.isNotNull(), "low")


def priority_rank(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, p in enumerate(policy.PRIORITIES):
        out = F.when(name == p, F.lit(k)).otherwise(out)
    return out


def filter_items(items: DataFrame, levels: list[str] | None = None, categories: list[str] | None = None, min_score: float | None = None, min_priority: str | None = None) -> DataFrame:
    """All filters; ``items`` has level, kinds (array), score, priority.  Null fails a bound."""
    out = items
    if levels:
        out = out.filter(F.col("level").isin(*levels))
    if categories:
        any_of = F.lit(False)
        for c in categories:
            any_of = any_of | F.exists("kinds", _in_category(c))
        out = out.filter(any_of)
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    if min_priority is not None:
        out = out.filter(priority_rank(F.col("priority")) >= policy.PRIORITIES.index(min_priority))
    return out


def _in_category(category: str):
    return lambda kind: (kind == category) | kind.startswith(category + ".")


def ranked(items: DataFrame, score: str = "score", key: str = "id") -> list[Column]:
    """The order of a ranking: score from the top, null last, then the key."""
    return [F.col(score).desc_nulls_last(), F.col(key).asc()]


def limited(items: DataFrame, top: int | None = None, head: int | None = None, tail: int | None = None, score: str = "score", key: str = "id") -> DataFrame:
    """The first or the last of the ranking; ``tail`` wins, else the lesser of top and head;
    negative limits are ignored.  A top-k: no full sort."""
    if tail is not None and tail >= 0:
        return items.orderBy(F.col(score).asc_nulls_first(), F.col(key).desc()).limit(tail)
    bounds = [n for n in (top, head) if n is not None and n >= 0]
    return items.orderBy(*ranked(items, score, key)).limit(min(bounds)) if bounds else items


def explain_items(evidence: DataFrame) -> DataFrame:
    """(item_id, category, strongest_id, strongest_score): the first part of the least kind, and
    the evidence of the greatest score (of equal ones the least id)."""
    have = evidence.filter(F.col("normalized_score").isNotNull())
    top = have.groupBy("item_id").agg(F.max("normalized_score").alias("strongest_score"))
    first = have.join(top, "item_id").filter(F.col("normalized_score") == F.col("strongest_score")).groupBy("item_id").agg(F.min("id").alias("strongest_id"), F.first("strongest_score").alias("strongest_score"))
    kinds = evidence.groupBy("item_id").agg(F.substring_index(F.min("kind"), ".", 1).alias("category"))
    return kinds.join(first, "item_id", "left")


def roll_up(scored: DataFrame, evidence: DataFrame, group: str, preset: str = "balanced", threshold: float | None = None) -> DataFrame:
    """(group, score, priority, members, anchor): problematic items of each group, their pooled
    evidence scored again, and the best ranked member.  ``scored``: item_id, group, score."""
    limit = policy.PROBLEMATIC[preset] if threshold is None else threshold
    bad = scored.filter(F.col("score") >= limit).select("item_id", group, F.col("score").alias("item_score"))
    pooled = composite_scores(evidence.join(bad.select("item_id", group), "item_id"), group)
    heads = bad.groupBy(group).agg(F.count("*").alias("members"), F.min(F.struct((-F.col("item_score")).alias("s"), F.col("item_id").alias("i")))["i"].alias("anchor"))
    return pooled.join(heads, group).select(group, "score", priority(F.col("score"), preset).alias("priority"), "members", "anchor")


def priority_counts(scored: DataFrame, preset: str = "balanced") -> DataFrame:
    """(priority, items), the unscored among them."""
    return scored.groupBy(F.coalesce(priority(F.col("score"), preset), F.lit("unscored")).alias("priority")).agg(F.count("*").alias("items"))


def over_maximum(scored: DataFrame, maximum: float) -> DataFrame:
    """(violations, worst_score, worst_id): the validation gate."""
    over = scored.filter(F.col("score") > maximum)
    return over.agg(F.count("*").alias("violations"), F.min(F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))).alias("w")).select("violations", (-F.col("w.s")).alias("worst_score"), F.col("w.i").alias("worst_id"))


def search(items: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows in which any column (text, or array of texts) holds ``needle``, in either case."""
    low = needle.lower()
    kinds = dict(items.dtypes)
    hit = F.lit(False)
    for c in columns:
        one = F.exists(c, lambda x: F.lower(x).contains(low)) if kinds[c].startswith("array") else F.lower(F.col(c)).contains(low)
        hit = hit | F.coalesce(one, F.lit(False))
    return items.filter(hit)


def page(items: DataFrame, offset: int, size: int, score: str = "score", key: str = "id") -> DataFrame:
    """A page of the ranking with each row's place (1 first)."""
    first = items.orderBy(*ranked(items, score, key)).limit(offset + size)  # bounded before it is numbered
    return first.withColumn("place", F.row_number().over(Window.orderBy(*ranked(first, score, key)))).filter(F.col("place") > offset)


def next_priority(now: str | None) -> str | None:
    """The filter that follows in the cycle: none, critical, high, medium, low, none."""
    cycle = [None, *reversed(policy.PRIORITIES)]
    return cycle[(cycle.index(now) + 1) % len(cycle)]


def with_priority(items: DataFrame, wanted: str | None) -> DataFrame:
    """Items of exactly one priority, or all."""
    return items if wanted is None else items.filter(F.col("priority") == wanted)


def detail_lines(items: DataFrame) -> DataFrame:
    """(id, at, line): what an explorer shows of each item (see ``evidence.explained``)."""
    number = lambda c: F.when(c.isNotNull(), F.format_string("%.1f", c)).otherwise(F.lit("-"))
    added = F.transform("contributions", lambda c: F.concat(F.lit("- "), c["kind"], F.lit(" "), c["evidence_id"], F.lit(": raw="), F.coalesce(c["raw_value"], F.lit("")), F.lit(", normalized="), number(c["normalized_score"]), F.lit(", weight="), number(c["effective_weight"]), F.lit(", contribution="), number(c["contribution"])))
    gone = F.transform("unavailable", lambda u: F.concat(F.lit("- "), u["kind"], F.lit(" "), u["evidence_id"], F.lit(": "), u["reason"]))
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.col("display_name"), F.concat(F.lit("Priority: "), F.coalesce("priority", F.lit("unscored"))), F.concat(F.lit("Score: "), number(F.col("score"))), F.concat(F.lit("Category: "), "category"), F.concat(F.lit("Why: "), "explanation"), F.concat(F.lit("Action: "), "recommendation")),
        F.when(F.size("contributions") > 0, F.concat(F.array(F.lit("Contributions:")), added)).otherwise(none), F.when(F.size("unavailable") > 0, F.concat(F.array(F.lit("Unavailable evidence:")), gone)).otherwise(none),
    )
    return items.select("id", F.posexplode(lines).alias("at", "line"))
