"""Evidence of a whole analysis: where it comes from, which item it belongs to, how it is told.

Items: item_key (one for each declaration), item_id, display_name, level, module, file, line,
column.  Evidence: COLUMNS; evidence that isn't attached yet has no item columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from . import coverage, history, scoring

PLACE = ["module", "file", "line", "column"]
LOOSE = ["id", "kind", "requirement", "state", "reason", "weight", "normalized_score", "raw_value", "note", *PLACE]
COLUMNS = ["item_key", "item_id", *LOOSE]
SYNTAX_ONLY = "from syntax alone"


def item_key(level: str) -> Column:
    """The key of an item: declarations of equal names differ by their place."""
    if level == "callable":
        return F.concat(F.col("item_id"), F.lit("@"), F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string")))
    return F.col("item_id")


def _row(**given: Column) -> list[Column]:
    """All columns of LOOSE, those that aren't given with their usual value."""
    usual = {"requirement": F.lit("optional"), "state": F.lit("available"), "reason": F.lit(None).cast("string"), "weight": F.lit(1.0), "note": F.lit(None).cast("string")}
    return [(given.get(c, usual.get(c)) if c not in PLACE or c in given else F.col(c)).alias(c) for c in LOOSE]


def structural(items: DataFrame, rules: list[tuple[str, str, float, float]]) -> DataFrame:
    """Evidence rows of ``items`` (with the measured columns) for each rule (suffix, column,
    threshold, weight)."""
    made = F.array(*[
        F.struct(F.lit(s).alias("suffix"), F.col(c).cast("long").alias("value"), F.lit(float(w)).alias("weight"), scoring.normalised(F.col(c).cast("double"), t).alias("score"))
        for s, c, t, w in rules
    ])
    flat = items.select("item_key", "item_id", *PLACE, F.explode(made).alias("e"))
    return flat.select("item_key", "item_id", *_row(
        id=F.concat_ws(":", "item_id", "e.suffix"), kind=F.concat(F.lit(policy.KIND_PREFIX), F.col("e.suffix")), weight=F.col("e.weight"),
        normalized_score=F.col("e.score"), raw_value=F.concat(F.lit("value="), F.col("e.value").cast("string")),
    ))


def oversized(types: DataFrame) -> DataFrame:
    """The greatest of the four type scores, with the first five callables as places to split.
    ``types`` has the measured columns and ``callable_names`` (sorted)."""
    scores = [scoring.normalised(F.col(c).cast("double"), t) for _, c, t, _ in policy.TYPE_EVIDENCE]
    names = F.array_join(F.slice("callable_names", 1, 5), ", ")
    raw = F.concat_ws(";", *[F.concat(F.lit(f"{label}="), F.col(c).cast("string")) for label, c in (("lines", "code_lines"), ("methods", "method_count"), ("properties", "property_count"), ("wmcc", "wmcc"))])
    return types.select("item_key", "item_id", *_row(
        id=F.concat(F.col("item_id"), F.lit(":oversized-type")), kind=F.lit(policy.KIND_PREFIX + "oversized-type"), normalized_score=F.greatest(*scores), raw_value=raw,
        note=F.when(F.size("callable_names") > 0, F.concat(F.lit("Callables to begin with: "), names)).otherwise(F.lit("No callables to begin with")),
    ))


def _details(columns: list[str]) -> Column:
    """The column ``detail`` of a group, joined in the order of ``columns``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*columns))), lambda x: F.coalesce(x["detail"], F.lit(""))), ",")


def functional(functions: DataFrame, effects: DataFrame, compositions: DataFrame, risks: DataFrame) -> DataFrame:
    """Loose evidence of side effects, purity, composition, risks, interface and pattern.

    ``functions``: path, name, module, line, column and measured columns; the other facts name
    their function by (path, of_line, of_column).  Evidence of a function stands at the function;
    evidence of risks stands at the first risk of its group, as the facts have it."""
    home = ["path", "of_line", "of_column"]
    fn = functions.select("path", F.col("line").alias("of_line"), F.col("column").alias("of_column"), "module", "name", "complexity", "parameters", "code_lines", "access_level")
    at = {"file": F.col("path"), "line": F.col("of_line"), "column": F.col("of_column")}
    placed = ["line", "column", "detail"]
    grouped = effects.groupBy(*home, "category").agg(F.count("*").alias("n"), _details(placed).alias("details")).join(fn, home)
    weight = scoring._weight_of("category", policy.SIDE_EFFECT_WEIGHTS)
    counted = F.concat(F.lit("count="), F.col("n").cast("string"), F.lit(";details="), F.col("details"))
    out = grouped.select(*_row(
        id=F.concat_ws(":", "name", F.lit("effect"), "category"), kind=F.concat(F.lit("swift.side-effect."), F.col("category")), weight=weight,
        normalized_score=F.least(F.lit(100.0), F.col("n") * weight * 12), raw_value=counted, note=F.lit(f"Counted {SYNTAX_ONLY}"), **at,
    ))
    kinds = effects.groupBy(*home).agg(F.countDistinct("category").alias("effect_kinds"))
    composed = compositions.groupBy(*home).agg(F.count("*").alias("operations"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "column", "operation"))), lambda x: x["operation"]), ",").alias("names"), F.count_if("impure").alias("impure"))
    every = fn.join(kinds, home, "left").join(composed, home, "left").withColumn("has_effects", F.col("effect_kinds").isNotNull()).fillna(0, ["effect_kinds", "operations"])
    out = out.unionByName(every.filter(~F.col("has_effects")).select(*_row(
        id=F.concat(F.col("name"), F.lit(":purity:heuristic")), kind=F.lit("swift.purity.heuristic"), normalized_score=F.lit(0.0), raw_value=F.lit("measuredSyntaxEffects=0"), note=F.lit(f"No effect was recognised {SYNTAX_ONLY}"), **at,
    )))
    out = out.unionByName(every.filter("operations > 0").select(*_row(
        id=F.concat(F.col("name"), F.lit(":functional-composition")), kind=F.lit("swift.functional-composition"), weight=F.lit(0.5), normalized_score=F.col("impure") * 15.0,
        raw_value=F.concat(F.lit("operations="), F.col("names"), F.lit(";impureClosures="), F.col("impure").cast("string")), note=F.lit(f"Functional calls {SYNTAX_ONLY}"), **at,
    )))
    measured = scoring.api_risk(every)
    number = lambda label, c: F.concat(F.lit(f"{label}="), F.col(c).cast("string"))
    for suffix, kind, column, w, raw in (
        ("api-risk:parameter-surface", "swift.api-risk.parameter-surface", "parameter_surface", 1.25, number("parameters", "parameters")),
        ("api-risk:public-boundary-complexity", "swift.api-risk.public-boundary-complexity", "public_boundary", 1.5, F.concat_ws(";", F.concat(F.lit("access="), "access_level"), number("ccf", "complexity"), number("parameters", "parameters"), number("locf", "code_lines"))),
        ("pattern-consistency", "swift.pattern-consistency.heuristic", "pattern_consistency", 0.75, F.concat_ws(";", number("locf", "code_lines"), number("ccf", "complexity"), number("parameters", "parameters"), number("effectKinds", "effect_kinds"), number("composition", "operations"))),
    ):
        out = out.unionByName(measured.filter(F.col(column).isNotNull()).select(*_row(
            id=F.concat(F.col("name"), F.lit(f":{suffix}")), kind=F.lit(kind), weight=F.lit(w), normalized_score=F.col(column).cast("double"), raw_value=raw, note=F.lit(f"Estimated {SYNTAX_ONLY}"), **at,
        )))
    # Risks of a function, and those of a file that stand in no function.
    risk = risks.groupBy("path", "module", "of_line", "of_column", "function", "category").agg(F.count("*").alias("n"), _details(placed).alias("details"), F.min(F.struct("line", "column")).alias("first"))
    weight = scoring._weight_of("category", policy.RISK_WEIGHTS)
    kind = F.when(F.col("category") == "mutableSharedState", F.lit(policy.SHARED_STATE_KIND)).otherwise(F.concat(F.lit(policy.RISK_KIND_PREFIX), F.col("category")))
    return out.unionByName(risk.select(*_row(
        id=F.concat_ws(":", F.coalesce("function", F.concat_ws(".", "module", "path")), F.lit("swift-risk"), "category"), kind=kind, weight=weight, normalized_score=F.least(F.lit(100.0), F.col("n") * weight * 15),
        raw_value=counted, note=F.lit(f"Estimated {SYNTAX_ONLY}"), file=F.col("path"), line=F.col("first.line"), column=F.col("first.column"),
    )))


def same_place(a: DataFrame, b: DataFrame, columns: list[str] = PLACE) -> Column:
    """Null-safe equality of all place columns."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def attach(items: DataFrame, loose: DataFrame) -> DataFrame:
    """Evidence that a place decides: a callable has what stands exactly at it, a file all that
    stands anywhere in it.  Two equi-joins."""
    callables = items.filter("level = 'callable'").select("item_key", "item_id", *PLACE)
    files = items.filter("level = 'file'").select("item_key", "item_id", F.col("file").alias("__file"))
    of_callable = callables.join(loose, same_place(callables, loose)).select("item_key", "item_id", *[loose[c] for c in LOOSE])
    of_file = files.join(loose, files["__file"] == loose["file"]).select("item_key", "item_id", *[loose[c] for c in LOOSE])
    return of_callable.unionByName(of_file)


def attach_contexts(items: DataFrame, contexts: DataFrame) -> DataFrame:
    """Evidence of one-hop contexts (id, fan_in, fan_out, callers, score): by entity id.  The graph's
    callables have ids with a place and modules aren't scored, so only types meet theirs."""
    items = items.filter("level <> 'module'")
    raw = F.concat_ws(";", *[F.concat(F.lit(f"{label}="), F.col(c).cast("string")) for label, c in (("fanIn", "fan_in"), ("fanOut", "fan_out"), ("callers", "callers"))])
    rows = contexts.select(F.col("id").alias("__id"), raw.alias("__raw"), F.col("score").cast("double").alias("__score"))
    return items.join(rows, items["item_id"] == rows["__id"]).select("item_key", "item_id", *_row(
        id=F.concat(F.col("item_id"), F.lit(":dependency-context")), kind=F.lit("swift.dependency-context"), normalized_score=F.col("__score"), raw_value=F.col("__raw"), note=F.lit(f"One step of edges {SYNTAX_ONLY}"),
    ))


def coverage_evidence(items: DataFrame, entries: DataFrame | None, reason: str | None = None) -> DataFrame:
    """Loose coverage evidence, a row for each item.  ``entries``: :func:`sources.lcov.records`; a
    missing report (None) makes rows that say so with ``reason``.  Files, types and modules have the
    share of their file's covered lines; callables are covered or not."""
    lcov = {"id": F.concat(F.col("item_id"), F.lit(":coverage:lcov")), "kind": F.lit("coverage.lcov")}
    if entries is None:
        return items.select(*_row(**lcov, state=F.lit("unavailable"), reason=F.lit(reason), normalized_score=F.lit(None).cast("double"), raw_value=F.lit("unavailable"), note=F.lit("No coverage; nothing is read as zero")))
    order = entries.withColumn("record_order", F.struct("report", "record"))
    matches = coverage.match_paths(items.select(F.col("file").alias("path")).dropna(), order).select(F.col("path").alias("file"), F.col("matched").alias("source_path"), F.col("strategy").alias("by"))
    lines = coverage.line_coverage(entries, ["source_path"])
    met = items.join(matches, "file", "left")
    whole = met.filter("level <> 'callable'").join(lines, "source_path", "left")
    callables = met.filter("level = 'callable'")
    functions = coverage.match_functions(callables.filter("source_path is not null").select(F.col("item_key").alias("entity_id"), "source_path", F.col("display_name").alias("name"), "line"), entries)
    single = callables.join(functions.select(F.col("entity_id").alias("item_key"), F.col("strategy").alias("how"), "hits"), "item_key", "left")
    single = single.withColumn("covered", F.when(F.col("hits").isNotNull(), (F.col("hits") > 0).cast("long"))).withColumn("total", F.when(F.col("hits").isNotNull(), F.lit(1).cast("long")))
    both = whole.withColumn("how", F.lit("executableLine")).select("item_id", *PLACE, "source_path", "by", "how", "covered", "total").unionByName(single.select("item_id", *PLACE, "source_path", "by", "how", "covered", "total"))
    known = F.coalesce(F.col("total"), F.lit(0)) > 0
    share = F.when(known, F.col("covered") * 100.0 / F.col("total"))
    sure = F.when(~known, "unmatched").when(F.col("how").isin("startLine"), "fallback").when((F.col("how") == "executableLine") & F.col("item_id").startswith("callable:"), "fallback").when(F.col("how") == "dottedSuffix", "high").when((F.col("how") == "exactName") | (F.col("by") == "exact"), "exact").otherwise("high")
    state = F.when(F.col("source_path").isNull(), "missingFile").when(~known, "unmatchedEntity").when(F.col("covered") == 0, "zeroCoverage").otherwise("measuredCoverage")
    why = F.when(F.col("source_path").isNull(), F.concat(F.lit("No record of "), F.coalesce("file", F.lit("the item")))).when(~known, F.lit("The file's record has nothing of the item"))
    raw = F.when(known, F.format_string("covered=%d/%d;coverage=%.3f%%;confidence=%s", "covered", "total", share, sure)).otherwise(F.concat(F.lit("coverage=unavailable;confidence="), sure))
    return both.select(*_row(**lcov, state=state, reason=why, normalized_score=share, raw_value=raw, note=F.concat(F.lit("Matched by "), F.coalesce("how", "by", F.lit("nothing")))))


HISTORY = ("change-frequency", "recency", "fix-orientation", "contributor-concentration")


def history_evidence(items: DataFrame, commits: DataFrame | None, reference: str | None, reason: str = "History needs a commit table and a reference time") -> DataFrame:
    """Loose history evidence, four rows for each item; of files without commits, and where there is
    no commit table or time, rows that say so."""
    score = {"change-frequency": "frequency", "recency": "recency", "fix-orientation": "fix_share", "contributor-concentration": "top_contributor_share"}
    if commits is None or reference is None:
        met = items.withColumn("changes", F.lit(None).cast("long"))
        met = met.withColumns({c: F.lit(None).cast("double") for c in score.values()})
        why = reason
    else:
        met = items.join(history.evidence(commits, reference).withColumnRenamed("path", "file"), "file", "left")
        why = "No commit of the file is known"
    have = F.col("changes").isNotNull()
    rows = F.array(*[F.struct(F.lit(s).alias("suffix"), F.col(score[s]).cast("double").alias("score")) for s in HISTORY])
    flat = met.select("item_id", *PLACE, "changes", F.explode(rows).alias("e"))
    raw = F.when(have, F.format_string("commits=%d;value=%.3f", "changes", F.col("e.score"))).otherwise("unavailable")
    return flat.select(*_row(
        id=F.concat_ws(":", "item_id", F.lit("git-history"), "e.suffix"), kind=F.concat(F.lit("git-history."), F.col("e.suffix")), state=F.when(have, "available").otherwise("unavailable"),
        reason=F.when(~have, F.lit(why)), normalized_score=F.col("e.score"), raw_value=raw, note=F.lit("At a given time, of the file's commits"),
    ))


def entity_of(evidence_id: Column) -> Column:
    """The item that a provider's evidence id begins with."""
    at = F.locate(":coverage:", evidence_id)
    cut = F.when(at > 0, at).otherwise(F.locate(":git-history:", evidence_id))
    return F.when(cut > 0, F.substring(evidence_id, F.lit(1), cut - 1)).otherwise(evidence_id)


def merge(items: DataFrame, provided: DataFrame) -> DataFrame:
    """Provider evidence of items: by id and place, null-safe; evidence without any place belongs
    to the item of its id if there is exactly one."""
    found = provided.withColumn("__entity", entity_of(F.col("id")))
    placeless = F.lit(True)
    for c in PLACE:
        placeless = placeless & F.col(c).isNull()
    own = items.select("item_key", "item_id", *PLACE)
    exact = own.join(found, (own["item_id"] == found["__entity"]) & same_place(own, found)).select("item_key", "item_id", *[found[c] for c in LOOSE])
    single = own.groupBy("item_id").agg(F.count("*").alias("__n"), F.min("item_key").alias("item_key"), F.min(~_placed(PLACE)).alias("__placeless")).filter("__n = 1")
    free = found.filter(placeless)
    # An item that has no place itself has met its evidence above.
    loose = single.filter(~F.col("__placeless")).join(free, F.col("item_id") == F.col("__entity")).select("item_key", "item_id", *LOOSE)
    return exact.unionByName(loose)


def _placed(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNotNull()
    return out


def sort_key(e=None) -> Column:
    """A struct that sorts evidence by all its fields: nulls first, NaN before every number."""
    field = (lambda c: F.col(c)) if e is None else (lambda c: e[c])
    number = lambda c: F.when(F.isnan(c), F.lit(float("-inf"))).otherwise(c)
    parts = []
    for c in ("id", "kind", "raw_value", "note", "requirement", "state", "reason"):
        parts.append(field(c).alias(c))
    for c in ("weight", "normalized_score"):
        parts += [F.when(field(c).isNotNull(), ~F.isnan(field(c))).alias(f"{c}_number"), number(field(c)).alias(c)]
    return F.struct(*parts, *[field(c).alias(c) for c in PLACE])


def breakdown(evidence: DataFrame, by: str = "item_key") -> DataFrame:
    """(by, contributions, unavailable, kinds, category, strongest): each item's evidence in order,
    what it adds to the score, what is missing and why."""
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    ok = F.col("state").isin(*policy.AVAILABLE_STATES) & F.col("normalized_score").isNotNull() & (w > 0)
    primary = ok & ~F.col("kind").startswith(policy.DAMPENER_PREFIX)
    rows = evidence.select(by, sort_key().alias("k"), F.col("weight"), F.col("normalized_score").alias("score"), ok.alias("ok"), primary.alias("primary"), w.alias("w"))
    per = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", "weight", "score", "ok", "primary", "w"))).alias("e"), F.sum(F.when(F.col("primary"), F.col("w"))).alias("total"))
    share = lambda x: x["w"] / F.col("total")
    added = F.transform(F.filter("e", lambda x: x["primary"]), lambda x: F.struct(
        x["k"]["id"].alias("evidence_id"), x["k"]["kind"].alias("kind"), x["k"]["raw_value"].alias("raw_value"), x["score"].alias("normalized_score"), x["weight"].alias("configured_weight"),
        share(x).alias("effective_weight"), (share(x) * scoring.clamp(x["score"])).alias("contribution"),
    ))
    missing = F.transform(F.filter("e", lambda x: ~x["ok"]), lambda x: F.struct(
        x["k"]["id"].alias("evidence_id"), x["k"]["kind"].alias("kind"), x["k"]["requirement"].alias("requirement"), x["weight"].alias("configured_weight"), F.coalesce(x["k"]["reason"], F.lit("unspecified")).alias("reason"),
    ))
    kinds = F.array_sort(F.array_distinct(F.transform("e", lambda x: x["k"]["kind"])))
    best = F.array_max(F.transform("e", lambda x: F.coalesce(x["score"], F.lit(-1.0))))
    full = per.withColumn("__best", best)
    strongest = F.filter("e", lambda x: F.coalesce(x["score"], F.lit(-1.0)) == F.col("__best"))[0]["k"]
    return full.select(by, added.alias("contributions"), missing.alias("unavailable"), kinds.alias("kinds"), F.substring_index(kinds[0], ".", 1).alias("category"), F.struct(strongest["id"].alias("id"), strongest["kind"].alias("kind"), strongest["raw_value"].alias("raw_value"), strongest["note"].alias("note")).alias("strongest"))


# --- fixed values ---------------------------------------------------------------------------
NO_EVIDENCE = "No evidence was available for this debt item."
ADVICE_MISSING = "Review unavailable evidence before treating the score as complete; no unavailable provider was converted to zero risk."
ADVICE_COVERED = "Prioritize tests around this context before structural refactoring; coverage evidence can only dampen risk."
ADVICE = {
    "callable": "Reduce the dominant callable risk while preserving behavior with focused tests.",
    "type": "Split responsibilities or simplify the most complex methods in this type.",
    "file": "Inspect clustered callable and type evidence before moving code across file boundaries.",
    "module": "Review module boundaries and repeated high-risk files before broad refactoring.",
}
# --- end of fixed values --------------------------------------------------------------------


def explained(items: DataFrame, told: DataFrame, by: str = "item_key") -> DataFrame:
    """``items`` (with level) with category, explanation and recommendation from ``breakdown``."""
    joined = items.join(told, by, "left")
    text = F.concat(F.lit("Highest evidence is "), F.col("strongest.kind"), F.lit(" with raw value "), F.coalesce("strongest.raw_value", F.lit("")), F.lit(". "), F.coalesce("strongest.note", F.lit("")))
    advice = F.when(F.size("unavailable") > 0, F.lit(ADVICE_MISSING)).when(F.exists("kinds", lambda k: k.startswith(policy.DAMPENER_PREFIX)), F.lit(ADVICE_COVERED))
    for level, words in ADVICE.items():
        advice = advice.when(F.col("level") == level, F.lit(words))
    return joined.withColumn("category", F.coalesce("category", F.lit("uncategorized"))).withColumn("explanation", F.coalesce(text, F.lit(NO_EVIDENCE))).withColumn("recommendation", advice)


STRATEGIES = ("none", "file", "aggregateOnly")


def by_strategy(shown: DataFrame, scored: DataFrame, evidence: DataFrame, strategy: str, preset: str = "balanced", threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, aggregations) that a strategy gives out.  ``shown``: filtered items; ``scored``: all
    items (item_key, item_id, file, score); members of a roll-up come from all, filtered or not."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    pooled = scored.select(F.col("item_key").alias("item_id"), "file", "score").filter("file is not null and file <> ''")
    rolled = scoring.roll_up(pooled, evidence.select(F.col("item_key").alias("item_id"), "kind", "requirement", "state", "weight", "normalized_score"), "file", preset, threshold)
    ids = scored.filter(F.col("score") >= (policy.PROBLEMATIC[preset] if threshold is None else threshold)).groupBy("file").agg(F.array_sort(F.collect_list("item_id")).alias("member_item_ids"))
    rolled = rolled.join(ids, "file").withColumn("id", F.concat(F.lit("file:"), "file"))
    return (shown.limit(0) if strategy == "aggregateOnly" else shown), (rolled.limit(0) if strategy == "none" else rolled)


def summary(all_items: DataFrame, shown: DataFrame, aggregations: DataFrame) -> DataFrame:
    """One row: total_items, ranked_items, aggregations, unavailable_evidence and the numbers of
    shown items by priority (those without a score as ``unscored``).  ``shown`` has ``unavailable``."""
    ranked = shown.agg(F.count("*").alias("ranked_items"), F.coalesce(F.sum(F.size("unavailable")), F.lit(0)).cast("long").alias("unavailable_evidence"))
    counts = shown.groupBy(F.coalesce("priority", F.lit("unscored")).alias("priority")).agg(F.count("*").alias("n"))
    counts = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("priority", "n")))).alias("priority_counts"))
    out = all_items.agg(F.count("*").alias("total_items"))
    for other in (ranked, aggregations.agg(F.count("*").alias("aggregations")), counts):  # one row each
        out = out.crossJoin(F.broadcast(other))
    return out
