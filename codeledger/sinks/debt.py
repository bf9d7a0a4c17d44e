"""Ranked reports: text, compact, Markdown, DOT and the two JSON forms, as lines in order.

Items: id, display_name, level, module, file, line, column, score, priority, category,
explanation, recommendation, contributions, unavailable, kinds (see ``operators.evidence``).  Every
item is written, however many there are: lines are ordered by a range sort, not in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..operators.scoring import priority_rank
from .reports import ordered, single_line

FORMATS = ("debt-text", "debt-compact", "debt-markdown", "debt-dot", "debt-json", "debtmap-json")

# --- fixed values ---------------------------------------------------------------------------
TEXT_HEAD = "PRIORITY | SCORE | ENTITY | LOCATION | CATEGORY | ACTION"
REPORT_VERSION = 2
# --- end of fixed values --------------------------------------------------------------------


def place() -> Column:
    """file:line:column, as far as it is known."""
    known = F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"))
    return F.when(F.col("file").isNotNull(), known).otherwise(F.coalesce("module", F.lit("-")))


def score(places: int = 1) -> Column:
    return F.when(F.col("score").isNotNull(), F.format_string(f"%.{places}f", "score")).otherwise(F.lit("-"))


def native(items: DataFrame) -> DataFrame:
    """``items`` with the keys of the native order: score from the top, null last, priority, id."""
    rank = F.coalesce(priority_rank(F.col("priority")), F.lit(-1))
    return items.withColumn("__none", F.col("score").isNull()).withColumn("__score", -F.coalesce("score", F.lit(0.0))).withColumn("__rank", -rank)


ORDER = ["__none", "__score", "__rank", "id"]
_LOCATION = F.struct


def _location() -> Column:
    return F.struct("column", "file", "line", "module")


def text(items: DataFrame) -> DataFrame:
    prio = F.coalesce("priority", F.lit("unscored"))
    body = ordered(native(items), ORDER, F.concat_ws(" | ", prio, score(), single_line(F.col("display_name")), place(), "category", "recommendation"))
    return framed(body, [TEXT_HEAD])


def compact(items: DataFrame) -> DataFrame:
    prio = F.coalesce("priority", F.lit("unscored"))
    return ordered(native(items), ORDER, F.concat(prio, F.lit(" "), score(), F.lit(" "), "id", F.lit(" "), place(), F.lit(" - "), "recommendation"))


def markdown(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Sections by priority.  ``totals``: one row (ranked_items, unavailable_evidence)."""
    sections = [*reversed(policy.PRIORITIES), "unscored"]
    section = F.array_position(F.array(*map(F.lit, sections)), F.coalesce("priority", F.lit("unscored")))
    missing = F.transform("unavailable", lambda u: F.concat(F.lit("  - "), u["kind"], F.lit(" `"), u["evidence_id"], F.lit("`: "), u["reason"]))
    lines = F.concat(
        F.array(
            F.lit(""), F.concat(F.lit("### "), single_line(F.col("display_name"))), F.lit(""), F.concat(F.lit("- ID: `"), "id", F.lit("`")), F.concat(F.lit("- Location: "), place()), F.concat(F.lit("- Score: "), score()), F.concat(F.lit("- Category: "), "category"),
            F.concat(F.lit("- Evidence: "), F.size("contributions").cast("string"), F.lit(" available, "), F.size("unavailable").cast("string"), F.lit(" unavailable")), F.concat(F.lit("- Why: "), single_line(F.col("explanation"))), F.concat(F.lit("- Action: "), "recommendation"),
        ),
        F.when(F.size("unavailable") > 0, F.concat(F.array(F.lit("- Missing evidence:")), missing)).otherwise(F.array().cast("array<string>")),
    )
    body = native(items).withColumn("__section", section).select("__section", *ORDER, F.posexplode(lines).alias("__at", "line"))
    title = lambda p: "## Unscored" if p == "unscored" else f"## {p.capitalize()} priority"
    titles = F.element_at(F.array(*[F.lit(title(p)) for p in sections]), F.col("__section").cast("int"))
    heads = body.select("__section").distinct().select("__section", F.lit(False).alias("__none"), F.lit(float("-inf")).alias("__score"), F.lit(-9).alias("__rank"), F.lit("").alias("id"), F.posexplode(F.array(F.lit(""), titles)).alias("__at", "line"))
    out = ordered(heads.unionByName(body), ["__section", *ORDER, "__at"], F.col("line"))
    t = totals.first()
    return framed(out, ["# Debt report", "", f"Schema version: {REPORT_VERSION}", f"Ranked items: {t.ranked_items}", f"Unavailable evidence: {t.unavailable_evidence}"])


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes``: id, display_name; ``edges``: :func:`plans.analysis.graph_edges`."""
    esc = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    points = nodes.select(F.lit(0).alias("__kind"), F.col("id").alias("__a"), F.lit("").alias("__b"), F.concat(F.lit('  "'), esc(F.col("id")), F.lit('" [label="'), esc(F.col("display_name")), F.lit('"];')).alias("text"))
    target = F.coalesce("target", F.concat(F.lit("unresolved:"), F.col("name")), F.lit("unresolved"))
    arrows = edges.select(F.lit(1).alias("__kind"), F.col("source").alias("__a"), target.alias("__b"), F.concat(F.lit('  "'), esc(F.col("source")), F.lit('" -> "'), esc(target), F.lit('" [label="'), "kind", F.lit('"];')).alias("text"))
    return framed(ordered(points.unionByName(arrows), ["__kind", "__a", "__b", "text"], F.col("text")), ["digraph DebtGraph {", "  rankdir=LR;"], ["}"])


def graph_projection(edges: DataFrame) -> DataFrame:
    """Edges in the report's order, by all their fields."""
    keys = [F.col("source"), F.coalesce("target", F.lit("")), F.col("kind"), F.col("confidence"), F.coalesce("name", F.lit("")), F.col("file"), F.col("line"), F.col("column"), F.col("is_test")]
    return edges.orderBy(*keys)


def framed(lines: DataFrame, first: list[str], last: list[str] = ()) -> DataFrame:
    """``lines`` (ord, line) between fixed ones."""
    rows = [(-len(first) + k, x) for k, x in enumerate(first)] + [((1 << 62) + k, x) for k, x in enumerate(last)]
    return lines.unionByName(lines.sparkSession.createDataFrame(rows, "ord long, line string")) if rows else lines


def _array(rows: DataFrame, keys: list[str], value: Column, base: int) -> DataFrame:
    """(part, ord, line): JSON values as the elements of an array, a comma before all but the first."""
    body = ordered(rows, keys, F.to_json(value, {"ignoreNullFields": "true"}))
    first = body.agg(F.min("ord").alias("__first"))  # one row
    return body.crossJoin(F.broadcast(first)).select(F.lit(base).alias("part"), "ord", F.when(F.col("ord") == F.col("__first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"))


def _document(pieces: list[tuple[str, DataFrame | None]], end: str) -> DataFrame:
    """One JSON document from opening texts and the arrays behind them."""
    spark = next(d for _, d in pieces if d is not None).sparkSession
    out = spark.createDataFrame([(2 * k, 0, x) for k, (x, _) in enumerate(pieces)] + [(2 * len(pieces), 0, end)], "part int, ord long, line string")
    for k, (_, rows) in enumerate(pieces):
        if rows is not None:
            out = out.unionByName(rows.withColumn("part", F.lit(2 * k + 1)))
    return ordered(out, ["part", "ord"], F.col("line"))


def missing_evidence(items: DataFrame) -> DataFrame:
    """(item_id, evidence_id, kind, requirement, configured_weight, reason) of all items."""
    return items.select(F.col("id").alias("item_id"), F.explode("unavailable").alias("u")).select("item_id", "u.evidence_id", "u.kind", "u.requirement", "u.configured_weight", "u.reason")


def _missing(items: DataFrame) -> DataFrame:
    value = F.struct(F.col("configured_weight").alias("configuredWeight"), F.col("evidence_id").alias("evidenceID"), F.col("item_id").alias("itemID"), "kind", "reason", "requirement")
    return _array(missing_evidence(items), ["item_id", "evidence_id", "kind"], value, 0)


def native_json(items: DataFrame, aggregations: DataFrame, totals: DataFrame) -> DataFrame:
    """The native report: items, roll-ups, compact items, missing evidence and totals."""
    renamed = lambda c, names: F.transform(c, lambda x: F.struct(*[x[a].alias(b) for a, b in names]))
    added = renamed("contributions", (("configured_weight", "configuredWeight"), ("contribution", "contribution"), ("effective_weight", "effectiveWeight"), ("evidence_id", "evidenceID"), ("kind", "kind"), ("normalized_score", "normalizedScore"), ("raw_value", "rawValue")))
    gone = renamed("unavailable", (("configured_weight", "configuredWeight"), ("evidence_id", "evidenceID"), ("kind", "kind"), ("reason", "reason"), ("requirement", "requirement")))
    whole = F.struct("category", F.col("display_name").alias("displayName"), "explanation", "id", "level", _location().alias("location"), "priority", "recommendation", "score", F.struct(added.alias("contributions"), gone.alias("unavailableEvidence")).alias("scoreBreakdown"))
    rows = native(items)
    brief = F.struct(F.col("display_name").alias("displayName"), "id", "level", _location().alias("location"), "priority", "score")
    rolled = F.struct(F.col("file").alias("displayName"), "id", F.lit("file").alias("level"), F.struct("file").alias("location"), F.col("member_item_ids").alias("memberItemIDs"), "priority", "score")
    t = totals.first()
    counts = ",".join(f'"{k}":{v}' for k, v in sorted((t.priority_counts or {}).items()))
    summary = f'"summary":{{"aggregationCount":{t.aggregations},"priorityCounts":{{{counts}}},"rankedItemCount":{t.ranked_items},"totalItemCount":{t.total_items},"unavailableEvidenceCount":{t.unavailable_evidence}}}'
    return _document([
        ('{"aggregations":[', _array(aggregations, ["id"], rolled, 0)), ('],"compactItems":[', _array(rows, ORDER, brief, 0)), ('],"items":[', _array(rows, ORDER, whole, 0)),
        ('],"missingEvidence":[', _missing(items)), (f'],"reportKind":"debt","schemaVersion":{REPORT_VERSION},{summary}', None),
    ], "}")


def projection_json(items: DataFrame) -> DataFrame:
    """The compatibility projection: what other tools read of an item."""
    value = F.struct(F.col("recommendation").alias("action"), F.col("display_name").alias("entity"), F.array_sort(F.array_distinct("kinds")).alias("evidenceKinds"), "id", "level", _location().alias("location"), "priority", "score")
    return _document([('{"items":[', _array(native(items), ORDER, value, 0)), ('],"missingEvidence":[', _missing(items)), ('],"projection":"debtmap","schemaVersion":1', None)], "}")


def render(done, kind: str, edges: DataFrame | None = None) -> DataFrame:
    """(ord, line) of a finished analysis (:class:`plans.analysis.Analysis`) in one of FORMATS."""
    if kind == "debt-text":
        return text(done.items)
    if kind == "debt-compact":
        return compact(done.items)
    if kind == "debt-markdown":
        return markdown(done.items, done.totals)
    if kind == "debt-json":
        return native_json(done.items, done.aggregations, done.totals)
    if kind == "debtmap-json":
        return projection_json(done.items)
    if kind == "debt-dot" and edges is not None:
        ends = edges.select(F.explode(F.filter(F.array("source", "target"), lambda x: x.isNotNull())).alias("id")).distinct()
        return dot(ends.withColumn("display_name", F.regexp_replace("id", "^[a-z]+:", "")), edges)
    raise ValueError(f"unknown format {kind!r}")
