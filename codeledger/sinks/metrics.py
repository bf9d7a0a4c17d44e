"""Metric reports: text, JSON, CSV, HTML and diagnostics, as lines in order.

Observations: metric, entity, file, line, column, value; summaries: ``operators.metrics.summary``
with a score.  All observations are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from .debt import _array, _document, framed
from .reports import csv_cell, html_text, ordered, single_line

FORMATS = ("metrics-text", "metrics-json", "metrics-csv", "metrics-html", "diagnostics")

# --- fixed values ---------------------------------------------------------------------------
CSV_HEAD = "metric,entity,file,line,column,value,threshold,violation,score"
TEXT_HEAD = "METRIC  ENTITIES  MAX  TOTAL  LIMIT(>)  VIOLATIONS  SCORE"
# --- end of fixed values --------------------------------------------------------------------

_PLACE = ["file", "line", "column", "entity"]


def _rank() -> Column:
    return F.array_position(F.array(*map(F.lit, policy.METRICS)), F.col("metric"))


def number(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.4f", c)).otherwise(F.lit("N/A"))


def _or(c: str, other: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(other))


def csv(observations: DataFrame, summary: DataFrame) -> DataFrame:
    """A row for each observation, in the order of the metrics and of the places."""
    limits = F.broadcast(summary.select("metric", "threshold", "score"))  # ten rows
    rows = observations.join(limits, "metric").withColumn("__rank", _rank())
    over = F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)).cast("string")
    line = F.concat_ws(",", "metric", csv_cell(F.col("entity")), csv_cell(F.col("file")), F.col("line").cast("string"), F.col("column").cast("string"), F.col("value").cast("string"), _or("threshold", ""), over, F.when(F.col("score").isNotNull(), number(F.col("score"))).otherwise(""))
    return framed(ordered(rows, ["__rank", *_PLACE], line), [CSV_HEAD])


def text(summary: DataFrame, findings: DataFrame, diagnostics: DataFrame, head: list[str], overall: Column | None = None) -> DataFrame:
    """The table of metrics, then diagnostics and findings."""
    table = summary.select(F.lit(0).alias("__part"), _rank().cast("long").alias("__a"), *[F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("line", "long"), ("column", "long"), ("entity", "string"))], F.concat_ws("  ", "metric", F.col("observations").cast("string"), _or("maximum", "N/A"), F.col("total").cast("string"), _or("threshold", "N/A"), F.col("violations").cast("string"), number(F.col("score"))).alias("text"))
    n = len(policy.METRICS)
    mean = summary.agg(F.when(F.count("score") == n, F.sum("score") / n).alias("o"))
    total = mean.select(F.lit(1).alias("__part"), F.lit(0).cast("long").alias("__a"), *[F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("line", "long"), ("column", "long"), ("entity", "string"))], F.concat(F.lit("Overall score: "), number(F.col("o"))).alias("text"))
    said = diagnostics.select(F.lit(2).alias("__part"), F.lit(0).cast("long").alias("__a"), F.col("path").alias("file"), "line", "column", F.col("message").alias("entity"), F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "severity", F.lit(": "), single_line(F.col("message"))).alias("text"))
    found = findings.select(F.lit(3).alias("__part"), _rank().cast("long").alias("__a"), *["file", "line", "column", "entity"], F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "metric", F.lit(" "), F.col("value").cast("string"), F.lit(" > "), F.col("threshold").cast("string"), F.lit(" - "), "entity").alias("text"))
    rows = table.unionByName(total).unionByName(said).unionByName(found)
    return framed(ordered(rows, ["__part", "__a", *_PLACE], F.col("text")), [*head, TEXT_HEAD])


def diagnostics(found: DataFrame, said: DataFrame, root: str = "") -> DataFrame:
    """One line for each diagnostic, then one for each finding, as editors read them."""
    name = lambda c: F.when(F.col(c).startswith("/"), single_line(F.col(c))).otherwise(F.concat(F.lit(root.rstrip("/") + "/" if root else ""), single_line(F.col(c))))
    at = lambda c: F.concat(name(c), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"))
    a = said.select(F.lit(0).alias("__part"), F.col("path").alias("file"), "line", "column", F.concat(at("path"), F.lit(": "), "severity", F.lit(": "), single_line(F.col("message"))).alias("text"))
    b = found.select(F.lit(1).alias("__part"), "file", "line", "column", F.concat(at("file"), F.lit(": warning: ["), "metric", F.lit("] "), single_line(F.col("entity")), F.lit(": "), F.col("value").cast("string"), F.lit(" exceeds "), F.col("threshold").cast("string")).alias("text"))
    return ordered(a.unionByName(b), ["__part", "file", "line", "column", "text"], F.col("text"))


def html(observations: DataFrame, summary: DataFrame) -> DataFrame:
    """A page without scripts: the table of metrics, and all observations under their metric."""
    cell = lambda c: F.concat(F.lit("<td>"), html_text(c), F.lit("</td>"))
    top = summary.select(F.lit(0).alias("__part"), _rank().alias("__a"), F.lit(0).alias("__b"), *[F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("line", "long"), ("column", "long"), ("entity", "string"))], F.concat(F.lit("<tr>"), *[cell(x) for x in (F.col("metric"), F.col("observations"), _or("maximum", "-"), F.col("total"), _or("threshold", "-"), F.col("violations"), number(F.col("score")))], F.lit("</tr>")).alias("text"))
    opening = summary.select(F.lit(1).alias("__part"), _rank().alias("__a"), F.lit(0).alias("__b"), *[F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("line", "long"), ("column", "long"), ("entity", "string"))], F.concat(F.when(F.col("metric") == policy.METRICS[0], F.lit("</tbody></table>")).otherwise(F.lit("</tbody></table></details>")), F.lit("<details><summary>"), "metric", F.lit("</summary><table><tbody>")).alias("text"))
    rows = observations.select(F.lit(1).alias("__part"), _rank().alias("__a"), F.lit(1).alias("__b"), "file", "line", "column", "entity", F.concat(F.lit("<tr>"), cell(F.col("entity")), cell(F.concat_ws(":", "file", F.col("line").cast("string"))), cell(F.col("value")), F.lit("</tr>")).alias("text"))
    body = ordered(top.unionByName(opening).unionByName(rows), ["__part", "__a", "__b", *_PLACE], F.col("text"))
    return framed(body, ['<!doctype html><meta charset="utf-8"><title>Metrics</title><table><thead><tr><th>ID</th><th>Entities</th><th>Maximum</th><th>Total</th><th>Limit</th><th>Violations</th><th>Score</th></tr></thead><tbody>'], ["</tbody></table></details>"])


def json(observations: DataFrame, summary: DataFrame, findings: DataFrame) -> DataFrame:
    """One document: summaries, findings and observations."""
    where = F.struct("column", "file", "line").alias("location")
    return _document([
        ('{"findings":[', _array(findings.withColumn("__rank", _rank()), ["__rank", *_PLACE], F.struct("entity", where, "metric", "threshold", "value"), 0)),
        ('],"metrics":[', _array(summary.withColumn("__rank", _rank()), ["__rank"], F.struct("maximum", "metric", F.col("observations").alias("observationCount"), "score", "threshold", "total", "violations"), 0)),
        ('],"observations":[', _array(observations.withColumn("__rank", _rank()), ["__rank", *_PLACE], F.struct("entity", where, "metric", "value"), 0)), ('],"schemaVersion":2', None),
    ], "}")


def rule_text(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule observations: a head for each rule, then its sources' detections or why there are none.
    ``results``: rule, source, outcome, line, column, message; ``rules``: rule, revision, name,
    severity."""
    head = rules.select("rule", F.lit("").alias("source"), F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("column"), F.concat(F.lit("Rule: "), "rule", F.lit("@"), F.col("revision").cast("string"), F.lit(" | "), single_line(F.col("name")), F.lit(" | default severity: "), "severity").alias("text"))
    at = F.concat("source", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"))
    said = F.when((F.col("outcome") == "committed") & F.col("line").isNotNull(), F.concat(at, F.lit(": ["), "rule", F.lit("] "), single_line(F.col("message")))).when(F.col("outcome") != "committed", F.concat("source", F.lit(": "), "outcome", F.lit(": "), single_line(F.coalesce("message", F.lit("")))))
    body = results.withColumn("text", said).filter("text is not null").select("rule", "source", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("column", F.lit(0)).alias("column"), "text")
    lines = ordered(head.unionByName(body), ["rule", "source", "line", "column", "text"], F.col("text"))
    t = results.agg(F.count_distinct("rule", "source").alias("runs"), F.count_distinct(F.when(F.col("outcome") == "committed", F.struct("rule", "source"))).alias("committed"), F.count("line").alias("detections")).first()
    done = t.runs == t.committed
    last = [] if t.detections else ["No detections in committed rule executions." if done else "Absence was not established for incomplete rule executions."]
    return framed(lines, ["RULE OBSERVATIONS", f"Status: {'complete' if done else 'INCOMPLETE'} | committed executions: {t.committed}/{t.runs} | detections: {t.detections}"], last)


def repository_text(groups: DataFrame, rule: str, complete: bool, issues: list[str]) -> DataFrame:
    """Repository evidence of one rule: ``groups`` (summary, units), and what is incomplete."""
    lines = F.concat(F.array(F.concat(F.lit(f"[{rule}] "), single_line(F.col("summary"))), F.lit("  Compared units:")), F.transform("units", lambda u: F.concat(F.lit("    - "), single_line(u))))
    body = groups.select("summary", F.posexplode(lines).alias("__at", "text"))
    none = groups.isEmpty()
    head = ["REPOSITORY EVIDENCE", f"Rule: {rule} | outcome: {'complete' if complete else 'INCOMPLETE'}", *[f"  Incomplete [{x}]" for x in issues]]
    last = (["  No detections in what the rule observes."] if complete else ["  Absence was not established for this incomplete outcome."]) if none else []
    return framed(ordered(body, ["summary", "__at"], F.col("text")), head, last)
