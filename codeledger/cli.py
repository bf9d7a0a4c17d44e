"""Command line: ``python -m codeledger.cli VERB ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import compare, coverage, evidence, history, lifecycle, scoring
from .sinks import debt, metrics
from .sinks import reports as sink
from .sources import files, lcov, reports


def _session() -> SparkSession:
    return SparkSession.builder.appName("codeledger").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(lines, out: str | None) -> None:
    """All lines, to a file or to the console a part at a time."""
    if out:
        sink.write_text(lines, out)
    else:
        for r in lines.orderBy("ord").toLocalIterator():
            print(r.line)


def _config(path: str | None) -> files.WorkspaceConfiguration:
    if not path:
        return files.WorkspaceConfiguration()
    return files.WorkspaceConfiguration.parse(_session().read.text(path, wholetext=True).first()[0])


def _sources(a: argparse.Namespace, config: files.WorkspaceConfiguration):
    spark = _session()
    return files.scan_manifest(spark, a.path) if a.manifest else files.scan_directory(spark, a.path, excludes=config.excludes + (a.exclude or []), maximum=config.maximum_file_bytes)


def _analysis(a: argparse.Namespace):
    """The analysis of a path with whatever coverage and history it is given."""
    from .plans import analysis

    spark, config = _session(), _config(a.config)
    if getattr(a, "aggregation", None):
        config.aggregation = a.aggregation
    entries, unreadable = None, None
    if a.lcov:
        try:
            entries = lcov.records(lcov.read(spark, a.lcov))
            entries.limit(1).collect()
        except Exception as e:
            entries, unreadable = None, f"LCOV unavailable: {type(e).__name__}"
    commits = None
    if a.history:
        raw = spark.read.schema("path string, log string").json(a.history)
        commits = history.parse_log(raw, "path", "log")
    return analysis.analyze(_sources(a, config), config, entries, commits, a.reference_time or config.reference_time, unreadable), config


def analyze(a: argparse.Namespace) -> int:
    from .plans import analysis

    done, config = _analysis(a)
    kept = scoring.filter_items(done.items, a.level, a.category, a.min_score, a.min_priority)
    done.items = scoring.limited(kept, a.top, None, a.tail)
    if a.format in debt.FORMATS:
        done.totals = evidence.summary(kept, done.items, done.aggregations)
        lines = debt.render(done, a.format, analysis.graph_edges(done.facts) if a.format == "debt-dot" else None)
    elif a.format == "metrics-csv":
        lines = metrics.csv(done.observations, done.summary)
    elif a.format == "metrics-json":
        lines = metrics.json(done.observations, done.summary, done.findings)
    elif a.format == "metrics-html":
        lines = metrics.html(done.observations, done.summary)
    elif a.format == "metrics-text":
        lines = metrics.text(done.summary, done.findings, done.diagnostics, [f"codeledger - {'complete' if done.complete else 'INCOMPLETE'}"])
    elif a.format == "dashboard":
        lines = sink.dashboard_lines(done.items.drop("contributions", "unavailable", "strongest"), a.path, analysis.graph_edges(done.facts).select("source", "target", "name", "kind"))
    elif a.format == "diagnostics":
        lines = metrics.diagnostics(done.findings, done.diagnostics, a.path)
    else:
        lines = sink.render(done.items, a.format)
    _show(lines, a.output)
    if a.lifecycle_artifact:
        from .plans import lifecycle_store

        taken = lifecycle_store.snapshot_of(done, _sources(a, config), a.revision, tuple(a.parent or ()), not a.dirty, "partial" if a.manifest or a.exclude or a.partial else "repository")
        outcome, events = lifecycle_store.LifecycleStore(_session(), a.lifecycle_artifact).record(taken)
        counts = {r.kind: r["count"] for r in events.groupBy("kind").count().collect()}
        print(f"{taken.id} {outcome} " + " ".join(f"{k}={n}" for k, n in sorted(counts.items())))
    if not done.complete:
        return 2
    return _over(done, a.max_score)


def _over(done, maximum: float | None) -> int:
    if maximum is None:
        return 0
    return int(bool(scoring.over_maximum(done.items.withColumnRenamed("id", "item_id"), maximum).first().violations))


def validate(a: argparse.Namespace) -> int:
    """Whether no item scores above the maximum."""
    done, config = _analysis(a)
    limit = a.max_score if a.max_score is not None else config.max_score
    if limit is None:
        raise ValueError("a maximum score is needed, as an option or in the configuration")
    row = scoring.over_maximum(done.items.withColumnRenamed("id", "item_id"), limit).first()
    print(f"violations={row.violations} worst={row.worst_id or '-'}")
    return 2 if not done.complete else int(bool(row.violations))


def explain_coverage(a: argparse.Namespace) -> int:
    """How each item was matched with the coverage report, and what matched nothing."""
    done, _ = _analysis(a)
    rows = done.evidence.filter("kind = 'coverage.lcov'").select(F.col("item_id").alias("entity_id"), F.col("file").alias("path"), F.when(F.col("state") != "missingFile", F.col("file")).alias("matched"), F.col("note").alias("strategy"))
    _show(sink.ordered(rows.withColumn("__entity", F.col("entity_id")), ["__entity", "path"], coverage.diagnostic_line()), a.output)
    return 0


def _compared(a: argparse.Namespace):
    spark = _session()
    before, after = (reports.report_items(spark, p) for p in (a.before, a.after))
    return compare.compare_items(before, after, sets=("evidence_ids", "unavailable_evidence_ids"))


def compare_reports(a: argparse.Namespace) -> int:
    """What changed between two reports: items, then aggregations."""
    compare.comparison_summary(_compared(a)).show(truncate=False)
    spark = _session()
    before, after = (reports.report_aggregations(spark, p) for p in (a.before, a.after))
    compare.comparison_summary(compare.compare_items(before, after, sets=("member_item_ids",))).show(truncate=False)
    return 0


def validate_improvement(a: argparse.Namespace) -> int:
    row = compare.validate_improvement(compare.comparison_summary(_compared(a)), a.minimum).first()
    print(row)
    return row.exit_status


def performance_gate(a: argparse.Namespace) -> int:
    spark = _session()
    sides = [reports.benchmark(spark, p).select(*[F.col(c).alias(f"{side}_{c}") for c in (*compare.WORKLOAD, "pair_id", "wall_s", "peak_bytes")]) for side, p in (("base", a.baseline), ("new", a.candidate))]
    row = compare.performance_gate(sides[0].crossJoin(sides[1])).first()  # one row each
    print(row.comparable, row.passed, list(row.reasons))
    return 0 if row.passed else 2 if not row.comparable else 1


def _events(spark: SparkSession, path: str):
    """Events of an artifact with the depth of their snapshot."""
    tables = reports.artifact(spark, path)
    snaps = tables["snapshots"]
    edges = snaps.filter("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    depth = lifecycle.ancestors(edges, snaps.select("id")).groupBy("id").agg(F.max("distance").alias("position"))
    return tables, tables["events"].join(depth.withColumnRenamed("id", "snapshot_id"), "snapshot_id")


def lifecycle_inventory(a: argparse.Namespace) -> int:
    _, events = _events(_session(), a.artifact)
    rows = lifecycle.current_state(events)
    _show(sink.ordered(rows, ["finding"], F.format_string("%s %s last=%s events=%d", "finding", "state", "last_kind", "events")), a.output)
    return 0


def lifecycle_explain(a: argparse.Namespace) -> int:
    """All events of one finding, in order."""
    _, events = _events(_session(), a.artifact)
    rows = events.filter(F.col("finding") == a.finding)
    _show(sink.ordered(rows, ["position", "event_id"], F.format_string("%s %s %s", "snapshot_id", "kind", "event_id")), a.output)
    return 0 if not rows.isEmpty() else 1


def lifecycle_snapshot(a: argparse.Namespace) -> int:
    """What one snapshot detected."""
    tables = reports.artifact(_session(), a.artifact)
    rows = tables["detections"].filter(F.col("snapshot_id") == a.snapshot)
    _show(sink.ordered(rows, ["source", "line", "column", "rule"], F.format_string("%s:%d:%d: %s %s", "source", "line", "column", "rule", "id")), a.output)
    return 0


def lifecycle_export(a: argparse.Namespace) -> int:
    """Snapshots, events and detections as JSON lines, each with its kind."""
    tables = reports.artifact(_session(), a.artifact)
    out = None
    for kind, df in tables.items():
        rows = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    _show(sink.ordered(out, ["kind", "text"], F.col("text")), a.output)
    return 0


def infer_introduction(a: argparse.Namespace) -> int:
    """Where a finding, or each that is open, came in."""
    from .plans import lifecycle_store

    rows = lifecycle_store.LifecycleStore(_session(), a.artifact).introductions(a.finding)
    _show(sink.ordered(rows, ["finding", "start"], F.format_string("%s %s %s steps=%d %s", "finding", "kind", "revision", "steps", F.array_join("reasons", ","))), a.output)
    return 0 if not rows.isEmpty() else 1


def lifecycle_inspect(a: argparse.Namespace) -> int:
    """What became of each detection of one snapshot of a recorded history."""
    from .plans import lifecycle_store

    rows = lifecycle_store.LifecycleStore(_session(), a.artifact).inspect(a.snapshot)
    _show(sink.ordered(rows, ["source", "line", "column", "rule"], F.format_string("%s:%d:%d: %s %s %s", "source", "line", "column", "rule", F.coalesce("kind", F.lit("-")), F.coalesce("finding", F.lit("-")))), a.output)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeledger")
    verbs = p.add_subparsers(required=True)
    for name, run in (("analyze", analyze), ("validate", validate), ("explain-coverage", explain_coverage)):
        v = verbs.add_parser(name)
        v.add_argument("path")
        v.add_argument("--manifest", action="store_true")
        v.add_argument("--config")
        v.add_argument("--exclude", action="append")
        v.add_argument("--lcov", help="coverage report")
        v.add_argument("--history", help="JSON lines of path and its commit log")
        v.add_argument("--reference-time")
        v.add_argument("--output")
        v.add_argument("--max-score", type=float)
        v.set_defaults(run=run)
        if name == "analyze":
            v.add_argument("--format", choices=(*sink.FORMATS, *debt.FORMATS, *metrics.FORMATS, "dashboard"), default="text")
            v.add_argument("--aggregation", choices=evidence.STRATEGIES)
            v.add_argument("--level", action="append")
            v.add_argument("--category", action="append")
            v.add_argument("--min-score", type=float)
            v.add_argument("--min-priority")
            v.add_argument("--top", type=int)
            v.add_argument("--tail", type=int)
            v.add_argument("--lifecycle-artifact", help="history to record this analysis in")
            v.add_argument("--revision")
            v.add_argument("--parent", action="append", help="revision before this one")
            v.add_argument("--dirty", action="store_true", help="the tree has changes that no revision holds")
            v.add_argument("--partial", action="store_true", help="not all sources of the repository are analysed")
    for name, run in (("compare", compare_reports), ("validate-improvement", validate_improvement)):
        v = verbs.add_parser(name)
        v.add_argument("before")
        v.add_argument("after")
        v.add_argument("--minimum", type=float, default=0.0)
        v.set_defaults(run=run)
    v = verbs.add_parser("performance-gate")
    v.add_argument("baseline")
    v.add_argument("candidate")
    v.set_defaults(run=performance_gate)
    for name, run, more in (("lifecycle-inventory", lifecycle_inventory, None), ("lifecycle-export", lifecycle_export, None), ("lifecycle-explain", lifecycle_explain, "finding"), ("lifecycle-snapshot", lifecycle_snapshot, "snapshot")):
        v = verbs.add_parser(name)
        v.add_argument("artifact")
        if more:
            v.add_argument(more)
        v.add_argument("--output")
        v.set_defaults(run=run)
    v = verbs.add_parser("lifecycle-infer-introduction")
    v.add_argument("artifact")
    v.add_argument("--finding")
    v.add_argument("--output")
    v.set_defaults(run=infer_introduction)
    v = verbs.add_parser("lifecycle-inspect")
    v.add_argument("artifact")
    v.add_argument("snapshot")
    v.add_argument("--output")
    v.set_defaults(run=lifecycle_inspect)
    a = p.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
