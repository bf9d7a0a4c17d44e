"""Reports and command line over a small tree with coverage and history."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codeledger.cli import main
from codeledger.operators import evidence
from codeledger.plans import analysis
from codeledger.sinks import debt, metrics
from codeledger.sinks import reports as sink
from codeledger.sources import files, lcov

SOURCES = [
    ("A.swift", "M", "class A {\n  var x = 1\n  func run(a: Int) {\n    if a > 1 { x = 2 }\n    helper(a)\n  }\n  func helper(_ v: Int) { }\n}\nstruct Z { let a: A }"),
    ("B.swift", "M", "public func wide(a: Int, b: Int, c: Int, d: Int, e: Int, f: Int, g: Int) {\n  a.map { x in x }\n}\nfunc same() { }"),
    ("C.swift", "N", "func same() { }"),
]
REPORT = "SF:/root/A.swift\nFN:3,M.A.run(a:)\nFNDA:4,M.A.run(a:)\nDA:3,4\nDA:4,0\nend_of_record\n"


@pytest.fixture(scope="module")
def done(spark):
    entries = lcov.records(lcov.lines_of(spark.createDataFrame([("r", REPORT)], "k string, t string"), "k", "t"))
    commits = spark.createDataFrame([("A.swift", "1", "x", "Fix it"), ("A.swift", "2", "y", "prefix")], "path string, sha string, author_token string, subject string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return analysis.analyze(files.in_memory(spark, SOURCES), files.WorkspaceConfiguration(minimum_duplicate_lines=3), entries, commits, "2024-01-31 00:00:00")


def lines(df):
    return [r.line for r in df.orderBy("ord").collect()]


def test_evidence_reaches_its_items(done):
    rows = done.evidence.collect()
    of = lambda item: {r.kind: r for r in rows if r.item_id == item}
    run, a, wide = of("callable:M.A.run(a:)"), of("file:A.swift"), of("callable:M.wide(a:b:c:d:e:f:g:)")
    assert run["swift.side-effect.mutation"].weight == 1.0 and run["coverage.lcov"].normalized_score == 100.0
    assert a["coverage.lcov"].normalized_score == 50.0 and a["git-history.change-frequency"].normalized_score == 40.0 and a["git-history.recency"].normalized_score == 50.0
    assert a["swift.file-type-count"].raw_value == "value=2" and "swift.side-effect.mutation" in a  # a file has all that stands in it
    assert wide["swift.api-risk.parameter-surface"].normalized_score == 40.0 and wide["swift.purity.heuristic"].normalized_score == 0.0 and "swift.api-risk.public-boundary-complexity" in wide
    assert wide["coverage.lcov"].state == "missingFile" and wide["git-history.recency"].state == "unavailable"
    assert of("type:M.A")["swift.dependency-context"].raw_value.startswith("fanIn=1;") and not any(r.kind == "swift.dependency-context" for r in rows if r.item_id.startswith("callable:"))
    items = {r["id"]: r for r in done.items.collect()}
    assert len([r for r in done.items.collect() if r.display_name.endswith(".same()")]) == 2
    assert items["callable:M.A.run(a:)"].recommendation == evidence.ADVICE_COVERED and items["file:B.swift"].recommendation == evidence.ADVICE_MISSING
    t = done.totals.first()
    assert t.total_items == t.ranked_items == len(items) and sum(t.priority_counts.values()) == t.total_items


def test_debt_formats(spark, done):
    whole = json.loads("".join(lines(debt.render(done, "debt-json"))))
    n = done.items.count()
    assert len(whole["items"]) == len(whole["compactItems"]) == n == whole["summary"]["totalItemCount"] and whole["schemaVersion"] == 2
    scores = [i.get("score") for i in whole["items"]]
    assert scores == sorted(scores, key=lambda x: (x is None, -(x or 0)))
    one = next(i for i in whole["items"] if i["id"] == "callable:M.A.run(a:)")
    assert sum(c["effectiveWeight"] for c in one["scoreBreakdown"]["contributions"]) == pytest.approx(1)
    slim = json.loads("".join(lines(debt.render(done, "debtmap-json"))))
    assert [i["id"] for i in slim["items"]] == [i["id"] for i in whole["items"]] and all(i["evidenceKinds"] == sorted(set(i["evidenceKinds"])) for i in slim["items"])
    assert {m["itemID"] for m in slim["missingEvidence"]} >= {"file:B.swift"} and len(slim["missingEvidence"]) == done.totals.first().unavailable_evidence
    text = lines(debt.render(done, "debt-text"))
    assert text[0] == debt.TEXT_HEAD and len(text) == n + 1
    assert len(lines(debt.render(done, "debt-compact"))) == n
    marks = lines(debt.render(done, "debt-markdown"))
    assert sum(x.startswith("### ") for x in marks) == n and [x for x in marks if x.startswith("## ")] == sorted((x for x in marks if x.startswith("## ")), key=["## Critical priority", "## High priority", "## Medium priority", "## Low priority", "## Unscored"].index)
    dot = lines(debt.render(done, "debt-dot", analysis.graph_edges(done.facts)))
    assert dot[0].startswith("digraph") and dot[-1] == "}" and any("M.A.helper" in x and "->" in x for x in dot)
    none = debt.native_json(done.items.limit(0), done.aggregations.limit(0), evidence.summary(done.items.limit(0), done.items.limit(0), done.aggregations.limit(0)))
    assert json.loads("".join(lines(none)))["items"] == []


def test_dashboard(spark, done):
    changes = spark.createDataFrame([("a</script>", "added", None), ("b", "changed", -1.5)], "id string, status string, score_delta double")
    page = lines(sink.dashboard_lines(done.items.drop("contributions", "unavailable", "strongest"), "T<", analysis.graph_edges(done.facts).select("source", "target", "name", "kind"), changes))
    whole = "\n".join(page)
    assert whole.count("</script>") == 4 and "T&lt;" in page[0]
    parts = [p.split("</script>")[0] for p in whole.split("type='application/json'>")[1:]]
    items, edges, changed = map(json.loads, parts)
    assert len(items) == done.items.count() and len(changed) == 2 and any(e["kind"] == "call" for e in edges)
    assert json.loads("".join(sink.dashboard(done.items.select("id", "display_name", "file", "score", "priority"), limit=1).split("type='application/json'>")[1].split("</script>")[0]))[0]["id"] == items[0]["id"]


def test_metric_formats(done):
    rows = lines(metrics.csv(done.observations, done.summary))
    assert rows[0] == metrics.CSV_HEAD and len(rows) == done.observations.count() + 1 and rows[1].startswith('LOCC,"M.A","A.swift",1,1,')
    whole = json.loads("".join(lines(metrics.json(done.observations, done.summary, done.findings))))
    assert len(whole["metrics"]) == 10 and len(whole["observations"]) == done.observations.count()
    page = "".join(lines(metrics.html(done.observations, done.summary)))
    assert page.count("<details>") == page.count("</details>") == 10
    text = lines(metrics.text(done.summary, done.findings, done.diagnostics, ["head"]))
    assert text[1] == metrics.TEXT_HEAD and any(x.startswith("Overall score: ") for x in text)
    assert metrics.diagnostics(done.findings, done.diagnostics).count() == done.findings.count() + done.diagnostics.count()


def test_rule_and_repository_texts(spark):
    results = spark.createDataFrame([("r", "a", "committed", 3, 1, "bad\nthing"), ("r", "b", "parseFailed", None, None, "oops"), ("s", "a", "committed", None, None, None)], "rule string, source string, outcome string, line long, column long, message string")
    rules = spark.createDataFrame([("r", 1, "R", "warning"), ("s", 2, "S", "info")], "rule string, revision int, name string, severity string")
    got = lines(metrics.rule_text(results, rules))
    assert got == ["RULE OBSERVATIONS", "Status: INCOMPLETE | committed executions: 2/3 | detections: 1", "Rule: r@1 | R | default severity: warning", "a:3:1: [r] bad thing", "b: parseFailed: oops", "Rule: s@2 | S | default severity: info"]
    groups = spark.createDataFrame([("x, y, z", ["u1", "u2"])], "summary string, units array<string>")
    assert lines(metrics.repository_text(groups, "clumps", True, []))[2:] == ["[clumps] x, y, z", "  Compared units:", "    - u1", "    - u2"]
    assert lines(metrics.repository_text(groups.limit(0), "clumps", False, ["budget"]))[-1].startswith("  Absence")


def test_verbs(spark, tmp_path, capsys):
    src = tmp_path / "it's"
    src.mkdir()
    for path, _, text in SOURCES[:2]:
        (src / path).write_text(text)
    (tmp_path / "c.info").write_text(REPORT)
    (tmp_path / "log.json").write_text(json.dumps({"path": "A.swift", "log": "\x1e" + "\x1f".join(["a1", "me", "2024-01-01T00:00:00Z", "Fix"])}) + "\n")
    more = ["--lcov", str(tmp_path / "c.info"), "--history", str(tmp_path / "log.json"), "--reference-time", "2024-02-01 00:00:00"]
    assert main(["analyze", str(src), "--format", "debt-json", *more]) == 0
    whole = json.loads(capsys.readouterr().out)
    assert any(c["kind"] == "git-history.recency" for i in whole["items"] for c in i["scoreBreakdown"]["contributions"])
    assert main(["validate", str(src), "--max-score", "0"]) == 1
    capsys.readouterr()
    assert main(["explain-coverage", str(src), *more]) == 0
    assert any("matched=A.swift" in x for x in capsys.readouterr().out.splitlines())
    artifact = {"schema_version": 3, "snapshots": [{"id": "s1"}, {"id": "s2", "parent_id": "s1"}], "events": [{"finding": "f", "event_id": "e1", "snapshot_id": "s1", "kind": "opened"}, {"finding": "f", "event_id": "e2", "snapshot_id": "s2", "kind": "observed"}], "detections": [{"snapshot_id": "s1", "id": "d", "rule": "r", "source": "a", "line": 1, "column": 2}]}
    path = str(tmp_path / "a.json")
    (tmp_path / "a.json").write_text(json.dumps(artifact))
    assert main(["lifecycle-inventory", path]) == 0 and "f open last=observed events=2" in capsys.readouterr().out
    assert main(["lifecycle-explain", path, "f"]) == 0 and capsys.readouterr().out.split() == ["s1", "opened", "e1", "s2", "observed", "e2"]
    assert main(["lifecycle-explain", path, "none"]) == 1
    assert main(["lifecycle-snapshot", path, "s1"]) == 0 and "a:1:2: r d" in capsys.readouterr().out
    assert main(["lifecycle-export", path]) == 0 and len(capsys.readouterr().out.splitlines()) == 5
