"""Sources, the Swift front end, sinks, streaming and the whole analysis."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codeledger.cli import main
from codeledger.extract import facts, lexer, swift
from codeledger.plans import analysis
from codeledger.sinks import reports as sink
from codeledger.sources import files, vector_store
from codeledger.streaming import ingest


def complexity(body: str) -> int:
    return swift.parse("p", "M", f"func f() {{\n{body}\n}}").functions[0]["complexity"]


@pytest.mark.parametrize(
    ("body", "ccf"),
    [
        ("if a { }", 2), ("guard a else { return }", 2), ("while a { }", 2), ("repeat { } while a", 2), ("for i in x { }", 2), ("let v = a ? 1 : 2", 2), ("if a && b || c { }", 4),
        ("switch a {\ncase 1: x()\ncase 2: y()\ndefault: z()\n}", 3), ("do { } catch { x() }", 2), ("let v = a ?? b", 1), ("let v = a?.b", 1), ("#if A && B\nx()\n#endif", 1), ("x.map { if $0 { } }", 1), ("func g() { if a { } }\ng()", 1),
    ],
)
def test_decisions(body, ccf):
    assert complexity(body) == ccf


def rules_of(text: str) -> list[str]:
    return sorted(d["rule"].rsplit(".", 1)[1] for d in swift.parse("p", "M", text).detections)


@pytest.mark.parametrize(
    ("text", "rules"),
    [
        ("func f() { try! g() }", ["force-try"]), ("func f() { try? g() }", []), ("func f() { let a = b as! C }", ["force-cast"]), ("func f() { let a = b as? C }", []),
        ("final class A: @unchecked Sendable { }", ["unchecked-sendable"]), ("struct A: Sendable { }", []),
        ("actor A { nonisolated(unsafe) var x = 1 }", ["actor-nonisolated-unsafe"]), ("class A { nonisolated(unsafe) var x = 1 }", []),
        ("func f() { do { try g() } catch { } }", ["empty-catch"]), ("func f() { do { try g() } catch { h() } }", []),
        ("var shared = 1", ["global-data"]), ("let shared = 1", []), ("#if DEBUG\nvar shared = 1\n#endif", []),
        ("func f(a: A, b: A, c: A, d: A, e: A, f: A) { }", ["long-parameter-list"]), ("func f(a: A, b: A, c: A, d: A, e: A) { }", []),
        ("func f() {\n" + "g()\n" * 20 + "}", ["long-function"]), ("func f() {\n" + "g()\n" * 19 + "}", []),
        ("class A {\n" + "".join(f"let a{i} = 1\n" for i in range(20)) + "}", ["large-class"]), ("struct A {\n" + "".join(f"let a{i} = 1\n" for i in range(20)) + "}", []),
        ("actor A { var n = 0\nfunc f() async {\nn += 1\nawait g()\nprint(n)\n} }", ["actor-state-across-await"]), ("actor A { var n = 0\nfunc f() async {\nawait g()\nprint(n)\n} }", []),
        ('let s = "try! x as! y"  // try! z', []),
    ],
)
def test_rules(text, rules):
    assert rules_of(text) == rules


def test_lexer():
    text = 'let a = "x \\(f("y")) z" /* a /* b */ c */ + #"raw \\ " q"# // end\n"""\nmulti\n"""'
    assert [t.text for t in lexer.tokens(text) if t.kind == "string"] == ['"x \\(f("y")) z"', '#"raw \\ " q"#', '"""\nmulti\n"""']
    for bad in ('"open', "/* open", "func f() {", "func f() )"):
        assert swift.parse("p", "M", bad).diagnostics and not swift.parse("p", "M", bad).functions


SOURCES = [
    ("A.swift", "M", "class A {\n  var x = 1\n  let y = 2\n  func run(a: Int, b: Int, c: Int) {\n    helper(a)\n    switch a {\n    case 1: x = 1\n    case 2: x = 2\n    default: break\n    }\n  }\n  func helper(_ v: Int) { }\n}\nextension A { func more() { } }"),
    ("B.swift", "M", "struct B {\n  let a: A\n  func go(a: Int, b: Int, c: Int) {\n    switch a {\n    case 1: p()\n    case 2: q()\n    default: break\n    }\n  }\n}"),
    ("C.swift", "M", "func broken( {"),
]


def test_analysis(spark):
    done = analysis.workspace(spark, SOURCES, files.WorkspaceConfiguration(minimum_duplicate_lines=3))
    assert done.complete and [r.severity for r in done.diagnostics.collect()] == ["warning"]
    seen = {(r.metric, r.value) for r in done.observations.collect()}
    assert {("NOMC", 3), ("NOGC", 2), ("WMCC", 5), ("NOCC", 1), ("NOPF", 3)} <= seen
    assert {r.metric for r in done.summary.collect()} == set(analysis.policy.METRICS)
    items = {r.id: r for r in done.items.collect()}
    assert "callable:M.A.run(a:b:c:)" in items and "type:M.A" in items and "file:A.swift" in items and items["module:M"].level == "module"
    strict = analysis.workspace(spark, SOURCES, files.WorkspaceConfiguration(strict_syntax=True))
    assert not strict.complete and strict.summary.filter("score is not null").count() == 0
    graph = analysis.dependency_graph(done.facts)
    assert ("callable:M.A.helper(_:)@A.swift:12:3",) in {(r.target,) for r in graph["edges"].filter("confidence = 'resolved'").collect()}
    found = analysis.repository_rules(done.facts)
    assert [(r.support, len(r["items"])) for r in found["clumps"].groups.collect()] == [(2, 3)] and found["switches_complete"]
    results = analysis.rule_results(done.facts, [r.identity for r in analysis.BUILT_IN])
    assert results.count() == 30 and results.filter("outcome = 'parseFailed'").count() == 10
    assert facts.structural_digests(done.facts).count() == 0


def test_user_rules(spark):
    def find(text):
        if "boom" in text:
            raise RuntimeError("boom")
        return [(1, 1, "found")] if "x" in text else []

    src = files.in_memory(spark, [("a", "M", "x"), ("b", "M", "y"), ("c", "M", "boom")])
    got = {(r.source, r.outcome, r.message) for r in analysis.run_rules(src, [analysis.rules.Rule("u", "r", detect=find)]).collect()}
    assert got == {("a", "committed", "found"), ("b", "committed", None), ("c", "failed", "boom")}


def test_sources(spark, tmp_path):
    for p, t in (("Sources/A.swift", "let a = 1"), ("Sources/Tests/B.swift", "é"), (".build/C.swift", "x"), ("Package.swift", "x"), ("Sources/D.txt", "x"), ("Gen/E.swift", "x")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = files.scan_directory(spark, str(tmp_path), excludes=["Gen"])
    assert {r.path: r.content for r in got.collect()} == {"Sources/A.swift": "let a = 1", "Sources/Tests/B.swift": "é"}
    assert [r.path for r in got.filter(files.is_test_source()).collect()] == ["Sources/Tests/B.swift"]
    (tmp_path / "m.json").write_text(json.dumps({"root": str(tmp_path), "sources": [{"path": "Sources/A.swift", "module": "Core"}]}))
    assert [(r.path, r.module) for r in files.scan_manifest(spark, str(tmp_path / "m.json")).collect()] == [("Sources/A.swift", "Core")]
    with pytest.raises(Exception, match="larger than"):
        files.scan_directory(spark, str(tmp_path), maximum=3).collect()
    for bad in ([], [("a", "M", "x"), ("a", "M", "y")], [("", "M", "x")]):
        with pytest.raises(ValueError):
            files.in_memory(spark, bad)
    with pytest.raises(ValueError, match="unknown configuration keys"):
        files.WorkspaceConfiguration.parse('{"nope": 1}')


def test_reports(spark, tmp_path):
    items = spark.createDataFrame([("a", "=cmd|x", "callable", "f.swift", 3, 91.25, "critical", "swift"), ("b", "<b>", "file", "g.swift", 1, 72.5, "high", "swift"), ("c", "c", "file", "h", 1, None, None, None)], "id string, display_name string, level string, file string, line long, score double, priority string, category string")
    text = {k: [r.line for r in sink.render(items, k).orderBy("ord").collect()] for k in sink.FORMATS}
    assert text["text"][0].startswith("91.2 critical") and text["text"][1].startswith("72.5") and text["text"][2].startswith("- unscored")
    assert text["html"][2].count("&lt;b&gt;") == 1 and text["dot"][0] == "digraph debt {" and text["dot"][-1] == "}" and json.loads(text["json"][0])["id"] == "a"
    assert '"91.2500"' in text["csv"][1] and "=cmd\\|x" in text["markdown"][1]
    cell = spark.range(1).select(*[sink.csv_cell(F.lit(v)) for v in ("=1+1", " -x", 'a"b', "ok", "\tx")]).first()
    assert list(cell) == ['"\'=1+1"', '"\' -x"', '"a""b"', '"ok"', '"\'\tx"']
    page = sink.dashboard(items)
    assert "<b>" not in page.split("application/json")[1] and "\\u003cb>" in page
    sink.write_text(sink.render(items, "compact"), str(tmp_path / "out"))
    assert len(spark.read.text(str(tmp_path / "out")).collect()) == 3
    with pytest.raises(ValueError):
        sink.check_outputs(["a.json", "a.json"], [])


def test_streaming_ingest(spark, tmp_path):
    store = str(tmp_path / "store")
    feed = tmp_path / "feed"
    rows = spark.createDataFrame([("s1", None, "d1"), ("s3", "s2", "d3")], ingest.SNAPSHOT)
    rows.write.parquet(str(feed))

    def run():
        q = ingest.start(spark.readStream.schema(ingest.SNAPSHOT).parquet(str(feed)), store, str(tmp_path / "check"))
        q.awaitTermination(60)

    run()
    assert {r.id: r.state for r in ingest.states(spark, store).collect()} == {"s1": "processed", "s3": "pending"}
    spark.createDataFrame([("s2", "s1", "d2"), ("s1", None, "d1")], ingest.SNAPSHOT).write.mode("append").parquet(str(feed))
    run()
    assert {r.id: r.state for r in ingest.states(spark, store).collect()} == {"s1": "processed", "s2": "processed", "s3": "processed"}
    with pytest.raises(ValueError, match="other content"):
        ingest.ingest_batch(spark.createDataFrame([("s1", None, "changed")], ingest.SNAPSHOT), store)


def test_vector_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<float>")
    vector_store.create(rows, str(tmp_path / "v"), 2, "cosine", "m1")
    assert vector_store.open_store(spark, str(tmp_path / "v"), 2, "cosine", "m1").count() == 1
    with pytest.raises(ValueError):
        vector_store.open_store(spark, str(tmp_path / "v"), 3, "cosine", "m1")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.swift").write_text(SOURCES[0][2])
    assert main(["analyze", str(tmp_path / "src"), "--format", "compact", "--top", "3"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 3
    assert main(["analyze", str(tmp_path / "src"), "--max-score", "0.1"]) == 1
    report = {"schema_version": 2, "items": [{"id": "a", "score": 70.0, "priority": "high", "evidence_ids": ["e"]}], "aggregations": []}
    for name, score in (("before", 70.0), ("after", 65.0)):
        report["items"][0]["score"] = score
        (tmp_path / f"{name}.json").write_text(json.dumps(report))
    args = ["validate-improvement", str(tmp_path / "before.json"), str(tmp_path / "after.json"), "--minimum"]
    assert main([*args, "5"]) == 0 and main([*args, "6"]) == 1
    (tmp_path / "old.json").write_text(json.dumps({**report, "schema_version": 1}))
    with pytest.raises(Exception, match="schema version"):
        main(["compare", str(tmp_path / "old.json"), str(tmp_path / "after.json")])


def test_forced_tries_outside_of_bodies_and_their_declarations(spark):
    text = "let b = try! h()\nclass C {\n  let c = try! k()\n  func f() {\n    try! a(); try! d()\n  }\n  var after = x as! Y\n}\nfunc g(p: Int = try! q()) {}\nvar last = try! h()\n"
    found = facts.extract(spark.createDataFrame([("a.swift", "M", text)], "path string, module string, content string"))
    rows = {(r.line, r.column): r for r in facts.structural_digests(found).collect() if r.rule in ("codeledger.force-try", "codeledger.code-smell.force-cast")}
    at = {line: [rows[k] for k in sorted(rows) if k[0] == line] for line in {k[0] for k in rows}}
    assert sorted(at) == [1, 3, 5, 7, 9, 10] and len(at[5]) == 2
    one, two = at[5]
    assert one.subject_digest != two.subject_digest and one.decl_digest == two.decl_digest  # two on a line of one function
    assert at[1][0].decl_digest is None and at[10][0].decl_digest is None  # in no declaration; the last one follows g
    assert at[1][0].subject_digest == at[10][0].subject_digest
    assert at[3][0].decl_digest == at[7][0].decl_digest not in (None, one.decl_digest)  # in the class, before and behind f
    assert at[9][0].decl_digest not in (None, one.decl_digest)
