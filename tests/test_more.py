"""Operators that queries don't reach in full: strategies, locks, registration, stretches of a report."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeledger.extract import facts, swift
from codeledger.operators import cache, clones, evidence, lifecycle, mining, rules, scoring, vectors
from codeledger.sinks import reports as sink
from codeledger.sources import files, lcov

REPORT = "DA:9,9\nFN:1,early\nSF:a\nFN:2,f\nFNDA:3,f\nDA:2,3\nSF:b\nDA:1,0\nend_of_record\nDA:7,1\nbad\nDA:x,1\nSF:c\nDA:1,1\nend_of_record\nDA:5,5"


def entries(df):
    return sorted((r.source_path, r.kind, r.line, r.name, r.hits) for r in df.collect())


def test_report_in_stretches_equals_the_report_in_one(spark, monkeypatch):
    lines = lcov.lines_of(spark.createDataFrame([("r", REPORT), ("s", REPORT + "\n" + REPORT)], "k string, t string"), "k", "t")
    whole = entries(lcov.records(lines))
    assert ("a", "line_hits", 9, None, 9) in whole and ("c", "line_hits", 7, None, 1) in whole and not any(x[2] == 5 and x[0] == "c" for x in whole[:5])
    for stretch in (1, 2, 3, 5):
        monkeypatch.setattr(lcov, "STRETCH", stretch)
        assert entries(lcov.records(lines)) == whole


def test_cloned_lines_equal_those_of_blocks(spark):
    rng = random.Random(22)
    for width in (2, 3, 4):
        rows = [(f, i, rng.choice("abc"), 2 * i + 1) for f in "ABCD" for i in range(rng.randrange(0, 25))]
        lines = spark.createDataFrame(rows, "file string, ord long, signature string, number long")
        found = clones.blocks(lines, width, None)
        pairs = lambda df: {(r.file, r.ord) for r in df.collect()}
        assert pairs(clones.cloned_lines(lines, width)) == pairs(clones.duplicated_lines(found))


def test_physical_lines_of_blocks(spark):
    rows = [(f, i, s, n) for f, base in (("A", 1), ("B", 11)) for i, (s, n) in enumerate([("x", base), ("y", base + 3), ("z" + f, base + 4)])]
    lines = spark.createDataFrame(rows, "file string, ord long, signature string, number long")
    got = clones.physical_lines_per_file(clones.blocks(lines, 2, None), lines)
    assert {r.file: r.duplicate_lines for r in got.collect()} == {"A": 4, "B": 4}  # with the two lines between


def test_waiting_snapshots_on_a_long_path(spark):
    rows = [(i, i - 1 if i else None) for i in range(70) if i != 50] + [(200, 200 + 1000)]
    got = {r.id: r.state for r in lifecycle.pending(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert {i for i, s in got.items() if s == "pending"} == {*range(51, 70), 200} and len(got) == 70
    with pytest.raises(RuntimeError, match="cycle"):
        lifecycle.pending(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long"), most_rounds=4)


def test_unit_budget_over_ranges(spark):
    units = spark.createDataFrame([(f, k) for f in range(30) for k in range(f % 4 + 1)], "file long, k long").repartition(5)
    total, kept = 0, set()
    for f in range(30):
        if total <= 20:
            kept.add(f)
        total += f % 4 + 1
    assert {r.file for r in mining.budgeted_units(units, "file", 20).collect()} == kept


def test_lookup_by_selector(spark):
    rows = spark.createDataFrame([("r", 1, "d", "p", 1, 1, "f"), ("r", 1, "d", "p", 2, 1, "f")], "rule string, revision int, snapshot_digest string, path string, line int, column int, fingerprint string")
    whole = dict(zip(mining.SELECTOR, ("r", 1, "d", "p", 2, 1, "f"), strict=True))
    assert [r.line for r in mining.lookup(rows, whole).collect()] == [2]
    with pytest.raises(ValueError):
        mining.lookup(rows, {"rule": "r"})


def test_cache_plans(spark):
    now = spark.createDataFrame([("a", "M", "1", 0), ("b", "M", "2", 0)], "path string, module string, digest string, budget long")
    head = dict.fromkeys(cache.HEADER, "1")
    assert cache.plan(now, now, head, head) == ("warm-reuse", {})
    assert cache.plan(now, now.filter("path = 'a'").withColumn("digest", F.lit("x")), head, head) == ("partial-rebuild", {"source-content-changed": 1, "source-added": 1})
    assert cache.plan(now, now, head, {**head, "provider": "2"}) == ("incompatible-rebuild", {"provider-changed": 2})
    assert cache.plan(now, None, head, None)[0] == "cold-rebuild" and cache.plan(now, now, head, head, corrupt=True)[0] == "recovered-corruption"
    assert cache.plan(now, now, head, head, "rebuild")[0] == "forced-rebuild" and cache.plan(now, now, head, head, "disabled")[0] == "disabled"


def test_explorer(spark):
    cycle = [None]
    for _ in range(5):
        cycle.append(scoring.next_priority(cycle[-1]))
    assert cycle == [None, "critical", "high", "medium", "low", None]
    items = spark.createDataFrame([("i", "i@1", "callable", "M", "f", 1, 1, "high", 70.0), ("j", "j", "file", "M", "f", 1, 1, None, None)], "id string, item_key string, level string, module string, file string, line long, column long, priority string, score double").withColumn("display_name", F.col("id"))
    rows = spark.createDataFrame([("i@1", "i", "e1", "swift.a", "optional", "available", None, 1.0, 70.0, "q", None, "M", "f", 1, 1), ("i@1", "i", "e2", "swift.b", "required", "unavailable", "why", 1.0, None, "unavailable", None, "M", "f", 1, 1)], "item_key string, item_id string, id string, kind string, requirement string, state string, reason string, weight double, normalized_score double, raw_value string, note string, module string, file string, line long, column long")
    told = evidence.explained(items, evidence.breakdown(rows))
    lines = [r.line for r in scoring.detail_lines(told.filter("id = 'i'")).orderBy("at").collect()]
    assert lines[0] == "i" and "- swift.a e1: raw=q, normalized=70.0, weight=1.0, contribution=70.0" in lines and lines[-1] == "- swift.b e2: why"
    assert told.filter("id = 'j'").first().explanation == evidence.NO_EVIDENCE
    assert [r.id for r in scoring.with_priority(items, "high").collect()] == ["i"] and scoring.with_priority(items, None).count() == 2


def test_evidence_order_has_nulls_and_nan_first(spark):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([1.0, None, float("nan"), 0.5])], "n long, normalized_score double")
    rows = rows.withColumns({c: F.lit("x") for c in ("id", "kind", "raw_value", "note", "requirement", "state", "reason", "module", "file")}).withColumns({"weight": F.lit(1.0), "line": F.lit(1), "column": F.lit(1)})
    assert [r.n for r in rows.orderBy(evidence.sort_key()).collect()] == [1, 2, 3, 0]


def test_registration():
    ok = rules.Rule("n", "a", revision=3, compatible_from=((1, ("x",)), (2, ("y",))), configuration_from=((3, ("z",)), (1, ("x",))))
    assert list(rules.registered([ok])) == ["n.a"]
    for bad in (
        [], [ok, ok], [rules.Rule("n", "b", revision=2, compatible_from=((2, ()),))], [rules.Rule("n", "b", revision=3, compatible_from=((1, ()), (1, ())))], [rules.Rule("n", "b", severity="loud")],
        [rules.Rule("n", "b", revision=2, configuration_from=((1, ("x",)),))], [rules.Rule("n", "b", configuration_from=((2, ("x",)),))], [rules.Rule("n", "b", configuration_from=((1, ("x", "x")),))],
    ):
        with pytest.raises(ValueError):
            rules.registered(bad)


def test_vector_index(spark):
    index = vectors.ExactIndex(spark.createDataFrame([("a", [1.0, 0.0], {"k": "1"}), ("b", [0.0, 1.0], {"k": "2"})], "id string, vector array<float>, metadata map<string,string>"))
    index.upsert(spark.createDataFrame([("c", [1.0, 0.1], {"k": "2"})], "id string, vector array<float>, metadata map<string,string>"))
    assert [r.id for r in index.nearest([1.0, 0.0], 2).collect()] == ["a", "c"] and [r.id for r in index.nearest([1.0, 0.0], 1, {"k": "2"}).collect()] == ["c"]
    index.delete(spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in index.nearest([1.0, 0.0], 1).collect()] == ["c"]


def test_writers_exclude_each_other(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "id long, v string")
    path = str(tmp_path / "t")
    assert sink.append_once(rows, path, "id") == 1 and sink.append_once(rows, path, "id") == 0
    (tmp_path / "t.lock").write_text("")
    with pytest.raises(RuntimeError, match="another writer"):
        sink.append_once(rows, path, "id")


def test_another_parser(spark):
    def words_only(path, module, content):  # a front end that takes every word for a function
        found = swift.Facts()
        found.functions = [{"name": w, "kind": "method", "line": 1, "column": k + 1} for k, w in enumerate(content.split())]
        return found

    src = files.in_memory(spark, [("p", "M", "one two")])
    assert facts.table(facts.extract(src), "functions").count() == 0
    assert [r.name for r in facts.table(facts.extract(src, words_only), "functions").orderBy("column").collect()] == ["one", "two"]


def test_declaration_digests_hold_the_head(spark):
    text = "class A {{\n  func f({p}: Int) {{\n    try! g()\n  }}\n  func h() {{ }}\n}}\n"
    src = files.in_memory(spark, [("a", "M", text.format(p="x")), ("b", "M", text.format(p="y")), ("c", "M", text.format(p="x"))])
    got = {r.path: r for r in facts.structural_digests(facts.extract(src)).collect()}
    assert got["a"].decl_digest == got["c"].decl_digest != got["b"].decl_digest
    assert len({r.subject_digest for r in got.values()}) == 1 and None not in {r.decl_digest for r in got.values()}


def test_links_are_not_followed(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.swift").write_text("let a = 1")
    (tmp_path / "B.swift").write_text("let b = 1")
    (tmp_path / "src" / "B.swift").symlink_to(tmp_path / "B.swift")
    assert [r.path for r in files.scan_directory(spark, str(tmp_path / "src")).collect()] == ["A.swift"]
    with pytest.raises(ValueError, match="link"):
        files.scan_file(spark, str(tmp_path / "src" / "B.swift"))
