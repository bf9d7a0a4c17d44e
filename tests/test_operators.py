"""Operators on small rows: fixtures with known results, brute force, order independence."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from codeledger.operators import clones, compare, components, coverage, graph, history, lifecycle, metrics, mining, resolve, rules, scoring, vectors
from codeledger.plans import q_structure
from codeledger.sources import lcov


def lines(spark, files):
    return spark.createDataFrame([(f, i, s, i + 1) for f, sigs in files.items() for i, s in enumerate(sigs)], "file string, ord long, signature string, number long")


def brute_blocks(files, w):
    """Straight from the definition: seeds in order, extended, spans covered."""
    order = [(f, i) for f in sorted(files) for i in range(len(files[f]))]
    out, covered = set(), {}
    for (f1, i), (f2, j) in itertools.combinations(order, 2):
        if f1 == f2 and j - i < w or files[f1][i : i + w] != files[f2][j : j + w] or len(files[f1][i : i + w]) < w or len(files[f2][j : j + w]) < w:
            continue
        out.add((f1, i, f2, j))
    blocks = []
    for d in sorted({(f1, f2, j - i) for f1, i, f2, j in out}):
        f1, f2, step = d
        end = -1
        for i in sorted(i for g1, i, g2, j in out if (g1, g2, j - i) == d):
            if i + w <= end:
                continue
            n = 0
            while i + n < len(files[f1]) and i + step + n < len(files[f2]) and files[f1][i + n] == files[f2][i + step + n] and (f1 != f2 or n < step):
                n += 1
            blocks.append((f1, i, f2, i + step, n))
            end = i + n
    del covered
    return sorted(blocks)


@pytest.mark.parametrize(("files", "w", "n", "unique"), [({"A": "abcd", "B": "abcd"}, 2, 1, 8), ({"A": "aaaa", "B": "xbc"}, 3, 0, 0), ({"A": "abcxabc"}, 3, 1, 6)])
def test_clone_fixtures(spark, files, w, n, unique):
    found = clones.blocks(lines(spark, files), w)
    assert found.count() == n
    assert clones.duplicated_lines(found).count() == unique


def test_clones_equal_brute_force(spark):
    rng = random.Random(1)
    cases = {f"{k:03d}": {f: "".join(rng.choice("ab") for _ in range(rng.randrange(9))) for f in "xyz"} for k in range(60)}
    flat = {f"{k}/{f}": s for k, files in cases.items() for f, s in files.items()}
    # One frame for all: signatures carry the case, so cases never meet.
    rows = [(name, i, f"{name[:3]}{c}", i + 1) for name, s in flat.items() for i, c in enumerate(s)]
    got = clones.blocks(spark.createDataFrame(rows, "file string, ord long, signature string, number long"), 2, None).collect()
    want = [(f"{k}/{a}", i, f"{k}/{b}", j, n) for k, files in cases.items() for a, i, b, j, n in brute_blocks(files, 2)]
    assert sorted((r.file1, r.start1, r.file2, r.start2, r["lines"]) for r in got) == sorted(want)


def test_clone_budget(spark):
    with pytest.raises(clones.BudgetExceeded):
        clones.blocks(lines(spark, {"A": "a" * 20}), 2, 1)


def evidence(spark, rows):
    return spark.createDataFrame([(r[0], f"{r[0]}:{k}", r[1], r[2], r[3], None, r[4], r[5], None) for k, r in enumerate(rows)], scoring.EVIDENCE)


def test_composite_score_fixtures(spark):
    rows = [
        ("a", "complexity", "optional", "available", 2.0, 80.0), ("a", "history", "optional", "unavailable", 3.0, None),
        ("b", "complexity", "optional", "available", 1.0, 80.0), ("b", "bindings", "required", "unavailable", 1.0, None),
        ("c", "complexity", "optional", "available", 1.0, 40.0), ("c", "coverage.lcov", "optional", "measuredCoverage", 1.0, 100.0),
        ("d", "complexity", "optional", "available", 1.0, 40.0), ("d", "coverage.lcov", "optional", "measuredCoverage", 1.0, 50.0),
        ("e", "complexity", "optional", "available", -1.0, 40.0), ("f", "complexity", "optional", "available", 1.0, 140.0), ("g", "x", "optional", "unavailable", 1.0, None),
        ("h", "coverage.lcov", "optional", "zeroCoverage", 1.0, 0.0), ("h", "x", "optional", "available", 1.0, 90.0),
    ]
    got = {r.item_id: r for r in scoring.composite_scores(evidence(spark, rows)).collect()}
    assert (got["a"].score, got["a"].configured_weight, got["a"].available_weight) == (80.0, 5.0, 2.0)
    assert got["b"].score is None and got["b"].available_weight == 1.0
    assert got["c"].score == 40.0 and got["d"].score == 20.0 and got["e"].score is None and got["f"].score == 100.0 and got["g"].score is None and got["h"].score == 0.0
    pri = scoring.composite_scores(evidence(spark, rows)).select("item_id", scoring.priority(F.col("score")).alias("p")).collect()
    assert {r.item_id: r.p for r in pri}["a"] == "high"


def test_every_subset_of_missing_evidence(spark):
    scores, weights = [10.0, 50.0, 90.0], [1.0, 2.0, 3.0]
    rows = [(f"m{mask}", "k", "optional", "available" if mask >> i & 1 else "unavailable", weights[i], scores[i] if mask >> i & 1 else None) for mask in range(8) for i in range(3)]
    got = {r.item_id: r.score for r in scoring.composite_scores(evidence(spark, rows)).collect()}
    for mask in range(8):
        have = [i for i in range(3) if mask >> i & 1]
        want = sum(scores[i] * weights[i] for i in have) / sum(weights[i] for i in have) if have else None
        assert got[f"m{mask}"] == pytest.approx(want) if have else got[f"m{mask}"] is None


def test_ranking_limits(spark):
    items = spark.createDataFrame([("a", 5.0), ("b", None), ("c", 9.0), ("d", 5.0)], "id string, score double")
    ids = lambda **k: [r.id for r in scoring.limited(items, **k).collect()]
    assert ids(top=3) == ["c", "a", "d"] and ids(top=3, head=1) == ["c"] and sorted(ids(top=1, tail=2)) == ["b", "d"] and len(ids(top=-1)) == 4


def test_table_scores(spark):
    rows = [("LOCC", 2, 0, 0, 20, 30), ("NOMC", 2, 0, None, 20, 30), ("NOCC", 2, 0, None, 20, 30), ("LOCF", 2, 0, None, 20, 30), ("WMCC", 0, 0, 0, None, 0), ("CCF", 2, 1, 1, 30, 40), ("NOAV", 1, 0, None, 1, 1), ("DC", 0, 0, 0, None, 0)]
    s = spark.createDataFrame(rows, "metric string, observations long, violations long, paper_violations long, maximum long, total long")
    get = lambda mode, dup=12, par=0, props=4: {r.metric: r.score for r in metrics.table_scores(s, F.lit(4), F.lit(props), F.lit(par), F.lit(dup), F.lit(100), mode).collect()}
    paper = get("paper")
    assert paper["LOCC"] == pytest.approx(1000 / 1520) and paper["NOMC"] == pytest.approx(500 / 95) and paper["NOCC"] == pytest.approx(1000 / 170) and paper["LOCF"] == pytest.approx(2000 / 320)
    assert paper["WMCC"] is None and paper["DC"] is None and paper["CCF"] == pytest.approx(2 / (30 / 40 + 0.4)) and paper["NOAV"] == pytest.approx(2 / 1.4)
    assert get("corrected")["DC"] == pytest.approx(2 / 0.52) and get("bounded")["NOCC"] == 5.0 and get("paper", dup=0)["DC"] == 5.0 and get("paper", props=0)["NOAV"] is None and set(get("none").values()) == {None}


def test_closed_itemsets_fixture(spark):
    units = spark.createDataFrame([("1", list("abcxy")), ("2", list("abcxz")), ("3", list("abcyz"))], "unit string, items array<string>")
    got = mining.closed_itemsets(units, min_support=3)
    assert [(list(r["items"]), r.support) for r in got.groups.collect()] == [(["a", "b", "c"], 3)] and got.complete
    over = mining.closed_itemsets(units, max_comparisons=2)
    assert over.groups.count() == 0 and over.issues == ["comparison-budget-exceeded"]


def test_closed_itemsets_equal_brute_force(spark):
    rng = random.Random(4)
    units = [(str(i), sorted(rng.sample("abcdefg", rng.randrange(2, 7)))) for i in range(14)]
    want = {}
    for r in range(3, 8):
        for c in itertools.combinations("abcdefg", r):
            sup = [set(s) for _, s in units if set(c) <= set(s)]
            if len(sup) >= 2 and set.intersection(*sup) == set(c):
                want[c] = len(sup)
    got = mining.closed_itemsets(spark.createDataFrame(units, "unit string, items array<string>"))
    assert {tuple(r["items"]): r.support for r in got.groups.collect()} == want


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    root = list(range(80))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}


LCOV = "DA:9,1\nSF:Sources/A.swift\nFN:3,M.process\nFNDA:4,M.process\nDA:3,4\nDA:4,0\nDA:x,1\nend_of_record\nSF:B.swift\nDA:1,0\nSF:C.swift\nDA:1,2\nend_of_record\n"


def test_lcov_lines(spark):
    got = lcov.records(lcov.lines_of(spark.createDataFrame([("r", LCOV)], "k string, t string"), "k", "t")).collect()
    assert sorted((r.source_path, r.kind, r.line, r.name, r.hits) for r in got if r.kind == "line_hits") == [("B.swift", "line_hits", 1, None, 0), ("C.swift", "line_hits", 1, None, 2), ("Sources/A.swift", "line_hits", 3, None, 4), ("Sources/A.swift", "line_hits", 4, None, 0), ("Sources/A.swift", "line_hits", 9, None, 1)]
    assert [(r.line, r.name) for r in got if r.kind == "function"] == [(3, "M.process")]


def test_coverage_paths_and_functions(spark):
    ents = spark.createDataFrame([("/repo/Sources/A.swift",), ("x/./B.swift",), ("none.swift",)], "path string")
    recs = spark.createDataFrame([("Sources/A.swift", 2), ("A.swift", 1), ("x/y/../B.swift", 3)], "source_path string, record_order int")
    got = {r.path: (r.matched, r.strategy) for r in coverage.match_paths(ents, recs).collect()}
    assert got == {"/repo/Sources/A.swift": ("A.swift", "suffix"), "x/./B.swift": ("x/y/../B.swift", "exact"), "none.swift": (None, "missingFile")}
    e = spark.createDataFrame([("1", "A", "M.process", 3), ("2", "A", "N.other", 7), ("3", "A", "N.helper", 1), ("4", "A", "q", 9), ("5", "A", "z", 99)], "entity_id string, source_path string, name string, line long")
    r = spark.createDataFrame([("A", "function", 3, "M.process", None), ("A", "function_hits", None, "M.process", 4), ("A", "function", 50, "K.other", None), ("A", "function", 1, "init", None), ("A", "line_hits", 9, None, 0)], "source_path string, kind string, line long, name string, hits long")
    got = {x.entity_id: (x.strategy, x.hits) for x in coverage.match_functions(e, r).collect()}
    assert got == {"1": ("exactName", 4), "2": ("dottedSuffix", 0), "3": ("startLine", 0), "4": ("executableLine", 0), "5": ("unmatchedEntity", None)}


def test_history(spark):
    log = "\x1ea1\x1fann\x1f2026-09-10T12:00:00Z\x1fFix: the crash\n\nA.swift\x1eb2\x1fbob\x1f2026-09-11T12:00:00Z\x1fprefix only\n\x1ebroken"
    commits = history.parse_log(spark.createDataFrame([("A.swift", log)], "p string, t string"), "p", "t")
    r = history.evidence(commits, "2026-09-12T00:00:00Z").first()
    assert (r.changes, r.frequency, r.recency, r.fix_share, r.top_contributor_share) == (2, 40.0, 100.0, 50.0, 50.0)
    text = "a" * 40 + " 1 1 2\nauthor x\n\tlet a\n" + "b" * 40 + " 2 2\n\tlet b"
    assert [(x.line, x.revision[0]) for x in history.parse_blame(spark.createDataFrame([("s", text)], "s string, t string"), "s", "t").orderBy("line").collect()] == [(1, "a"), (2, "b")]


def test_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], {"m": "A", "k": "f"}), ("b", [1.0, 0.0], {"m": "A", "k": "f"}), ("c", [0.0, 1.0], {"m": "A", "k": "t"}), ("d", [1.0, 0.0], {"m": "B", "k": "f"})], "id string, vector array<float>, metadata map<string,string>")
    got = vectors.nearest(vectors.with_metadata(rows, {"m": "A", "k": "f"}), [1.0, 0.0], 2).collect()
    assert [(r.id, r.distance) for r in got] == [("a", 0.0), ("b", 0.0)]
    with pytest.raises(vectors.Incomplete):
        vectors.nearest(rows, [1.0, 0.0], 2, maximum=3)
    with pytest.raises(vectors.Incomplete, match="corrupt row z"):
        vectors.nearest(rows.unionByName(spark.createDataFrame([("z", [0.0, 0.0], {})], rows.schema)), [1.0, 0.0], 2)
    with pytest.raises(ValueError):
        vectors.nearest(rows, [1.0, 0.0], 257)


def test_resolution(spark):
    types = spark.createDataFrame([("M", "A"), ("M", "A.B"), ("N", "C"), ("O", "C"), ("N", "D")], "module string, name string")
    refs = spark.createDataFrame([(1, "M", "B", ["A"], []), (2, "M", "A", [], []), (3, "M", "C", [], ["N", "O"]), (4, "M", "D", [], ["N"]), (5, "M", "N.C", [], []), (6, "M", "C", [], []), (7, "M", "Z", [], [])], "ref_id long, module string, name string, scopes array<string>, imports array<string>")
    got = {r.ref_id: (r.outcome, r.module, r.name) for r in resolve.resolve_types(refs, types).collect()}
    assert got == {1: ("resolved", "M", "A.B"), 2: ("resolved", "M", "A"), 3: ("ambiguous", None, None), 4: ("resolved", "N", "D"), 5: ("resolved", "N", "C"), 6: ("ambiguous", None, None), 7: ("unresolved", None, None)}
    calls = spark.createDataFrame([(1, "c0", "self.run", "_:", "M.T"), (2, "c0", "go", "", "M.T"), (3, "c1", "run", "_:", "M.T"), (4, "c0", "U.x", "", "M.T")], "call_id long, caller string, callee string, labels string, owner string")
    defs = spark.createDataFrame([("c1", "M.T.run(_:)"), ("c2", "U.x()"), ("c3", "U.x()")], "callable_id string, full_name string")
    got = {r.call_id: (r.outcome, r.callable_id) for r in resolve.resolve_calls(calls, defs).collect()}
    assert got == {1: ("resolved", "c1"), 2: ("unresolved", None), 3: ("unresolved", None), 4: ("ambiguous", None)}


def test_graph_nulls_and_dot(spark):
    e = spark.createDataFrame([("a", 'b"', "resolved"), ("a", 'b"', "resolved"), ("x", "y", "unresolved")], "source string, target string, confidence string")
    got = {r.id: r for r in graph.coupling(e).collect()}
    assert got["a"].efferent == 2 and got["a"].fan_out == 1 and got['b"'].instability == 0.0 and "x" not in got
    assert {r.line for r in graph.dot_lines(e).collect()} == {'  "a" -> "b\\"";', '  "x" -> "y";'}


def test_performance_gate_fixture(spark):
    same = {c: "x" for c in compare.WORKLOAD}
    row = {f"{s}_{k}": v for s in ("base", "new") for k, v in {**same, "pair_id": "p"}.items()} | {"base_wall_s": 0.011977542, "new_wall_s": 0.010483625, "base_peak_bytes": 13_991_936, "new_peak_bytes": 13_975_552}
    r = compare.performance_gate(spark.createDataFrame([row])).first()
    assert r.comparable and r.passed and r.wall_regression_percent == pytest.approx(-12.472650899491738) and r.memory_regression_percent == pytest.approx(-0.117096018735363)
    r = compare.performance_gate(spark.createDataFrame([row | {"new_mode": "y"}])).first()
    assert not r.comparable and not r.passed and list(r.reasons) == ["analysis mode differs"]
    r = compare.performance_gate(spark.createDataFrame([row | {"new_wall_s": 0.5}])).first()
    assert not r.passed and list(r.reasons) == ["wall-clock"]


def test_compare_nulls(spark):
    schema = "id string, score double, priority string, location string, e array<string>"
    a = spark.createDataFrame([("1", 70.0, "high", "x", ["p"]), ("2", None, None, "x", []), ("3", 70.0, "high", "x", None)], schema)
    b = spark.createDataFrame([("1", 65.0, "medium", "x", ["p"]), ("2", None, None, "x", None), ("4", 70.0, "high", "x", [])], schema)
    got = {r.id: (r.status, r.score_delta) for r in compare.compare_items(a, b, sets=("e",)).collect()}
    assert got == {"1": ("changed", -5.0), "2": ("unchanged", None), "3": ("removed", None), "4": ("added", None)}
    total = compare.comparison_summary(compare.compare_items(a, b, sets=("e",)))
    assert compare.validate_improvement(total, 5.0).first().passed and compare.validate_improvement(total, 6.0).first().exit_status == 1


def test_lifecycle_rules(spark):
    events = spark.createDataFrame([("f", i, f"e{i}", k, f"s{i}") for i, k in enumerate(["opened", "observed", "resolved", "reopened"])] + [("g", 0, "e", "resolved", "s0")], "finding string, position long, event_id string, kind string, snapshot_id string")
    got = {r.finding: r.state for r in lifecycle.current_state(events).collect()}
    assert got == {"f": "open", "g": "illegal"}
    conf = spark.createDataFrame([("f", "bounded", 3), ("f", "exact", 1), ("f", "exact", 2)], "finding string, kind string, attempt int")
    assert tuple(lifecycle.best_conclusion(conf).first()) == ("f", "exact", 2)
    with pytest.raises(RuntimeError):
        lifecycle.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), spark.createDataFrame([("a",)], "id string"), 8)


def test_rule_grid_and_registration(spark):
    res = spark.createDataFrame([("r1", "a", "committed", 0), ("r1", "b", "committed", 2), ("r2", "a", "failed", 0)], "rule string, source string, outcome string, detections long")
    missing = rules.missing_pairs(res.select("rule"), res.select("source").distinct(), res).collect()
    assert [(r.rule, r.source) for r in missing] == [("r2", "b")]
    assert [(r.rule, r.source) for r in rules.absence_proofs(res).collect()] == [("r1", "a")]
    with pytest.raises(ValueError):
        rules.registered([rules.Rule("a", "b"), rules.Rule("a", "b")])


def test_order_does_not_matter(spark):
    rng = random.Random(2)
    rows = [(f"i{k % 5}", "k", "optional", "available", 1.0 + k % 3, float(k)) for k in range(40)]
    one = sorted((r.item_id, round(r.score, 9)) for r in scoring.composite_scores(evidence(spark, rows)).collect())
    rng.shuffle(rows)
    assert sorted((r.item_id, round(r.score, 9)) for r in scoring.composite_scores(evidence(spark, rows)).collect()) == one


def test_semantic_and_configuration_comparison(spark):
    base = {
        "prior_rule": "r", "current_rule": "r", "prior_engine": "1", "current_engine": "1", "prior_source_identity": "s", "current_source_identity": "s", "prior_capabilities": ["a", "b"], "current_capabilities": ["b", "a"],
        "capabilities_available": True, "configuration_compatible": True, "prior_revision": 1, "current_revision": 1, "declared_claims": ["continuity"], "declared_from": 1, "claim": "continuity",
    }
    schema = "prior_rule string, current_rule string, prior_engine string, current_engine string, prior_source_identity string, current_source_identity string, prior_capabilities array<string>, current_capabilities array<string>, capabilities_available boolean, configuration_compatible boolean, prior_revision int, current_revision int, declared_claims array<string>, declared_from int, claim string"
    cases = [
        ({}, True, []), ({"current_revision": 2}, True, ["semantic-compatibility-declared"]), ({"current_revision": 2, "claim": "absence"}, False, ["semantic-revision-incomparable"]), ({"current_engine": "2"}, False, ["engine-incomparable"]),
        ({"current_source_identity": None}, False, ["source-identity-unavailable"]), ({"current_capabilities": ["a"]}, False, ["capabilities-incomparable"]), ({"capabilities_available": False}, False, ["capability-unavailable"]),
    ]
    for change, ok, reasons in cases:
        row = base | change
        got = lifecycle.semantic_comparison(spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)).first()
        assert (got.compatible, list(got.reasons)) == (ok, reasons), change
    rows = [(1, 10, 10, ["a"], ["a"], None), (2, 10, 20, ["a"], ["a"], ["maximum_bytes"]), (3, 20, 10, ["a"], ["a"], ["maximum_bytes"]), (4, 10, 20, ["a"], ["b"], ["maximum_bytes"]), (5, 10, 20, ["a"], ["a"], None)]
    pairs = spark.createDataFrame(rows, "k int, prior_maximum_bytes long, current_maximum_bytes long, prior_excludes array<string>, current_excludes array<string>, declared_dimensions array<string>")
    got = {r.k: (r.compatible, r.reason) for r in lifecycle.configuration_comparison(pairs, ("maximum_bytes", "excludes")).collect()}
    assert got == {
        1: (True, None), 2: (True, "configuration-compatibility-declared"), 3: (False, "configuration-compatibility-direction-blocked"),
        4: (False, "configuration-declaration-dimensions-mismatch"), 5: (False, "configuration-compatibility-not-declared"),
    }


def test_absence_and_relocation(spark):
    f = spark.createDataFrame([("a", False, False), ("b", True, True)], "finding string, partial boolean, omitted boolean")
    got = {r.finding: (r.verified, list(r.blockers)) for r in lifecycle.absence_blockers(f, {"scope-incomplete": "partial", "rule-omitted": "omitted"}).collect()}
    assert got == {"a": (True, []), "b": (False, ["rule-omitted", "scope-incomplete"])}
    start = spark.createDataFrame([("1", "a"), ("2", "z")], "id string, path string")
    ren = spark.createDataFrame([(1, "a", "b"), (2, "b", "c")], "position long, prior string, current string")
    gone = spark.createDataFrame([(3, "c")], "position long, prior string")
    assert {r.id: (r.path, r.outcome) for r in lifecycle.relocation(start, ren, gone).collect()} == {"1": ("c", "deleted"), "2": ("z", "unchanged")}


def test_functions_of_all_orders_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(o, rng.randrange(1, 200), rng.randrange(1, 120)) for o in (1, 2, 2999, 3000, 3001, 70_000, 600_000) for _ in range(9)]
    rows += [(3000, 5, 9), (3000, 5, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders, want = {}, {}
    for o, p, n in rows:
        parts = orders.setdefault(o, {})
        parts[p] = min(n, parts.get(p, n))
    for parts in orders.values():
        hits, code, lines = {}, {}, [p % 40 for p in parts]
        for p, n in parts.items():
            hits[p % 9], code[p % 60] = max(n % 2, hits.get(p % 9, 0)), max(n % 3, code.get(p % 60, 0))
        for p, n in parts.items():
            named = [(p % 5, q % 40, hits[q % 9]) for q in parts if p % 5 < 2 and q % 9 == n % 9]
            near = [(2, q % 40, hits[q % 9]) for q in parts if q % 40 == n % 60 and lines.count(q % 40) == 1]
            best = min([*named, *near, *([(3, n % 60, code[n % 60])] if n % 60 in code else [])], default=None)
            how = ("exactName", "dottedSuffix", "startLine", "executableLine")[best[0]] if best else "unmatchedEntity"
            state = "unavailable" if best is None else "measuredCoverage" if best[2] else "zeroCoverage"
            want[how, state] = want.get((how, state), 0) + 1
    assert {(r.strategy, r.state): r.entities for r in q_structure.coverage_functions(spark, str(tmp_path)).collect()} == want


def test_clumps_of_more_units_than_a_repository_has(spark, tmp_path, monkeypatch):
    ev = spark.range(60_000).select(F.col("id").alias("user_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("event_type"))
    ev.write.parquet(f"{tmp_path}/events.parquet")
    assert [(r["items"], r.support) for r in q_structure.closed_clumps(spark, str(tmp_path)).collect()] == [("a,b,c", 60_000)]
    short = mining.Mined(spark.createDataFrame([], "items array<string>, support long"), False, ["comparison-budget-exceeded"])
    monkeypatch.setattr(mining, "closed_itemsets", lambda *_, **__: short)
    with pytest.raises(ValueError, match="comparison-budget-exceeded"):
        q_structure.closed_clumps(spark, str(tmp_path))


def counted_comparisons(units, min_items, min_support):
    """What an enumeration spends that meets every candidate with every unit, then tests and closes it."""
    known = {frozenset(s) for _, s in units if len(s) >= min_items}
    todo, spent = list(known), 0
    while todo:
        c = todo.pop()
        for _, s in units:
            spent += 1
            made = c & set(s)
            if len(made) >= min_items and made not in known:
                known.add(made)
                todo.append(made)
    for c in known:
        spent += len(units)
        support = sum(c <= set(s) for _, s in units)
        spent += support if support >= min_support else 0
    return spent


def test_comparisons_are_those_of_the_enumeration(spark):
    rng = random.Random(12)
    units = [(str(i), sorted(rng.sample("abcdefgh", rng.randrange(1, 7)))) for i in range(16)]
    df = spark.createDataFrame(units, "unit string, items array<string>")
    spent = counted_comparisons(units, 3, 2)
    assert mining.closed_itemsets(df, max_comparisons=spent).complete
    assert mining.closed_itemsets(df, max_comparisons=spent - 1).issues == ["comparison-budget-exceeded"]
    free = mining.closed_itemsets(df, max_comparisons=None, max_units=None, max_groups=None)
    capped = mining.closed_itemsets(df)
    read = lambda m: {tuple(r["items"]): (r.support, tuple(r.units)) for r in m.groups.collect()}
    assert read(free) == read(capped) and all(len(u) == n for n, u in read(free).values())
    assert mining.closed_itemsets(df, max_units=15).issues == ["analysis-unit-budget-exceeded"]
    assert mining.closed_itemsets(df.limit(0)).groups.isEmpty()
