"""Introductions, relocations, digest trees, the fact store, the pruning index, migrations and the audit,
each against brute force."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from codeledger.operators import audit, digest_tree, fact_store, introduction, lifecycle, reducer, relocation, vector_index, vectors
from codeledger.sources import artifacts

from test_reducer import case, frames, told


def walked(edges, outcome, frontier, start):
    """The trace of one revision, step by step."""
    at, steps, seen = start, 0, set()
    while True:
        if at in seen:
            return "bounded", start, 0, ["history-ancestry-incomplete"]
        seen.add(at)
        parents = sorted({p for c, p in edges if c == at})
        why = {"history-budget-exhausted" if p in frontier else "history-parent-missing" for p in parents if p not in outcome} | {"history-ancestry-incomplete" for p in parents if outcome.get(p) == "incomplete"}
        shown = [p for p in parents if outcome.get(p) == "present"]
        end = {"verified-repository-root"} if not parents else why or (set() if len(shown) == 1 else {"multiple-positive-parent-lineages"} if shown else {"verified-parent-absence"})
        if end:
            return "exact" if end & {"verified-repository-root", "verified-parent-absence"} else "bounded", at, steps, sorted(end | ({"positive-parent-followed"} if steps else set()))
        at, steps = shown[0], steps + 1


def test_all_introductions_equal_walks(spark):
    rng = random.Random(2)
    edges = [(k, k - 1) for k in range(1, 300)] + [(k, rng.randrange(k)) for k in range(20, 300, 17)] + [(400, 401), (401, 402), (402, 400)]
    seen = [(f, k, rng.choices(("present", "absent", "incomplete"), (60, 1, 1))[0]) for f in range(3) for k in [*range(300), 400, 401, 402] if rng.random() > 0.01]
    frontier = set(range(0, 300, 2))
    starts = [(f, k) for f, k, o in seen if o == "present"]
    got = introduction.trace_all(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame(seen, "finding long, revision long, outcome string"), spark.createDataFrame(starts, "finding long, revision long"), spark.createDataFrame([(k,) for k in frontier], "revision long"))
    rows = {(r.finding, r.start): (r.kind, r.revision, r.steps, list(r.reasons)) for r in got.collect()}
    for f, k in starts:
        assert rows[f, k] == walked(edges, {r: o for g, r, o in seen if g == f}, frontier, k), (f, k)
    assert len(rows) == len(starts) and max(r[2] for r in rows.values()) > 15


def followed(path, after, through, events):
    """One source along its line."""
    steps, state = 0, "unchanged"
    for at, prior, current in sorted(events, key=lambda e: (e[0], e[2] is not None, e[2] or "")):
        if prior == path and at > after and (through is None or at <= through):
            if current is None:
                return path, "deleted", steps
            path, after, steps, state = current, at, steps + 1, "relocated"
    return path, state, steps


def test_relocations_equal_walks(spark):
    rng = random.Random(6)
    renames = [(line, p, f"f{rng.randrange(6)}", f"f{rng.randrange(6)}") for line in range(3) for p in range(120) if rng.random() < 0.7]
    deletions = [(line, p, f"f{rng.randrange(6)}") for line in range(3) for p in range(0, 120, 23)]
    asked = [(i, rng.randrange(3), f"f{rng.randrange(7)}", rng.randrange(-1, 120), rng.choice((None, rng.randrange(120)))) for i in range(200)]
    got = relocation.trace_sources(spark.createDataFrame(asked, "id long, line long, path string, after long, through long"), spark.createDataFrame(renames, "line long, position long, prior string, current string"), spark.createDataFrame(deletions, "line long, position long, prior string"))
    rows = {r.id: (r.path, r.outcome, r.steps) for r in got.collect()}
    for i, line, path, after, through in asked:
        events = [(p, a, b) for n, p, a, b in renames if n == line] + [(p, a, None) for n, p, a in deletions if n == line]
        assert rows[i] == followed(path, after, through, events), i
    assert len({r[1] for r in rows.values()}) == 3


def test_ten_thousand_renames_of_one_source(spark):
    n = 10_000
    renames = spark.range(n).select(F.lit(0).alias("line"), F.col("id").alias("position"), F.concat(F.lit("f"), "id").alias("prior"), F.concat(F.lit("f"), F.col("id") + 1).alias("current"))
    asked = spark.createDataFrame([(1, 0, "f0", -1, None), (2, 0, "f0", -1, 4_321), (3, 0, "f7", 6, 7), (4, 0, "f7", 7, None)], "id long, line int, path string, after long, through long")
    got = {r.id: (r.path, r.outcome, r.steps) for r in relocation.trace_sources(asked, renames, renames.limit(0)).collect()}
    assert got == {1: (f"f{n}", "relocated", n), 2: ("f4322", "relocated", 4_322), 3: ("f8", "relocated", 1), 4: ("f7", "unchanged", 0)}


def test_coverage_of_relocations(spark):
    traced = spark.createDataFrame([(1, "w", "a/b.c", "relocated", 2), (2, "w", "a/b.c", "unchanged", 0), (3, "p", "a/b.c", "deleted", 0), (4, "p", "a/b.c", "relocated", 1), (5, "p", "x/b.c", "unchanged", 0), (6, "p", "a/no.c", "unchanged", 0)], "id long, scope string, path string, outcome string, steps long")
    scopes = spark.createDataFrame([("w", True), ("p", False)], "scope string, complete boolean")
    rules = lambda *p: spark.createDataFrame([("p", x) for x in p], "scope string, prefix string")
    got = {r.id: (list(r.blockers), list(r.proofs)) for r in relocation.relocation_coverage(traced, scopes, rules("a"), rules("a/no.c")).collect()}
    out, part = relocation.OUT_OF_SCOPE, relocation.INCOMPLETE
    assert got == {1: ([], [relocation.COVERED, relocation.RELOCATED]), 2: ([], []), 3: ([part, relocation.DELETED], []), 4: ([part, relocation.RELOCATED], []), 5: ([out, part], []), 6: ([out, part], [])}


def test_absence_takes_what_became_of_the_source(spark):
    findings = spark.createDataFrame([(k, "r", True) for k in "abc"], "id string, rule string, in_lineage boolean")
    empty = lambda schema: spark.createDataFrame([], schema)
    moved = spark.createDataFrame([("a", [], [relocation.COVERED, relocation.RELOCATED]), ("b", [relocation.INCOMPLETE, relocation.OUT_OF_SCOPE], [])], "id string, blockers array<string>, proofs array<string>")
    got = lifecycle.verified_absence(findings, True, spark.createDataFrame([("r",)], "rule string"), empty("rule string, source string, outcome string"), empty("rule string"), empty("id string"), empty("rule string, compatible boolean, reasons array<string>"), moved)
    rows = {r.id: (r.verified, list(r.reasons)) for r in got.collect()}
    assert rows == {"a": (True, sorted(["complete-comparable-absence", relocation.COVERED, relocation.RELOCATED])), "b": (False, sorted([relocation.INCOMPLETE, relocation.OUT_OF_SCOPE])), "c": (True, ["complete-comparable-absence"])}


def test_digest_tree(spark):
    rows = [(f"src/{k}", "M", f"text {k}") for k in range(700)]
    make = lambda r, parts=3: digest_tree.leaves(spark.createDataFrame(r, "path string, module string, content string").repartition(parts))
    whole = digest_tree.tree(make(rows))
    root = digest_tree.root_digest(whole)
    assert root == digest_tree.root_digest(digest_tree.tree(make(rows[::-1], 7)))
    assert whole.filter("level = 0").first().sources == 700 and whole.groupBy("level").agg(F.sum("sources").alias("n")).filter("n <> 700").isEmpty()
    up = whole.filter("level > 0").groupBy("level", F.expr("substring(prefix, 1, level - 1)")).agg(F.count("*").alias("n"))
    assert up.agg(F.max("n")).first()[0] <= digest_tree.FAN_OUT
    later = [("src/3", "M", "other"), *rows[4:], *rows[:3], ("src/new", "M", "x"), ("src/3b", None, None)]
    assert root != digest_tree.root_digest(digest_tree.tree(make(later)))
    assert {tuple(r) for r in digest_tree.changes(make(rows), make(later[:-3] + rows[1:2] + later[-2:])).collect()} == {("src/3", "changed"), ("src/2", "removed"), ("src/new", "added"), ("src/3b", "added")}
    assert digest_tree.changes(make(rows), make(rows)).isEmpty()
    assert digest_tree.tree(make(rows).limit(0)).count() == 1


def words(sources):
    """A parser: each word of a source is a unit."""
    return sources.select("path", F.posexplode(F.filter(F.split("content", " "), lambda x: x != "")).alias("ord", "payload")).select("path", F.lit("unit").alias("fact"), "ord", "payload")


def test_fact_store_equals_a_fresh_run(spark, tmp_path):
    schema = "path string, module string, content string"
    rows = [(f"p{k:02d}", "M", " ".join(f"w{k}{j}" for j in range(k % 4 + 1))) for k in range(20)] + [("q1", "M", "same text"), ("q2", "M", "same text"), ("q3", "M", None)]
    store = fact_store.FactStore(spark, str(tmp_path / "a"), words, ("unit",), 30)
    facts = lambda run: sorted(map(tuple, run.facts.collect()), key=str)
    first = store.run(spark.createDataFrame(rows, schema))
    assert (first.disposition, first.parsed) == ("cold-rebuild", 22) and len(facts(first)) == 30
    again = store.run(spark.createDataFrame(rows, schema))
    assert (again.disposition, again.parsed, again.reused, again.number) == ("warm-reuse", 0, 23, 1) and facts(again) == facts(first)
    edited = [(p, m, "new words here and more" if p == "p05" else t) for p, m, t in rows if p != "p17"] + [("p05b", "M", "w60 w61")]
    run = store.run(spark.createDataFrame(edited, schema))
    fresh = fact_store.FactStore(spark, str(tmp_path / "b"), words, ("unit",), 30).run(spark.createDataFrame(edited, schema))
    assert facts(run) == facts(fresh) and run.parsed == 2 and run.disposition == "partial-rebuild"
    left, want = 30, {"p17": "source-removed"}
    budget = {}
    for name, source in (("before", rows), ("after", edited)):
        left, budget[name] = 30, {}
        for p, _, t in sorted(source):
            budget[name][p] = left
            left = max(0, left - len((t or "").split()))
    for p in budget["after"]:
        if p == "p05":
            want[p] = "source-content-changed"
        elif p not in budget["before"]:
            want[p] = "source-added"
        elif budget["before"][p] != budget["after"][p]:
            want[p] = "dependency-changed"
    assert {r.path: r.reason for r in run.invalid.collect()} == want and "dependency-changed" in want.values()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_pruning_index_equals_the_scan(spark, tmp_path, metric):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 10) for _ in range(6)] for _ in range(12)]
    rows = [(k, [x + rng.gauss(0, 1) for x in centres[k % 12]], {"odd": str(k % 2)}) for k in range(600)]
    rows += [(600 + k, rows[k][1], {"odd": "0"}) for k in range(5)]  # ties
    df = spark.createDataFrame(rows, "id long, vector array<double>, metadata map<string,string>")
    index = vector_index.PivotIndex.build(df, str(tmp_path / "i"), metric)
    asked = df.filter("id % 50 = 0")
    key = lambda rs: sorted((r.query_id, r.id, round(r.distance, 9)) for r in rs)
    top, looked = index.nearest_to_each(asked, 7)
    assert key(top.collect()) == key(vectors.nearest_to_each(df, asked, 7, metric).collect())
    assert looked.agg(F.max("looked_at")).first()[0] < 300
    for q in (rows[0][1], [0.5] * 6):
        for wanted in (None, {"odd": "1"}):
            scan = vectors.nearest(vectors.with_metadata(df, wanted or {}), q, 9, metric)
            assert [tuple(r) for r in index.nearest(q, 9, wanted).collect()] == [tuple(r) for r in scan.collect()]
    with pytest.raises(vectors.Incomplete):
        vector_index.PivotIndex(spark, str(tmp_path / "i"), metric, maximum=10).nearest(rows[0][1], 3)


@pytest.mark.parametrize("bad", [[0.0, 0.0], [1.0], [float("nan"), 1.0]])
def test_corrupt_rows_are_refused_with_their_id(spark, tmp_path, bad):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (4, bad), (9, bad)], "id long, vector array<double>")
    for run in (
        lambda: vectors.nearest(df, [1.0, 0.0], 1, maximum=None), lambda: vectors.nearest(df, [1.0, 0.0], 1), lambda: vectors.nearest_to_each(df, df.filter("id = 1"), 1, "cosine"),
        lambda: vector_index.PivotIndex.build(df, str(tmp_path / "x"), "cosine"),
    ):
        with pytest.raises(vectors.Incomplete, match="corrupt row 4"):
            run()


SNAPSHOTS = [("s1", "L", 1, None), ("s2", "L", 2, "s1"), ("s3", "L", 3, "s2"), ("t1", "K", 1, None)]


def schema_one(**changes):
    snap = [{"id": i, "revision": "r", "scope": "repository", "engine": "1", "lineage": lineage, "sequence": n, "predecessor": p} for i, lineage, n, p in SNAPSHOTS]
    events = [{"finding": "f", "event_id": f"e{n}", "snapshot_id": f"s{n}", "kind": k, "position": n} for n, k in ((2, "observed"), (1, "opened"))]
    return {"schema_version": 1, "snapshots": snap, "processed": ["s1", "s2", "t1"], "heads": [{"lineage": "L", "snapshot_id": "s2", "sequence": 2}, {"lineage": "K", "snapshot_id": "t1", "sequence": 1}], "events": events, "detections": []} | changes


def loaded(spark, tmp_path, data):
    path = tmp_path / "artifact.json"
    path.write_text(json.dumps(data))
    return artifacts.load(spark, str(path))


def test_schema_one_passes_both_migrations(spark, tmp_path):
    t = loaded(spark, tmp_path, schema_one())
    assert {r.id: r.parent_id for r in t["snapshots"].collect()} == {"s1": None, "s2": "s1", "s3": "s2", "t1": None}
    assert {r.event_id: (r.basis, r.contract) for r in t["events"].collect()} == {"e1": (None, artifacts.LEGACY), "e2": ("e1", artifacts.LEGACY)}
    assert {r.id for r in t["processed"].collect()} == {"s1", "s2", "t1"}


@pytest.mark.parametrize(
    ("changes", "why"),
    [
        ({"edges": []}, "can't have the field"), ({"schema_version": 4}, "aren't supported"), ({"processed": ["s1", "t1", "s9"]}, "is unknown"), ({"processed": ["s1", "s3", "t1"]}, "before its predecessor"),
        ({"heads": [{"lineage": "L", "snapshot_id": "s1", "sequence": 1}, {"lineage": "K", "snapshot_id": "t1", "sequence": 1}]}, "last processed"),
        ({"snapshots": [*schema_one()["snapshots"], schema_one()["snapshots"][0]]}, "listed twice"),
    ],
)
def test_what_a_schema_cant_hold_is_refused(spark, tmp_path, changes, why):
    with pytest.raises(artifacts.InvalidArtifact, match=why):
        loaded(spark, tmp_path, schema_one(**changes))


def test_schemas_two_and_three(spark, tmp_path):
    two = {"schema_version": 2, "snapshots": [{"id": "s1", "revision": None, "scope": None, "engine": None}, {"id": "s2", "revision": None, "scope": None, "engine": None}], "edges": [{"child": "s2", "parent": "s1"}], "processed": ["s1"], "events": [{"finding": "f", "event_id": "e", "snapshot_id": "s1", "kind": "opened", "basis": None}], "detections": []}
    t = loaded(spark, tmp_path, two)
    assert {r.id: r.parent_id for r in t["snapshots"].collect()} == {"s1": None, "s2": "s1"} and t["events"].first().contract == artifacts.LEGACY
    with pytest.raises(artifacts.InvalidArtifact, match="two parents"):
        loaded(spark, tmp_path, two | {"edges": [*two["edges"], {"child": "s2", "parent": "s0"}]})
    three = two | {"schema_version": 3, "snapshots": [{**two["snapshots"][0], "parent_id": None}], "events": [{**two["events"][0], "contract": artifacts.CURRENT}]}
    three.pop("edges")
    assert loaded(spark, tmp_path, three)["events"].first().contract == artifacts.CURRENT


def test_an_audit_finds_a_planted_event_and_replays_its_branch_alone(spark):
    data = case(5, 6, 5)
    snapshots, detections, renames, proofs = frames(spark, *data)
    done = reducer.reduce_forest(snapshots, detections, renames, proofs)
    trusted = audit.chain_digests(snapshots, detections, done.events)
    wrong, replayed = audit.audit(snapshots, detections, done.events, renames, proofs, trusted, done.known)
    assert wrong.isEmpty() and replayed.isEmpty()
    victim = sorted(x for x in told(done) if x[1] == "s4")[0]
    hit = (F.col("finding") == victim[0]) & (F.col("snapshot") == "s4")
    planted = done.events.withColumn("kind", F.when(hit, "resolved" if victim[2] != "resolved" else "observed").otherwise(F.col("kind")))
    wrong, replayed = audit.audit(snapshots, detections, planted, renames, proofs, trusted, done.known)
    assert [(r.finding, r.snapshot_id, r.replayed_kind) for r in wrong.collect()] == [(victim[0], "s4", victim[2])]
    below, grown = {"s4"}, True
    while grown:
        more = below | {s for s, p in data[0] if p in below}
        grown, below = more != below, more
    assert {r.snapshot for r in replayed.collect()} == below
