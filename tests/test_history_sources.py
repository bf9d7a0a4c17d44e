"""Version control, introduction search, cache dispositions and profiles."""

from __future__ import annotations

import subprocess

import pytest

from codeledger.operators import cache, introduction, rules
from codeledger.plans.profile import Profile
from codeledger.sources import git


@pytest.fixture
def repo(tmp_path):
    def run(*args):
        subprocess.run(["git", "-c", "user.name=ann", "-c", "user.email=a@x", "-C", str(tmp_path), *args], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "A.swift").write_text("let a = 1\nlet b = 2\nlet c = 3\n")
    (tmp_path / "Z.swift").write_text("gone\n")
    run("add", ".")
    run("commit", "-qm", "first")
    run("mv", "A.swift", "B.swift")
    run("rm", "-q", "Z.swift")
    run("commit", "-qm", "Fix the bug")
    return tmp_path


def test_git_tables(spark, repo):
    run = git.runner(str(repo))
    got = git.log(spark, run, ["B.swift"]).collect()
    assert [r.subject for r in sorted(got, key=lambda r: r.subject)] == ["Fix the bug", "first"] and {r.author_token for r in got} == {"ann"}
    assert git.blame(spark, run, ["B.swift"]).count() == 3
    snap = git.snapshot(spark, run)
    assert snap["clean"] and [tuple(r) for r in snap["renames"].collect()] == [("A.swift", "B.swift", 100)] and snap["deletions"].first().prior == "Z.swift"
    assert git.parents(spark, run).count() == 1
    assert [(r.path, r.content[:9]) for r in git.tree(spark, run, "HEAD~1").collect()] == [("A.swift", "let a = 1"), ("Z.swift", "gone\n")]
    with pytest.raises(RuntimeError):
        run(["nonsense"])


EDGES = [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", "r")]


def test_introduction_search(spark):
    e = spark.createDataFrame(EDGES, "child string, parent string")
    start = spark.createDataFrame([("d",)], "id string")
    full = introduction.search(e, start, 100)
    assert {r.id: r.depth for r in full["revisions"].collect()} == {"d": 0, "b": 1, "c": 1, "a": 2, "r": 3} and full["frontier"].count() == 0
    cut = introduction.search(e, start, 2)
    assert {r.id for r in cut["revisions"].collect()} == {"d", "b"} and [r.id for r in cut["frontier"].collect()] == ["c"]


def test_introduction_trace(spark):
    e = spark.createDataFrame(EDGES, "child string, parent string")

    def kind(**outcomes):
        rows = spark.createDataFrame(list(outcomes.items()), "revision string, outcome string")
        got = introduction.trace(e, rows, "d")
        return got["kind"], got["revision"]

    assert kind(b="present", c="absent", a="absent", r="absent") == ("exact", "b")
    assert kind(b="absent", c="absent") == ("exact", "d")
    assert kind(b="present", c="present", a="present") == ("bounded", "d")
    assert kind(b="present", c="absent", a="present", r="present") == ("exact", "r")
    assert kind(b="present", c="absent", a="incomplete") == ("bounded", "b")


def test_assessment(spark):
    revs = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("d", False)], "revision string, partial boolean")
    seen = spark.createDataFrame([("a",), ("d",), ("d",)], "revision string")
    got = {r.revision: (r.outcome, list(r.reasons)) for r in introduction.assess(revs, seen, {"historical-scope-incomplete": "partial"}).collect()}
    assert got == {"a": ("present", []), "b": ("incomplete", ["historical-scope-incomplete"]), "c": ("absent", []), "d": ("incomplete", ["historical-continuity-ambiguous"])}


def test_cache(spark):
    schema = "path string, module string, digest string, budget long, schema_version int, engine string"
    now = spark.createDataFrame([("a", "M", "1", 5, 1, "e"), ("b", "M", "2", 5, 1, "e"), ("c", "M", "3", 5, 1, "e")], schema)
    old = spark.createDataFrame([("a", "M", "1", 5, 1, "e"), ("b", "M", "x", 4, 1, "e"), ("z", "M", "3", 5, 1, "e")], schema)
    got = {r.path: (r.disposition, list(r.reasons)) for r in cache.dispositions(now, old).collect()}
    assert got == {"a": ("reused", []), "b": ("recomputed", ["content-changed", "incoming-budget-changed"]), "c": ("new", []), "z": ("removed", [])}


def test_profile_and_catalog(spark):
    p = Profile()
    with p.phase("graph"):
        pass
    assert p.table(spark).first().phase == "graph"
    assert rules.smell_catalog(spark).count() == 24
