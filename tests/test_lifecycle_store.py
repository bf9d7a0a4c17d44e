"""A history of analyses, from the command line to its events and introductions."""

from __future__ import annotations

import pytest

from codeledger.cli import main
from codeledger.plans import lifecycle_store
from codeledger.plans.lifecycle_store import LifecycleStore, Refused, Snapshot

FINDING = "finding:snapshot:r1:detection:1"
PLACES = "id string, rule string, source string, line long, column long, subject_digest string, decl_digest string"


def test_an_analysis_is_recorded_once(spark, tmp_path, capsys):
    root, store = tmp_path / "src", str(tmp_path / "history")
    root.mkdir()
    (root / "A.swift").write_text("func f() {\n  try! a()\n}\n")

    def record():
        assert main(["analyze", str(root), "--format", "compact", "--lifecycle-artifact", store, "--revision", "r1"]) == 0
        return capsys.readouterr().out.splitlines()[-1]

    assert record() == "snapshot:r1 recorded opened=1"
    version = LifecycleStore(spark, store).table.version()
    assert record() == "snapshot:r1 already-present " and LifecycleStore(spark, store).table.version() == version
    assert main(["lifecycle-infer-introduction", store]) == 0
    assert capsys.readouterr().out.split() == [FINDING, "exact", "snapshot:r1", "steps=0", "verified-repository-root"]
    assert main(["lifecycle-inspect", store, "snapshot:r1"]) == 0
    assert capsys.readouterr().out.strip().endswith(f"codeledger.force-try opened {FINDING}")


def test_snapshots_follow_one_another(spark, tmp_path):
    store = LifecycleStore(spark, str(tmp_path / "history"))
    seen = [("detection:1", "r.x", "A", 3, 1, "s", "d")]

    def record(name, detections, *parents, **more):
        rows = spark.createDataFrame(detections, PLACES)
        outcome, events = store.record(Snapshot(f"snapshot:{name}", rows, spark.createDataFrame([("r.x",)], "rule string"), name, parents, digest=str(detections), **more))
        return outcome, [(r.finding, r.kind) for r in events.collect()]

    assert record("r0", []) == ("recorded", [])
    assert record("r1", seen, "r0") == ("recorded", [(FINDING, "opened")])
    assert record("r2", [("detection:1", "r.x", "A", 9, 1, "s", "d")], "r1") == ("recorded", [(FINDING, "observed")])
    [row] = store.introductions().collect()
    assert (row.finding, row.kind, row.revision, row.steps, list(row.reasons)) == (FINDING, "exact", "snapshot:r1", 1, ["positive-parent-followed", "verified-parent-absence"])
    assert record("r1", seen, "r0") == ("already-present", [])
    with pytest.raises(Refused, match="other content"):
        record("r1", [], "r0")
    with pytest.raises(Refused, match="parent-not-unique"):
        record("r9", seen, "r7")
    with pytest.raises(Refused, match="dirty"):
        record("r8", seen, "r2", clean=False)
    assert record("r3", [], "r2", scope="partial") == ("recorded", [(FINDING, "unverified")])
    assert record("r4", [], "r3") == ("recorded", [(FINDING, "resolved")])
    assert record("r5", seen, "r4") == ("recorded", [(FINDING, "reopened")])
    assert [(r.id, r.kind) for r in store.inspect("snapshot:r5").collect()] == [("detection:1", "reopened")]
    assert lifecycle_store.KINDS.keys() == lifecycle_store.KEYS.keys() and store.table.version() == 6
