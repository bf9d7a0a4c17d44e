"""The ordered reducer against a replay of one snapshot after the other."""

from __future__ import annotations

import random

import pytest

from codeledger.operators import reducer

FIELDS = "snapshot string, id string, rule string, source string, line long, column long, subject_digest string, decl_digest string, semantics string"


def forest(rng, n):
    """Snapshots with branches, a second root, and one chain that hangs on a missing parent."""
    out = [("s0", None), ("s1", "s0"), ("t0", None), ("x1", "gone"), ("x2", "x1")]
    for k in range(2, n):
        out.append((f"s{k}", f"s{rng.randrange(max(0, k - 3), k)}"))
    return out


def case(seed, n=9, per=7):
    rng = random.Random(seed)
    snapshots = forest(rng, n)
    some = lambda a, k: f"{a}{rng.randrange(k)}"
    detections = [
        (s, f"d{i}", some("r", 3), some("f", 3), rng.randrange(3), 0, rng.choice([some("s", 4), some("s", 4), None]), rng.choice([some("e", 3), some("e", 3), some("e", 3), None]), rng.choice(["a", "a", "a", "b"]))
        for s, _ in snapshots for i in range(rng.randrange(per))
    ]
    renames = [(s, some("f", 3), some("f", 3)) for s, _ in snapshots for _ in range(2)]
    proofs = [(s, some("r", 3)) for s, _ in snapshots for _ in range(2)]
    return snapshots, detections, renames, proofs


def replay(snapshots, detections, renames, proofs):
    """One snapshot after the other, pair by pair."""
    parent, known, events, unresolved = dict(snapshots), {}, set(), set()
    while True:
        at = next((s for s, p in snapshots if s not in known and (p is None or p in known)), None)
        if at is None:
            return known, events, unresolved
        findings = {f: dict(v) for f, v in known.get(parent[at], {}).items()}
        shown = {d[1]: dict(zip(("rule", "source", "line", "column", "subject", "decl", "is"), d[2:], strict=True)) for d in detections if d[0] == at}
        moved = {(p, c) for s, p, c in renames if s == at}
        pairs = {}
        for f, a in findings.items():
            for d, b in shown.items():
                if a["rule"] != b["rule"]:
                    continue
                whole = None not in (a["subject"], a["decl"], b["subject"], b["decl"])
                subject, decl = a["subject"] is not None and a["subject"] == b["subject"], a["decl"] is not None and a["decl"] == b["decl"]
                if not (subject and None not in (a["decl"],) or decl or None in (a["decl"], a["subject"], b["decl"], b["subject"])):
                    continue
                near = a["source"] == b["source"] or (a["source"], b["source"]) in moved
                relation = "ambiguous" if not whole else "supported" if subject and decl and near else "ambiguous" if subject or decl else None
                if relation:
                    pairs[f, d] = relation if a["is"] == b["is"] else "unverified"
        left, right = {f for f, _ in pairs}, {d for _, d in pairs}
        for f, a in findings.items():
            for d, b in shown.items():
                if f not in left and d not in right and (a["rule"], a["source"]) == (b["rule"], b["source"]):
                    pairs[f, d] = "ambiguous"
        many = lambda k, x: sum(p[k] == x for p in pairs)
        matched = {f: d for (f, d), r in pairs.items() if r == "supported" and many(0, f) == 1 and many(1, d) == 1}
        rest = {p: r for p, r in pairs.items() if p[0] not in matched}

        def clear(f):
            group, grown = {f}, True
            while grown:
                ds = {d for g, d in rest if g in group}
                more = {g for g, d in rest if d in ds}
                grown, group = more != group, more
            return any(r != "unverified" for (g, _), r in rest.items() if g in group)

        def event(f, kind, basis, d=None):
            events.add((f, at, kind, basis, d))
            return f"event:{f}:{at}:{kind}"

        for f, a in findings.items():
            if f in matched:
                kind = "observed" if a["state"] == "open" else "reopened"
                a["last"] = event(f, kind, a["last"], matched[f])
                a.update(shown[matched[f]], state="open")
            elif a["state"] != "open":
                continue
            elif any(g == f for g, _ in rest):
                a["last"] = event(f, "continuity-ambiguous" if clear(f) else "unverified", a["last"])
            elif (at, a["rule"]) in proofs and all(b["rule"] != a["rule"] for b in shown.values()):
                a["last"], a["state"] = event(f, "resolved", a["last"]), "resolved"
            else:
                a["last"] = event(f, "unverified", a["last"])
        for d, b in shown.items():
            if not any(e == d for _, e in pairs):
                f = f"finding:{at}:{d}"
                events.add((f, at, "opened", None, d))
                findings[f] = {**b, "state": "open", "last": f"event:{f}:opened"}
        unresolved |= {(at, d) for _, d in rest}
        known[at] = findings


def frames(spark, snapshots, detections, renames, proofs):
    return (
        spark.createDataFrame(snapshots, "id string, parent_id string"), spark.createDataFrame(detections, FIELDS),
        spark.createDataFrame(renames, "snapshot string, prior string, current string"), spark.createDataFrame(proofs, "snapshot string, rule string"),
    )


def told(r):
    return {tuple(x) for x in r.events.select("finding", "snapshot", "kind", "basis", "detection").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_equal_a_replay(spark, seed):
    data = case(seed)
    known, events, unresolved = replay(*data[:3], set(data[3]))
    got = reducer.reduce_forest(*frames(spark, *data))
    assert told(got) == events and len(events) > 40
    assert {tuple(x) for x in got.unresolved.collect()} == unresolved
    assert {(r.snapshot, r.finding, r.state, r.last_event) for r in got.known.collect()} == {(s, f, a["state"], a["last"]) for s, fs in known.items() for f, a in fs.items()}
    assert {r.id for r in got.pending.collect()} == {"x1", "x2"}


def test_a_later_delivery_goes_on_from_what_is_known(spark):
    data = case(3, 6, 5)
    snapshots, detections, renames, proofs = frames(spark, *data)
    whole = told(reducer.reduce_forest(snapshots, detections, renames, proofs))
    first = reducer.reduce_forest(snapshots.filter("id <> 's4' and id <> 's5' and id not like 'x%'"), detections, renames, proofs)
    later = reducer.reduce_forest(snapshots, detections, renames, proofs, known=first.known)
    assert told(first) | told(later) == whole and not told(first) & told(later)
    again = reducer.reduce_forest(snapshots, detections, renames, proofs, known=first.known.unionByName(later.known))
    assert again.events.isEmpty() and again.order.isEmpty()


def test_nothing_and_a_cycle(spark):
    empty = frames(spark, [], [], [], [])
    assert reducer.reduce_forest(*empty).events.isEmpty()
    alone = reducer.reduce_forest(spark.createDataFrame([("a", None)], "id string, parent_id string"), empty[1])
    assert alone.events.isEmpty() and [tuple(r) for r in alone.order.collect()] == [("a", None, 0)]
    with pytest.raises(RuntimeError):
        reducer.depths(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string"), 6)
