"""Findings over time: snapshots, matching of detections, events and projections.

Candidates are the findings known before a snapshot, detections what the snapshot shows; both
have rule, source, line, column, subject_digest, decl_digest (null: no structural evidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .relocation import trace_sources
from .shared import cut, numbered

DETECTION = ["rule", "source", "line", "column", "subject_digest", "decl_digest"]


def candidate_pairs(candidates: DataFrame, detections: DataFrame) -> DataFrame:
    """(candidate, detection): equal rule, and equal subject or equal declaration digest, or no
    complete evidence on either side.  A union of equi-joins: an OR would be a nested loop."""
    c = candidates.select(F.col("id").alias("candidate"), "rule", "subject_digest", "decl_digest")
    d = detections.select(F.col("id").alias("detection"), "rule", "subject_digest", "decl_digest")
    by_subject = c.filter("decl_digest is not null").drop("decl_digest").join(d.drop("decl_digest"), ["rule", "subject_digest"])
    by_decl = c.drop("subject_digest").join(d.drop("subject_digest"), ["rule", "decl_digest"])
    odd_c = c.filter("decl_digest is null or subject_digest is null").select("candidate", "rule").join(d.select("detection", "rule"), "rule")
    odd_d = d.filter("decl_digest is null or subject_digest is null").select("detection", "rule").join(c.select("candidate", "rule"), "rule")
    out = by_subject.select("candidate", "detection")
    for other in (by_decl, odd_c, odd_d):
        out = out.unionByName(other.select("candidate", "detection"))
    return out.distinct()


def relations(candidates: DataFrame, detections: DataFrame, renames: DataFrame | None = None, compatible: Column | None = None) -> DataFrame:
    """(candidate, detection, relation, reasons): supported, ambiguous or unverified; pairs
    without any relation have no row.  ``renames``: prior, current."""
    pairs = candidate_pairs(candidates, detections)
    c = candidates.select(F.col("id").alias("candidate"), F.col("source").alias("ps"), F.col("line").alias("pl"), F.col("column").alias("pc"), F.col("subject_digest").alias("psd"), F.col("decl_digest").alias("pdd"))
    d = detections.select(F.col("id").alias("detection"), F.col("source").alias("cs"), F.col("line").alias("cl"), F.col("column").alias("cc"), F.col("subject_digest").alias("csd"), F.col("decl_digest").alias("cdd"))
    full = pairs.join(c, "candidate").join(d, "detection")
    if renames is not None:
        moved = renames.select(F.col("prior").alias("ps"), F.col("current").alias("cs")).distinct().withColumn("renamed", F.lit(True))
        full = full.join(moved, ["ps", "cs"], "left").withColumn("renamed", F.coalesce("renamed", F.lit(False)))
    else:
        full = full.withColumn("renamed", F.lit(False))
    evidence = F.col("pdd").isNotNull() & F.col("cdd").isNotNull() & F.col("psd").isNotNull() & F.col("csd").isNotNull()
    subject, decl, here = F.col("psd") == F.col("csd"), F.col("pdd") == F.col("cdd"), F.col("ps") == F.col("cs")
    moved_here = (F.col("pl") != F.col("cl")) | (F.col("pc") != F.col("cc"))
    ok = compatible if compatible is not None else F.lit(True)
    relation = (
        F.when(~ok, "unverified").when(~evidence, "ambiguous").when(subject & decl & (here | F.col("renamed")), "supported")
        .when(subject | decl, "ambiguous")
    )
    codes = F.filter(
        F.array(
            F.when(ok & ~evidence, "continuity-evidence-unavailable"),
            F.when(ok & evidence & subject & decl, "structural-anchor-match"),
            F.when(ok & evidence & subject & decl & here & moved_here, "source-location-moved"),
            F.when(ok & evidence & subject & decl & ~here & F.col("renamed"), "git-source-rename"),
            F.when(ok & evidence & decl & ~subject, "subject-changed-within-declaration"),
            F.when(ok & evidence & subject & ~decl, "enclosing-declaration-changed"),
            F.when(ok & evidence & ~here & ~(subject & decl & F.col("renamed")) & (subject | decl), "cross-file-move-uncorroborated"),
            F.when(~ok, "semantics-incomparable"),
        ),
        lambda r: r.isNotNull(),
    )
    return full.withColumn("relation", relation).filter("relation is not null").select("candidate", "detection", "relation", codes.alias("reasons"))


def divergence(candidates: DataFrame, detections: DataFrame, related: DataFrame) -> DataFrame:
    """Pairs of the same source and rule of which neither side has any other relation: an edit
    can't be ruled out, so they are ambiguous."""
    c = candidates.select(F.col("id").alias("candidate"), "rule", "source").join(related.select("candidate"), "candidate", "left_anti")
    d = detections.select(F.col("id").alias("detection"), "rule", "source").join(related.select("detection"), "detection", "left_anti")
    return c.join(d, ["rule", "source"]).select("candidate", "detection", F.lit("ambiguous").alias("relation"), F.array(F.lit("same-source-structural-divergence")).alias("reasons"))


def unique_matches(related: DataFrame) -> DataFrame:
    """Supported pairs that are the only relation of both their sides.  Degrees are aggregated
    and joined, so a side with very many relations is never gathered in one task."""
    one_c = related.groupBy("candidate").agg(F.count("*").alias("n")).filter("n = 1").select("candidate")
    one_d = related.groupBy("detection").agg(F.count("*").alias("n")).filter("n = 1").select("detection")
    return related.filter("relation = 'supported'").join(one_c, "candidate", "left_semi").join(one_d, "detection", "left_semi").select("candidate", "detection", "reasons")


def unresolved_groups(related: DataFrame, matched: DataFrame) -> DataFrame:
    """(root, candidates, detections, is_ambiguous, reasons): connected components of what isn't
    matched; root is the least node, candidates sort before detections."""
    rest = related.join(matched.select("candidate"), "candidate", "left_anti").join(matched.select("detection"), "detection", "left_anti")
    edges = rest.select(F.concat(F.lit("c:"), F.col("candidate").cast("string")).alias("u"), F.concat(F.lit("d:"), F.col("detection").cast("string")).alias("v"))
    roots = connected_components(edges)
    sides = roots.groupBy("root").agg(F.count_if(F.col("node").startswith("c:")).alias("candidates"), F.count_if(F.col("node").startswith("d:")).alias("detections"))
    tagged = rest.withColumn("node", F.concat(F.lit("c:"), F.col("candidate").cast("string"))).join(roots, "node")
    per = tagged.groupBy("root").agg(F.max(F.col("relation") == "ambiguous").alias("is_ambiguous"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))
    many = F.col("is_ambiguous") & ((F.col("candidates") > 1) | (F.col("detections") > 1))
    reasons = F.when(many, F.array_sort(F.array_union("reasons", F.array(F.lit("structural-assignment-not-unique"))))).otherwise(F.col("reasons"))
    return sides.join(per, "root").select("root", "candidates", "detections", "is_ambiguous", reasons.alias("reasons"))


def new_and_absent(candidates: DataFrame, detections: DataFrame, related: DataFrame) -> DataFrame:
    """(id, side): detections without any relation are new, candidates without are absent."""
    new = detections.select(F.col("id").alias("detection")).join(related.select("detection"), "detection", "left_anti").select(F.col("detection").cast("string").alias("id"), F.lit("new").alias("side"))
    gone = candidates.select(F.col("id").alias("candidate")).join(related.select("candidate"), "candidate", "left_anti").select(F.col("candidate").cast("string").alias("id"), F.lit("absent").alias("side"))
    return new.unionByName(gone)


class Reconciled(dict):
    """The outcomes of one snapshot by name; the components of unresolved groups are found when they are
    asked for."""

    def __missing__(self, name: str) -> DataFrame:
        if name != "groups":
            raise KeyError(name)
        self[name] = unresolved_groups(self["relations"], self["matches"])
        return self[name]


def reconcile(candidates: DataFrame, detections: DataFrame, renames: DataFrame | None = None) -> dict[str, DataFrame]:
    """All outcomes of one snapshot: relations, matches, new_and_absent, and groups."""
    first = cut(relations(candidates, detections, renames))
    related = cut(first.unionByName(divergence(candidates, detections, first)))
    matched = cut(unique_matches(related))
    return Reconciled(relations=related, matches=matched, new_and_absent=new_and_absent(candidates, detections, related))


# --- snapshots as a forest -----------------------------------------------------------------


def heads(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Snapshots that are no other's parent."""
    return nodes.join(edges.select(F.col("parent").alias("id")), "id", "left_anti")


def ancestors(edges: DataFrame, start: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, ancestor, distance): every way up the forest (edges: child, parent), itself included.
    Paths double each round, so rounds grow with the logarithm of the depth."""
    hop = cut(edges.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")))
    reach = cut(start.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance")))
    for _ in range(most_rounds):
        more = reach.join(hop.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("up"), F.col("distance").alias("d")), "ancestor").select("id", F.col("up").alias("ancestor"), (F.col("distance") + F.col("d")).alias("distance"))
        grown = cut(reach.unionByName(more).distinct())
        if grown.count() == reach.count():
            return grown
        reach = grown
        twice = hop.join(hop.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("up"), F.col("distance").alias("d")), "ancestor").select("id", F.col("up").alias("ancestor"), (F.col("distance") + F.col("d")).alias("distance"))
        hop = cut(hop.unionByName(twice).distinct())
    raise RuntimeError("the snapshots have a cycle")


def pending(snapshots: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, state): processed if every ancestor is present up to a root, else pending.
    ``snapshots``: id, parent_id (null for a root).

    Pointer jumping: each snapshot keeps one pointer, which jumps twice as far in every round until
    it meets a root or a gap; rows don't grow with the depth."""
    edges = snapshots.filter("parent_id is not null").select("id", F.col("parent_id").alias("at"))
    present = snapshots.select(F.col("id").alias("at"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "pending")
    now = edges.join(present, "at", "left").select("id", F.when(F.col("there"), F.col("at")).alias("at"), state.alias("state"))
    now = cut(now.unionByName(snapshots.filter("parent_id is null").select("id", F.lit(None).cast(snapshots.schema["id"].dataType).alias("at"), F.lit("processed").alias("state"))))
    for _ in range(most_rounds):
        if now.filter("state is null").isEmpty():
            return now.select("id", "state")
        up = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("state").alias("known"))
        moved = now.filter("state is null").join(up, "at").select("id", F.when(F.col("known").isNull(), F.col("next")).alias("at"), F.col("known").alias("state"))
        now = cut(now.filter("state is not null").unionByName(moved))
    raise RuntimeError("the snapshots have a cycle")


def ingest(store: DataFrame, arriving: DataFrame, key: str = "id", content: str = "digest") -> DataFrame:
    """``arriving`` with outcome: recorded, already-present, or conflict (the same id with other
    content; never written).  Repeated rows of one delivery are recorded once."""
    once = arriving.groupBy(key).agg(F.min(content).alias(content), F.count_distinct(content).alias("__n"))
    old = store.select(key, F.col(content).alias("__old"))
    both = once.join(old, key, "left")
    state = F.when(F.col("__n") > 1, "conflict").when(F.col("__old").isNull(), "recorded").when(F.col("__old") == F.col(content), "already-present").otherwise("conflict")
    return both.select(key, content, state.alias("outcome"))


# --- events --------------------------------------------------------------------------------

#: Legal transitions: state before -> event -> state after.
STATES = {(None, "opened"): "open", ("open", "observed"): "open", ("open", "resolved"): "resolved", ("open", "unverified"): "open", ("open", "continuity-ambiguous"): "open", ("resolved", "reopened"): "open", ("resolved", "unverified"): "resolved", ("resolved", "continuity-ambiguous"): "resolved"}


def events_for(reconciled: dict[str, DataFrame], candidates: DataFrame, snapshot: str, absence_proven: DataFrame | None = None) -> DataFrame:
    """(finding, event_id, snapshot_id, kind): one event for each finding of a snapshot.
    ``candidates`` have id and state; ``absence_proven``: ids whose absence is verified."""
    state = candidates.select(F.col("id").cast("string").alias("finding"), "state")
    seen = reconciled["matches"].select(F.col("candidate").cast("string").alias("finding")).join(state, "finding").select("finding", F.when(F.col("state") == "resolved", "reopened").otherwise("observed").alias("kind"))
    opened = reconciled["new_and_absent"].filter("side = 'new'").select(F.concat(F.lit(f"finding:{snapshot}:"), "id").alias("finding"), F.lit("opened").alias("kind"))
    gone = reconciled["new_and_absent"].filter("side = 'absent'").select(F.col("id").alias("finding")).join(state.filter("state = 'open'"), "finding", "left_semi")
    if absence_proven is not None:
        proven = absence_proven.select(F.col("id").cast("string").alias("finding"), F.lit(True).alias("p")).distinct()
        gone = gone.join(proven, "finding", "left").select("finding", F.when(F.col("p"), "resolved").otherwise("unverified").alias("kind"))
    else:
        gone = gone.select("finding", F.lit("unverified").alias("kind"))
    open_pairs = reconciled["relations"].join(reconciled["matches"].select("candidate"), "candidate", "left_anti").select(F.col("candidate").cast("string").alias("finding")).distinct().select("finding", F.lit("continuity-ambiguous").alias("kind"))
    every = seen.unionByName(opened).unionByName(gone).unionByName(open_pairs)
    return every.select("finding", F.concat_ws(":", F.lit("event"), "finding", F.lit(snapshot), "kind").alias("event_id"), F.lit(snapshot).alias("snapshot_id"), "kind")


def current_state(events: DataFrame, position: str = "position") -> DataFrame:
    """(finding, state, last_kind, events): folded over the ordered events of each finding;
    state is ``illegal`` where a transition isn't allowed."""
    ordered = events.groupBy("finding").agg(F.array_sort(F.collect_list(F.struct(position, "event_id", "kind"))).alias("e"))
    step = F.create_map(*[F.lit(x) for (s, k), t in STATES.items() for x in (f"{s or '-'}>{k}", t)])
    fold = F.aggregate("e", F.lit("-"), lambda s, x: F.coalesce(F.try_element_at(step, F.concat(s, F.lit(">"), x["kind"])), F.lit("illegal")))
    return ordered.select("finding", fold.alias("state"), F.element_at("e", -1)["kind"].alias("last_kind"), F.size("e").cast("long").alias("events"))


def state_at(events: DataFrame, path: DataFrame, by: str = "finding") -> DataFrame:
    """(finding, kind, event_id): the last event on a path of snapshots (snapshot_id, position),
    of equal places the greatest event id.  Partial maxima, no window."""
    on = events.join(path, "snapshot_id")
    return on.groupBy(by).agg(F.max(F.struct("position", "event_id", "kind")).alias("m")).select(by, "m.kind", "m.event_id")


def absence_blockers(findings: DataFrame, flags: dict[str, str]) -> DataFrame:
    """``findings`` with blockers (codes whose column of ``flags`` is true) and verified."""
    codes = F.array_sort(F.filter(F.array(*[F.when(F.col(c), F.lit(code)) for code, c in flags.items()]), lambda x: x.isNotNull()))
    return findings.withColumn("blockers", codes).withColumn("verified", F.size(codes) == 0)


#: Why absence isn't verified, and the one reason why it is.
ABSENCE_REASONS = ("lineage-incomparable", "scope-incomplete", "rule-omitted", "continuity-candidate-present", "continuity-unresolved")
ABSENCE_VERIFIED = "complete-comparable-absence"


def verified_absence(findings: DataFrame, complete_scope: bool, rules: DataFrame, results: DataFrame, detections: DataFrame, unresolved: DataFrame, comparisons: DataFrame, relocations: DataFrame | None = None) -> DataFrame:
    """(id, verified, reasons): whether one snapshot proves that a finding is gone.

    ``findings``: id, rule, in_lineage; ``rules``: the snapshot's rules; ``results``: rule, source,
    outcome; ``detections``: rule; ``unresolved``: id; ``comparisons``: rule, compatible, reasons (of the
    rule then and now); ``relocations`` (of :func:`relocation.relocation_coverage`): id, blockers, proofs of
    what became of its source.  Verified only if no reason stands against it; reasons are distinct and sorted."""
    ran = rules.select("rule").distinct().withColumn("__ran", F.lit(True))
    bad = results.filter("outcome <> 'committed'").groupBy("rule").agg(F.collect_set(F.concat(F.lit("atomic-observation-"), "outcome")).alias("__atomic"))  # a few outcomes
    seen = detections.select("rule").distinct().withColumn("__seen", F.lit(True))
    unclear = unresolved.select("id").distinct().withColumn("__unclear", F.lit(True))
    other = comparisons.filter(~F.col("compatible")).select("rule", F.col("reasons").alias("__other"))
    full = findings.select("id", "rule", "in_lineage").join(ran, "rule", "left").join(bad, "rule", "left").join(seen, "rule", "left").join(other, "rule", "left").join(unclear, "id", "left")
    none = F.array().cast("array<string>")
    if relocations is None:
        full = full.withColumn("__blockers", none).withColumn("__proofs", none)
    else:
        full = full.join(relocations.select("id", F.col("blockers").alias("__blockers"), F.col("proofs").alias("__proofs")), "id", "left")
    flags = (~F.coalesce("in_lineage", F.lit(False)), F.lit(not complete_scope), F.col("__ran").isNull(), F.col("__seen").isNotNull(), F.col("__unclear").isNotNull())
    codes = F.concat(F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in zip(flags, ABSENCE_REASONS, strict=True)]), lambda x: x.isNotNull()), F.coalesce("__atomic", none), F.when(F.col("__ran").isNotNull(), F.coalesce("__other", none)).otherwise(none), F.coalesce("__blockers", none))
    blockers = F.array_sort(F.array_distinct(codes))
    return full.select("id", (F.size(blockers) == 0).alias("verified"), F.when(F.size(blockers) == 0, F.array_sort(F.array_union(F.array(F.lit(ABSENCE_VERIFIED)), F.coalesce("__proofs", none)))).otherwise(blockers).alias("reasons"))


#: What narrows a snapshot's scope, by the flag that says so.
LIMITATIONS = {
    "one_file": "one explicit source file was selected", "manifest": "an explicit source manifest was selected", "exclusions": "configured exclusions narrowed source coverage", "skipped_links": "symbolic-link entries were not followed",
    "skipped_package": "Package.swift was excluded from source coverage", "skipped_directories": "source directories were skipped by discovery policy", "below_root": "the analysis root is below the Git repository root", "no_repository": "a Git repository boundary was unavailable",
}


def scope_of(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` (with the flags of LIMITATIONS) with scope (repository or partial) and message."""
    said = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(text)) for c, text in LIMITATIONS.items()]), lambda x: x.isNotNull())
    return snapshots.withColumn("scope", F.when(F.size(said) == 0, "repository").otherwise("partial")).withColumn("message", F.when(F.size(said) > 0, F.concat(F.array_join(said, "; "), F.lit("."))))


def place(arriving: DataFrame, store: DataFrame) -> DataFrame:
    """(id, placement, predecessor): where a snapshot belongs in a store's lineage.

    ``arriving``: id, revision (null: no version control), clean, parents (array); ``store``: id,
    revision, clean, processed.  existing, root (of an empty store), successor, or why it can't be
    placed: unversioned, dirty, revision-known, parent-missing, merge, parent-not-unique."""
    known = store.select("id", F.lit(True).alias("__known"))
    same = store.filter("revision is not null").select("revision").distinct().withColumn("__same", F.lit(True))
    parents = store.filter("processed and clean and revision is not null").groupBy(F.col("revision").alias("__parent")).agg(F.count("*").alias("__n"), F.min("id").alias("__at"))
    empty = store.isEmpty()
    full = arriving.withColumn("__parent", F.when(F.size("parents") == 1, F.col("parents")[0])).join(known, "id", "left").join(same, "revision", "left").join(parents, "__parent", "left")
    dirty = F.col("revision").isNotNull() & ~F.coalesce("clean", F.lit(False))
    first = F.when(dirty, "dirty").otherwise("root")
    later = (
        F.when(F.col("revision").isNull(), "unversioned").when(dirty, "dirty").when(F.col("__same"), "revision-known").when(F.size("parents") == 0, "parent-missing").when(F.size("parents") > 1, "merge")
        .when(F.coalesce("__n", F.lit(0)) != 1, "parent-not-unique").otherwise("successor")
    )
    where = F.when(F.col("__known"), "existing").otherwise(first if empty else later)
    return full.select("id", where.alias("placement"), F.when(where == "successor", F.col("__at")).alias("predecessor"))


def relocation(start: DataFrame, renames: DataFrame, deletions: DataFrame) -> DataFrame:
    """(id, path, outcome): where a source went along ordered snapshots: renames (position,
    prior, current) and deletions (position, prior).  deleted, relocated or unchanged."""
    one = lambda df: df.withColumn("line", F.lit(0))
    asked = one(start.select("id", "path")).withColumn("after", F.lit(-1)).withColumn("through", F.lit(None).cast("long"))
    return trace_sources(asked, one(renames), one(deletions)).select("id", "path", "outcome")


def trace_introduction(observations: DataFrame) -> DataFrame:
    """(finding, introduced_at, kind): the first place of the last unbroken stretch of presence.

    ``observations``: finding, position, outcome (present, absent, incomplete) along one line of
    revisions.  exact if the place before is a proven absence or there is none; bounded if it is
    incomplete or missing in between; unavailable if the last observation isn't present."""
    last = observations.groupBy("finding").agg(F.max(F.struct("position", "outcome")).alias("m"), F.min("position").alias("first"))
    stop = observations.join(last.select("finding", F.col("m.position").alias("top")), "finding").filter("outcome <> 'present' and position <= top")
    stop = stop.groupBy("finding").agg(F.max(F.struct("position", "outcome")).alias("s"))
    after = observations.join(stop.select("finding", F.col("s.position").alias("b")), "finding", "left").filter("b is null or position > b").groupBy("finding").agg(F.min("position").alias("introduced_at"))
    full = last.join(stop, "finding", "left").join(after, "finding", "left")
    gap = F.col("s").isNotNull() & (F.col("introduced_at") - F.col("s.position") > 1)
    kind = F.when(F.col("m.outcome") != "present", "unavailable").when(gap, "bounded").when(F.col("s").isNull() | (F.col("s.outcome") == "absent"), "exact").otherwise("bounded")
    return full.select("finding", F.when(F.col("m.outcome") == "present", F.col("introduced_at")).alias("introduced_at"), kind.alias("kind"))


KIND_RANK = {"unavailable": 0, "bounded": 1, "exact": 2}


def best_conclusion(conclusions: DataFrame) -> DataFrame:
    """One conclusion for each finding: the greatest by (kind, attempt)."""
    rank = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])
    keep = [c for c in conclusions.columns if c != "finding"]
    return conclusions.groupBy("finding").agg(F.max_by(F.struct(*keep), F.struct(rank[F.col("kind")], "attempt")).alias("b")).select("finding", "b.*")


def semantic_comparison(pairs: DataFrame) -> DataFrame:
    """``pairs`` (columns of both sides as prior_* and current_*) with compatible and reasons.

    Compatible: same rule identity, equal engine, comparable sources, equal capabilities that are
    all available, compatible configuration, and the same revision or a declaration that lists
    the claim."""
    p, c = (lambda n: F.col(f"prior_{n}")), (lambda n: F.col(f"current_{n}"))
    same_revision = p("revision") == c("revision")
    declared = F.array_contains(F.coalesce("declared_claims", F.array().cast("array<string>")), F.col("claim")) & (F.col("declared_from") == p("revision"))
    checks = [
        (p("rule") != c("rule"), "rule-identity-incomparable"),
        (~p("engine").eqNullSafe(c("engine")), "engine-incomparable"),
        (p("source_identity").isNull() | c("source_identity").isNull(), "source-identity-unavailable"),
        (F.array_sort(p("capabilities")) != F.array_sort(c("capabilities")), "capabilities-incomparable"),
        (~F.col("capabilities_available"), "capability-unavailable"),
        (~F.col("configuration_compatible"), "configuration-compatibility-not-declared"),
        (~same_revision & ~F.coalesce(declared, F.lit(False)), "semantic-revision-incomparable"),
    ]
    reasons = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for bad, code in checks]), lambda x: x.isNotNull())
    good = F.when(~same_revision, F.array(F.lit("semantic-compatibility-declared"))).otherwise(F.array().cast("array<string>"))
    return pairs.withColumn("compatible", F.size(reasons) == 0).withColumn("reasons", F.when(F.size(reasons) == 0, good).otherwise(reasons))


def configuration_comparison(pairs: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """``pairs`` with changed (dimensions that differ), compatible and reasons: equal, or a
    declaration covers exactly what changed and allows the direction."""
    changed = F.filter(F.array(*[F.when(~F.col(f"prior_{d}").eqNullSafe(F.col(f"current_{d}")), F.lit(d)) for d in dimensions]), lambda x: x.isNotNull())
    given = F.coalesce("declared_dimensions", F.array().cast("array<string>"))
    exact = (F.size(F.array_except(changed, given)) == 0) & (F.size(F.array_except(given, changed)) == 0)
    shrunk = F.col("current_maximum_bytes") < F.col("prior_maximum_bytes") if "prior_maximum_bytes" in pairs.columns else F.lit(False)
    code = (
        F.when(F.size(changed) == 0, F.lit(None).cast("string")).when(F.col("declared_dimensions").isNull(), "configuration-compatibility-not-declared")
        .when(~exact, "configuration-declaration-dimensions-mismatch").when(F.coalesce(shrunk, F.lit(False)), "configuration-compatibility-direction-blocked").otherwise("configuration-compatibility-declared")
    )
    ok = (F.size(changed) == 0) | (code == "configuration-compatibility-declared")
    return pairs.withColumn("changed", changed).withColumn("compatible", ok).withColumn("reason", code)


def inventory(states: DataFrame, heads_: DataFrame) -> DataFrame:
    """(snapshot_id, state, findings) at each head.  ``states``: snapshot_id, finding, state."""
    return states.join(heads_.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi").groupBy("snapshot_id", "state").agg(F.count("*").alias("findings"))


def integrity_violations(detections: DataFrame, observed: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(snapshot_id, detection, times): detections not accounted for exactly once."""
    seen = observed.select("snapshot_id", "detection").unionByName(unresolved.select("snapshot_id", "detection")).groupBy("snapshot_id", "detection").agg(F.count("*").alias("times"))
    return detections.select("snapshot_id", F.col("id").alias("detection")).join(seen, ["snapshot_id", "detection"], "left").withColumn("times", F.coalesce("times", F.lit(0))).filter("times <> 1")


def replay_violations(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """(finding, snapshot_id, stored_kind, replayed_kind): events that a store has otherwise than its
    reconciliation gives them again (:func:`events_for`), or that only one of the two has."""
    keys = ["finding", "snapshot_id"]
    both = stored.select(*keys, F.col("kind").alias("stored_kind")).join(replayed.select(*keys, F.col("kind").alias("replayed_kind")), keys, "full")
    return both.filter(~F.col("stored_kind").eqNullSafe(F.col("replayed_kind")))


def numbered_detections(detections: DataFrame) -> DataFrame:
    """Detections of a snapshot with their id, in the order of place and rule."""
    return numbered(detections, ["source", "line", "column", "rule"]).withColumn("id", F.concat(F.lit("detection:"), F.col("number").cast("string")))
