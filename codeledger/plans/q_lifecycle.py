"""Queries over findings, snapshots and events: the halves of a month as snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle
from ..operators.shared import cut
from . import bindings as b

def _side(s, d, current: bool):
    """The events of a half of the month as a snapshot; a finding's place is a user's day of it."""
    ev = b.t(s, d, "events").withColumn("day", F.dayofmonth("ts") - 1).filter(F.col("day") >= 15 if current else F.col("day") < 15)
    user, slot = F.col("user_id").cast("string"), F.col("day") % 15
    group = F.concat(user, F.lit("/"), F.floor(slot / 3).cast("string"))
    return ev.select(
        F.col("event_id").alias("id"), F.concat_ws("/", "event_type", user).alias("rule"), F.concat_ws("/", user, slot.cast("string")).alias("source"), F.hour("ts").alias("line"), F.minute("ts").alias("column"),
        F.concat(F.lit("s"), group, F.lit("/"), F.floor(F.col("value") / 25).cast("string")).alias("subject_digest"), F.when(F.col("event_id") % 29 != 0, F.concat(F.lit("d"), group)).alias("decl_digest"),
    )


def _renames(s, d):
    """Of every fourth user, a day's place becomes the next day's."""
    users = b.t(s, d, "events").select("user_id").distinct().filter("user_id % 4 = 0").select(F.col("user_id").cast("string").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(13))).alias("k"))
    return users.select(F.concat_ws("/", "u", F.col("k").cast("string")).alias("prior"), F.concat_ws("/", "u", (F.col("k") + 1).cast("string")).alias("current"))


SIDES_SQL = """
ev as (select event_id id, event_type || '/' || user_id r, user_id || '/' || ((day(ts) - 1) % 15) src, user_id u, (day(ts) - 1) % 15 k, hour(ts) l, minute(ts) c, user_id || '/' || ((day(ts) - 1) % 15 // 3) g, floor(value / 25) v, event_id, day(ts) - 1 dy from events),
e2 as (select id, r, src, u, k, l, c, 's' || g || '/' || cast(v as bigint) sd, case when event_id % 29 <> 0 then 'd' || g end dd, dy from ev),
pc as (select * from e2 where dy < 15), pd as (select * from e2 where dy >= 15),
pr as (select pc.id ca, pd.id de, pc.sd = pd.sd sm, pc.dd = pd.dd dm, pc.src = pd.src here, pc.l <> pd.l or pc.c <> pd.c moved, pc.u % 4 = 0 and pc.u = pd.u and pd.k = pc.k + 1 ren, pc.dd is not null and pd.dd is not null ok
  from pc join pd on pc.r = pd.r and (pc.sd = pd.sd or pc.dd = pd.dd or pc.dd is null or pd.dd is null)),
re as (select *, case when not ok then 'ambiguous' when sm and dm and (here or ren) then 'supported' when sm or dm then 'ambiguous' end rel from pr),
r1 as (select ca, de, rel, array_to_string(list_filter([case when not ok then 'continuity-evidence-unavailable' end, case when ok and sm and dm then 'structural-anchor-match' end, case when ok and sm and dm and here and moved then 'source-location-moved' end,
  case when ok and sm and dm and not here and ren then 'git-source-rename' end, case when ok and dm and not sm then 'subject-changed-within-declaration' end, case when ok and sm and not dm then 'enclosing-declaration-changed' end,
  case when ok and not here and not (sm and dm and ren) then 'cross-file-move-uncorroborated' end], lambda x: x is not null), ',') reasons from re where rel is not null),
dv as (select pc.id ca, pd.id de from pc join pd on pc.r = pd.r and pc.src = pd.src where pc.id not in (select ca from r1) and pd.id not in (select de from r1)),
rl as (select ca, de, rel, reasons from r1 union all select ca, de, 'ambiguous', 'same-source-structural-divergence' from dv),
ma as (select ca, de from rl where rel = 'supported' and ca in (select ca from rl group by 1 having count(*) = 1) and de in (select de from rl group by 1 having count(*) = 1))
"""


def _outcome(s, d):
    return lifecycle.reconcile(cut(_side(s, d, False)), cut(_side(s, d, True)), _renames(s, d))


def reconcile_relations(s, d):
    return _outcome(s, d)["relations"].select("candidate", "detection", "relation", F.array_join("reasons", ",").alias("reasons"))


RELATIONS = f"with {SIDES_SQL} select ca as candidate, de as detection, rel as relation, reasons from rl"


def reconcile_unique(s, d):
    return _outcome(s, d)["matches"].select("candidate", "detection")


UNIQUE = f"with {SIDES_SQL} select ca as candidate, de as detection from ma"


def reconcile_components(s, d):
    out = _outcome(s, d)["groups"]
    return out.select("root", "candidates", "detections", "is_ambiguous")


COMPONENTS = f"""
with recursive {SIDES_SQL}, ed as (select 'c:' || ca u, 'd:' || de v from rl where ca not in (select ca from ma) and de not in (select de from ma)),
bo as (select u, v from ed union select v, u from ed), w(n, r) as (select u, u from bo union select bo.v, w.r from w join bo on bo.u = w.n), ro as (select n, min(r) root from w group by 1)
select root, count(*) filter (n like 'c:%') candidates, count(*) filter (n like 'd:%') detections,
  coalesce(bool_or((select bool_or(rel = 'ambiguous') from rl where 'c:' || rl.ca = ro.n and rl.ca not in (select ca from ma) and rl.de not in (select de from ma))), false) is_ambiguous from ro group by 1
"""


def reconcile_new_absent(s, d):
    return _outcome(s, d)["new_and_absent"]


NEW_ABSENT = f"with {SIDES_SQL} select cast(id as varchar) id, 'new' as side from pd where id not in (select de from rl) union all select cast(id as varchar), 'absent' from pc where id not in (select ca from rl)"


def lifecycle_events(s, d):
    cands = _side(s, d, False).withColumn("state", F.when(F.col("id") % 3 == 0, "resolved").otherwise("open"))
    proven = cands.filter("id % 2 = 0").select("id")
    return lifecycle.events_for(_outcome(s, d), cands, "snap", proven).select("finding", "event_id", "kind")


EVENTS = f"""
with {SIDES_SQL}, e as (
  select cast(ca as varchar) finding, case when ca % 3 = 0 then 'reopened' else 'observed' end kind from ma
  union all select 'finding:snap:' || id, 'opened' from pd where id not in (select de from rl)
  union all select cast(id as varchar), case when id % 2 = 0 then 'resolved' else 'unverified' end from pc where id not in (select ca from rl) and id % 3 <> 0
  union all select cast(ca as varchar), 'continuity-ambiguous' from (select distinct ca from rl where ca not in (select ca from ma)))
select finding, 'event:' || finding || ':snap:' || kind event_id, kind from e
"""


def _log(s, d):
    """A finding per user and type; a day is a snapshot and gives one event at most."""
    ev = b.t(s, d, "events").groupBy(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("finding"), F.dayofmonth("ts").alias("position")).agg(F.max("value").alias("v"))
    kind = F.when(F.row_number().over(lifecycle_window()) == 1, "opened").when(F.col("v") > 60, "resolved").when(F.col("v") < 20, "reopened").otherwise("observed")
    return ev.withColumn("kind", kind).withColumn("event_id", F.concat_ws(":", "finding", "position")).withColumn("snapshot_id", F.col("position"))


def lifecycle_window():
    from pyspark.sql import Window

    return Window.partitionBy("finding").orderBy("position")


LOG_SQL = """lg as (select user_id || '/' || event_type finding, day(ts) p, max(value) v, row_number() over (partition by user_id || '/' || event_type order by day(ts)) n from events group by 1, 2),
ek as (select finding, p, case when n = 1 then 'opened' when v > 60 then 'resolved' when v < 20 then 'reopened' else 'observed' end kind, n from lg)"""


def finding_states(s, d):
    return lifecycle.current_state(_log(s, d)).select("finding", "state", "last_kind", "events")


FINDING_STATES = f"""
with recursive {LOG_SQL}, st(finding, n, s) as (select finding, n, 'open' from ek where n = 1 union all select e.finding, e.n, case
  when st.s = 'open' and e.kind in ('observed') then 'open' when st.s = 'open' and e.kind = 'resolved' then 'resolved' when st.s = 'resolved' and e.kind = 'reopened' then 'open' else 'illegal' end from st join ek e on e.finding = st.finding and e.n = st.n + 1)
select st.finding, s as state, ek.kind last_kind, st.n as events from st join ek using (finding, n) where st.n = (select max(n) from ek z where z.finding = st.finding)
"""


def finding_state_at(s, d):
    path = s.range(1, 16).select(F.col("id").cast("int").alias("snapshot_id"))
    return lifecycle.state_at(_log(s, d), path).select("finding", "kind")


STATE_AT = f"with {LOG_SQL} select finding, arg_max(kind, p) kind from ek where p between 1 and 15 group by 1"


def _forest(s, d):
    """Customers as snapshots: each one's parent is the half of its key."""
    return b.t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent_id"))


def snapshot_heads(s, d):
    f = _forest(s, d)
    return lifecycle.heads(f.filter("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("parent")), f.select("id"))


HEADS = "select c_custkey id from customer where c_custkey not in (select cast(floor(c_custkey / 2) as bigint) from customer where c_custkey > 1)"


def path_to_root(s, d):
    f = _forest(s, d)
    return lifecycle.ancestors(f.filter("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("parent")), f.select("id"))


PATHS = """
with recursive f as (select c_custkey id, case when c_custkey > 1 then cast(floor(c_custkey / 2) as bigint) end p from customer),
w(id, ancestor, distance) as (select id, id, cast(0 as bigint) from f union all select w.id, f.p, w.distance + 1 from w join f on f.id = w.ancestor where f.p is not null) select * from w
"""


def pending_snapshots(s, d):
    return lifecycle.pending(_forest(s, d).filter("id not in (5, 7, 40)"))


PENDING = """
with recursive f as (select c_custkey id, case when c_custkey > 1 then cast(floor(c_custkey / 2) as bigint) end p from customer where c_custkey not in (5, 7, 40)),
ok(id) as (select id from f where p is null union all select f.id from f join ok on f.p = ok.id) select id, case when id in (select id from ok) then 'processed' else 'pending' end as state from f
"""


def ingest_outcomes(s, d):
    old = b.t(s, d, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("digest"))
    new = b.t(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, "other").otherwise(F.col("p_brand")).alias("digest"))
    return lifecycle.ingest(old, new.unionByName(new)).groupBy("outcome").agg(F.count("*").alias("snapshots"))


INGEST = "select case when p_partkey % 3 = 0 then 'recorded' when p_partkey % 7 = 0 then 'conflict' else 'already-present' end outcome, count(*) snapshots from part group by 1"


def introduction_trace(s, d):
    ev = b.t(s, d, "events").groupBy("user_id", "event_type", F.dayofmonth("ts").alias("position")).agg(F.max("value").alias("v"))
    obs = ev.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("finding"), F.col("position").cast("long").alias("position"), F.when(F.col("v") > 80, "absent").when(F.col("v") > 70, "incomplete").otherwise("present").alias("outcome"))
    return lifecycle.trace_introduction(obs)


TRACE = """
with o as (select user_id || '/' || event_type finding, cast(day(ts) as bigint) p, case when max(value) > 80 then 'absent' when max(value) > 70 then 'incomplete' else 'present' end oc from events group by 1, 2),
l as (select finding, max(p) top, arg_max(oc, p) lo from o group by 1), s as (select finding, max(p) b, arg_max(oc, p) so from o where oc <> 'present' group by 1),
a as (select o.finding, min(p) i from o left join s on o.finding = s.finding where b is null or p > b group by 1)
select l.finding, case when lo = 'present' then i end introduced_at, case when lo <> 'present' then 'unavailable' when b is not null and i - b > 1 then 'bounded' when b is null or so = 'absent' then 'exact' else 'bounded' end kind
from l left join s on l.finding = s.finding left join a on a.finding = l.finding
"""


def integrity(s, d):
    det = b.t(s, d, "part").select((F.col("p_partkey") % 5).alias("snapshot_id"), F.col("p_partkey").alias("id"))
    obs = det.filter("id % 4 <> 0").select("snapshot_id", F.col("id").alias("detection"))
    unr = det.filter("id % 6 = 0").select("snapshot_id", F.col("id").alias("detection"))
    return lifecycle.integrity_violations(det, obs, unr)


INTEGRITY = "select p_partkey % 5 snapshot_id, p_partkey detection, cast((p_partkey % 4 <> 0) as int) + cast((p_partkey % 6 = 0) as int) times from part where cast((p_partkey % 4 <> 0) as int) + cast((p_partkey % 6 = 0) as int) <> 1"


def relocation(s, d):
    start = b.t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("f"), F.col("s_suppkey") % 20).alias("path"))
    ren = s.range(1, 6).select("id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")).filter("(k + id) % 6 = 0").select(F.col("id").alias("position"), F.concat(F.lit("f"), "k").alias("prior"), F.concat(F.lit("f"), (F.col("k") + 1) % 20).alias("current"))
    dele = s.createDataFrame([(6, "f3"), (6, "f11")], "position long, prior string")
    return lifecycle.relocation(start, ren, dele).groupBy("path", "outcome").agg(F.count("*").alias("sources"))


RELOCATION = """
with recursive k as (select unnest(generate_series(0, 19)) k), p as (select unnest(generate_series(1, 5)) p), st as (select p, 'f' || k prior, 'f' || ((k + 1) % 20) nxt from k, p where (k + p) % 6 = 0 union all select 6, 'f3', null union all select 6, 'f11', null),
w(id, path, a, o) as (select s_suppkey, 'f' || (s_suppkey % 20), cast(-1 as bigint), 'unchanged' from supplier
  union all select id, coalesce(nxt, path), p, case when nxt is null then 'deleted' else 'relocated' end from (select w.id, w.path, st.p, st.nxt, row_number() over (partition by w.id order by st.p) rn from w join st on st.prior = w.path and st.p > w.a where w.o <> 'deleted') where rn = 1),
f as (select id, arg_max(path, a) path, arg_max(o, a) o from w group by 1) select path, o as outcome, count(*) sources from f group by 1, 2
"""

QUERIES = {
    "reconcile_relations": (reconcile_relations, RELATIONS), "reconcile_unique": (reconcile_unique, UNIQUE), "reconcile_components": (reconcile_components, COMPONENTS), "reconcile_new_absent": (reconcile_new_absent, NEW_ABSENT), "lifecycle_events": (lifecycle_events, EVENTS),
    "finding_states": (finding_states, FINDING_STATES), "finding_state_at": (finding_state_at, STATE_AT), "snapshot_heads": (snapshot_heads, HEADS), "path_to_root": (path_to_root, PATHS), "pending_snapshots": (pending_snapshots, PENDING), "ingest_outcomes": (ingest_outcomes, INGEST),
    "introduction_trace": (introduction_trace, TRACE), "integrity_violations": (integrity, INTEGRITY), "relocation": (relocation, RELOCATION),
}
