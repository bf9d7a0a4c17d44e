"""Queries over metrics, scores and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..operators import metrics, scoring
from ..operators.shared import cut
from . import bindings as b

TYPES_SQL = """
fr as (
  select o_orderpriority module, o_orderkey k, o_orderstatus st, false ext, cast(floor(o_totalprice / 1000) as bigint) cl from orders
  union all select o_orderpriority, o_orderkey, o_orderstatus, true, 7 from orders where o_orderkey % 5 = 0
  union all select o_orderpriority, o_orderkey, o_orderstatus, false, cast(floor(o_totalprice / 1000) as bigint) from orders where o_orderkey % 100 = 1),
ty as (select module, k, sum(cl) code_lines, max(st) st from fr group by 1, 2 having count(*) filter (not ext) = 1),
fields as (select distinct l_orderkey k, cast(l_partkey % 20 as varchar) f from lineitem union select o_orderkey, 'x' from orders where o_orderkey % 5 = 0),
fn as (select o_orderpriority module, l_orderkey k, l_returnflag <> 'R' is_method, cast(l_quantity as bigint) cl, l_linenumber cx, l_suppkey % 14 pa, l_partkey % 20 r1, l_suppkey % 20 r2 from lineitem join orders on l_orderkey = o_orderkey),
own as (select fn.* from fn join ty using (module, k)),
"""


def _types(s, d):
    return metrics.merged_types(b.fragments(s, d))


def metric_types(s, d):
    return metrics.type_measures(_types(s, d), b.functions(s, d)).select("module", F.col("name").cast("long").alias("type_id"), "locc", "wmcc", "nomc", "nogc")


METRIC_TYPES = "with " + TYPES_SQL + """
g as (select k, count(*) n from fields group by 1),
o as (select module, k, sum(cx) wm, count(*) filter (is_method) nm from own group by 1, 2)
select ty.module, ty.k as type_id, cast(code_lines as bigint) locc, cast(coalesce(wm, 0) as bigint) wmcc, cast(coalesce(nm, 0) as bigint) nomc, cast(coalesce(g.n, 0) as bigint) nogc
from ty left join o on ty.module = o.module and ty.k = o.k left join g on g.k = ty.k
"""


def type_scope_classes(s, d):
    return metrics.merged_types(b.fragments(s, d), "classes").groupBy("module").agg(F.count("*").alias("types"), F.sum("code_lines").alias("code_lines"))


TYPE_SCOPE = "with " + TYPES_SQL + " z as (select 1) select module, count(*) types, cast(sum(code_lines) as bigint) code_lines from ty where st = 'F' group by 1"


def ambiguous_types(s, d):
    return metrics.ambiguous_types(b.fragments(s, d)).select("module", F.col("name").cast("long").alias("type_id"), "bases")


AMBIGUOUS = "with " + TYPES_SQL + " z as (select 1) select module, k as type_id, count(*) filter (not ext) as bases from fr group by 1, 2 having count(*) filter (not ext) > 1"


def metric_noav(s, d):
    types = _types(s, d)
    return metrics.noav(types, b.functions(s, d)).groupBy("module", F.col("owner").cast("long").alias("type_id")).agg(F.count("*").alias("callables"), F.sum("value").alias("total"), F.max("value").alias("most"))


NOAV = "with " + TYPES_SQL + """
x as (select own.*, (case when exists (select 1 from fields f where f.k = own.k and f.f = cast(r1 as varchar)) then 1 else 0 end)
  + (case when r1 <> r2 and exists (select 1 from fields f where f.k = own.k and f.f = cast(r2 as varchar)) then 1 else 0 end) v from own)
select module, k type_id, count(*) callables, cast(sum(v) as bigint) total, cast(max(v) as bigint) as most from x group by 1, 2
"""


def _couplings(s, d):
    li = b.t(s, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey") % 300).alias("source"), F.concat(F.lit("p"), F.col("l_suppkey") % 300).alias("target"))
    return metrics.coupling_edges(li)


def metric_nocc(s, d):
    return metrics.nocc(_couplings(s, d))


EDGES_SQL = "e as (select distinct least('p' || (l_partkey % 300), 'p' || (l_suppkey % 300)) a, greatest('p' || (l_partkey % 300), 'p' || (l_suppkey % 300)) b from lineitem where l_partkey % 300 <> l_suppkey % 300)"
NOCC = f"with {EDGES_SQL} select entity, count(*) as value from (select a entity from e union all select b from e) group by 1"


def _observed(s, d):
    """Long form of all metrics but clones (``summary_with_clones`` has those); an order is coupled
    with the next one."""
    types, fns = _types(s, d), b.functions(s, d)
    ids = types.select(F.concat_ws(".", "module", "name").alias("id"), F.col("name").cast("long").alias("k"))
    edges = ids.select(F.col("id").alias("source"), (F.col("k") + 1).alias("k")).join(ids.select(F.col("id").alias("target"), "k"), "k")
    none = fns.select("code_lines").limit(0)
    return metrics.observations(types, fns, metrics.coupling_edges(edges), none)


def metric_unpivot_summary(s, d):
    out = metrics.summary(_observed(s, d), {"NOMC": 4})
    return out.select("metric", "threshold", *[F.col(c).cast("long").alias(c) for c in ("observations", "violations", "paper_violations", "maximum", "total")])


SUMMARY_BODY = TYPES_SQL + """
obs as (
  select 'LOCC' metric, cast(code_lines as bigint) v from ty
  union all select 'WMCC', coalesce((select sum(cx) from own where own.module = ty.module and own.k = ty.k), 0) from ty
  union all select 'NOMC', coalesce((select count(*) from own where own.module = ty.module and own.k = ty.k and is_method), 0) from ty
  union all select 'NOGC', (select count(*) from fields f where f.k = ty.k) from ty
  union all select 'NOCC', (select count(*) from ty z where z.k = ty.k + 1 or z.k = ty.k - 1) from ty
  union all select 'NOAV', (case when exists (select 1 from fields f where f.k = own.k and f.f = cast(r1 as varchar)) then 1 else 0 end) + (case when r1 <> r2 and exists (select 1 from fields f where f.k = own.k and f.f = cast(r2 as varchar)) then 1 else 0 end) from own
  union all select 'LOCF', cl from fn union all select 'CCF', cx from fn union all select 'NOPF', pa from fn),
th(metric, threshold, paper) as (values ('LOCC', 500, 500), ('WMCC', 200, 200), ('NOMC', {nomc}, null), ('NOGC', null, null), ('NOCC', null, null), ('NOAV', null, null), ('LOCF', null, null), ('CCF', 20, 20), ('NOPF', 10, 10), ('DC', 10, 10)),
su as (select th.metric, cast(max(threshold) as bigint) threshold, count(v) observations, count(*) filter (v > threshold) violations,
  case when max(paper) is not null then count(*) filter (v > paper) end paper_violations, cast(max(v) as bigint) maximum, cast(coalesce(sum(v), 0) as bigint) total
  from th left join obs using (metric) group by 1)
"""
SUMMARY = "with " + SUMMARY_BODY.replace("{nomc}", "4") + " select * from su"


def paper_scores(s, d):
    base = cut(metrics.summary(_observed(s, d)))  # ten rows, scored once for each mode
    out = None
    for mode in policy.SCORING_MODES:
        one = metrics.table_scores(base, F.lit(5000), F.lit(2500), F.lit(900), F.lit(30), F.lit(4000), mode).select(F.lit(mode).alias("mode"), "metric", F.round("score", 9).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


PAPER = "with " + SUMMARY_BODY.replace("{nomc}", "null") + """,
raw as (select m.mode, metric, case
  when m.mode = 'none' then null
  when metric = 'DC' then 2 / ((case when m.mode = 'corrected' then 30.0 / 4000 else 30.0 * 4000 / 900 end) + 0.4)
  when observations = 0 then null
  when metric = 'LOCC' then 1000.0 / (maximum + 1500) when metric in ('NOMC', 'NOGC') then 500.0 / (maximum + 75)
  when metric = 'NOCC' then 1000.0 / (maximum + 150) when metric = 'LOCF' then 2000.0 / (maximum + 300)
  when metric = 'NOAV' then 2 / (5000.0 / 2500 + 0.4)
  when paper_violations = 0 then 5.0 else 2 / (cast(maximum as double) * paper_violations / total + 0.4) end s
  from su, (values ('none'), ('paper'), ('bounded'), ('corrected')) m(mode))
select mode, metric, round(cast(case when mode in ('bounded', 'corrected') then case when s is not null then least(5.0, greatest(0.0, s)) end else s end as double), 9) as score from raw
"""


def findings_by_metric(s, d):
    return metrics.findings(_observed(s, d), {"LOCC": 400, "NOPF": 12, "NOMC": 5}).groupBy("metric").agg(F.count("*").alias("findings"), F.sum("value").alias("total"))


FINDINGS = "with " + SUMMARY_BODY.replace("{nomc}", "null") + " select metric, count(*) findings, cast(sum(v) as bigint) total from obs where (metric = 'LOCC' and v > 400) or (metric = 'NOPF' and v > 12) or (metric = 'NOMC' and v > 5) group by 1"


def evidence_types(s, d):
    """Structural type evidence of every order, with the oversized-type row."""
    li = b.t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.sum("l_quantity").cast("long").alias("code_lines"), F.count("*").alias("method_count"), F.countDistinct("l_partkey").alias("property_count"), F.sum("l_linenumber").alias("wmcc"))
    rows = scoring.structural_evidence(li, "item", policy.TYPE_EVIDENCE).unionByName(scoring.oversized_type_evidence(li, "item"))
    return rows.groupBy("kind", "weight").agg(F.count("*").alias("items"), F.round(F.sum("normalized_score"), 6).alias("score"))


EVIDENCE_TYPES = """
with l as (select l_orderkey, cast(sum(l_quantity) as bigint) a, count(*) b, count(distinct l_partkey) c, sum(l_linenumber) d from lineitem group by 1),
s as (select least(100.0, a * 100.0 / 500) a, least(100.0, b * 100.0 / 30) b, least(100.0, c * 100.0 / 20) c, least(100.0, d * 100.0 / 200) d from l),
u as (select 'swift.type-lines' kind, a s from s union all select 'swift.method-count', b from s union all select 'swift.property-count', c from s
  union all select 'swift.weighted-method-complexity', d from s union all select 'swift.oversized-type', greatest(a, b, c, d) from s)
select kind, 1.0 as weight, count(*) items, round(cast(sum(s) as double), 6) score from u group by 1
"""


def evidence_hierarchy(s, d):
    """File (customer) and module (nation) evidence."""
    orders = b.t(s, d, "orders").select("o_orderkey", "o_custkey")
    li = b.t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"), F.count("*").alias("n"))
    per = orders.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.coalesce(F.sum("q"), F.lit(0)).alias("code_lines"), F.count("*").alias("type_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("callable_count"))
    files = per.withColumn("duplicate_lines", F.col("o_custkey") % 30)
    f = scoring.structural_evidence(files, "o_custkey", policy.FILE_EVIDENCE)
    mods = per.join(b.t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("code_lines").alias("code_lines"), F.count("*").alias("file_count"), F.sum("type_count").alias("type_count"), F.sum("callable_count").alias("callable_count"))
    m = scoring.structural_evidence(mods, "c_nationkey", policy.MODULE_EVIDENCE)
    return f.unionByName(m).groupBy("kind", "weight").agg(F.count("*").alias("items"), F.round(F.sum("normalized_score"), 6).alias("score"))


EVIDENCE_HIERARCHY = """
with l as (select l_orderkey, cast(sum(l_quantity) as bigint) q, count(*) n from lineitem group by 1),
f as (select o_custkey, coalesce(sum(q), 0) cl, count(*) tc, coalesce(sum(n), 0) cc, o_custkey % 30 dl from orders left join l on o_orderkey = l_orderkey group by 1),
m as (select c_nationkey, sum(cl) cl, count(*) fc, sum(tc) tc, sum(cc) cc from f join customer on o_custkey = c_custkey group by 1),
u as (select 'swift.file-lines' kind, 1.0 w, least(100.0, cl * 100.0 / 1000) s from f union all select 'swift.file-type-count', 0.5, least(100.0, tc * 100.0 / 20) from f
  union all select 'swift.file-callable-count', 0.5, least(100.0, cc * 100.0 / 80) from f union all select 'swift.duplicate-lines', 1.0, least(100.0, dl * 100.0 / 20) from f
  union all select 'swift.module-lines', 1.0, least(100.0, cl * 100.0 / 5000) from m union all select 'swift.module-file-count', 0.5, least(100.0, fc * 100.0 / 100) from m
  union all select 'swift.module-type-count', 0.5, least(100.0, tc * 100.0 / 100) from m union all select 'swift.module-callable-count', 0.5, least(100.0, cc * 100.0 / 400) from m)
select kind, cast(w as double) as weight, count(*) items, round(cast(sum(s) as double), 6) score from u group by 1, 2
"""


def evidence_callable(s, d):
    li = b.t(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), F.col("l_linenumber").alias("cognitive"), (F.col("l_suppkey") % 30).alias("complexity"), (F.col("l_partkey") % 7).alias("max_nesting"), F.col("l_quantity").alias("code_lines"), (F.col("l_suppkey") % 9).alias("parameters"))
    rows = scoring.structural_evidence(li, "item", policy.CALLABLE_EVIDENCE)
    return rows.groupBy("kind", "weight").agg(F.count("*").alias("items"), F.round(F.sum("normalized_score"), 6).alias("score"))


EVIDENCE_CALLABLE = """
with u as (select 'swift.cognitive-complexity' kind, 2.0 w, least(100.0, l_linenumber * 100.0 / 15) s from lineitem union all select 'swift.cyclomatic-complexity', 1.0, least(100.0, (l_suppkey % 30) * 100.0 / 20) from lineitem
  union all select 'swift.nesting-depth', 1.0, least(100.0, (l_partkey % 7) * 100.0 / 5) from lineitem union all select 'swift.function-lines', 0.5, least(100.0, l_quantity * 100.0 / 60) from lineitem
  union all select 'swift.parameter-count', 0.5, least(100.0, (l_suppkey % 9) * 100.0 / 6) from lineitem)
select kind, cast(w as double) weight, count(*) items, round(cast(sum(s) as double), 6) score from u group by 1, 2
"""


def functional_evidence(s, d):
    """Side effects and risks: events as facts of users."""
    ev = b.t(s, d, "events").select(F.col("user_id").alias("function"), F.element_at(F.create_map(*[F.lit(x) for kv in {"click": "mutation", "purchase": "propertyWrite", "error": "throwingEffect", "signup": "globalOrStaticState", "view": "asyncEffect"}.items() for x in kv]), F.col("event_type")).alias("category"))
    effects = scoring.effect_evidence(ev).select("function", F.col("category").alias("kind"), "n", "score")
    ri = b.t(s, d, "events").filter("value > 90").select(F.col("user_id").alias("function"), F.when(F.col("event_type") == "signup", "mutableSharedState").otherwise("unstructuredTask").alias("category"))
    return effects.unionByName(scoring.risk_evidence(ri).select("function", "kind", "n", "score"))


FUNCTIONAL = """
select user_id as "function", case event_type when 'click' then 'mutation' when 'purchase' then 'propertyWrite' when 'error' then 'throwingEffect' when 'signup' then 'globalOrStaticState' else 'asyncEffect' end as kind, count(*) n,
  cast(least(100.0, count(*) * (case event_type when 'purchase' then 1.5 when 'signup' then 2.0 else 1.0 end) * 12) as double) score from events group by user_id, event_type
union all select user_id, case when event_type = 'signup' then 'swift.shared-state.mutable' else 'swift.concurrency-risk.unstructuredTask' end, count(*),
  cast(least(100.0, count(*) * (case when event_type = 'signup' then 2.0 else 1.75 end) * 15) as double) from events where value > 90 group by user_id, event_type = 'signup', 2
"""


def api_risk(s, d):
    li = b.t(s, d, "lineitem").select((F.col("l_suppkey") % 9).alias("complexity"), (F.col("l_partkey") % 10).alias("parameters"), F.col("l_quantity").alias("code_lines"), F.when(F.col("l_returnflag") == "A", "public").otherwise("internal").alias("access_level"), (F.col("l_linenumber") % 3).alias("effect_kinds"))
    out = scoring.api_risk(li)
    return out.groupBy("access_level").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("parameter_surface", "public_boundary", "pattern_consistency")], F.count("public_boundary").alias("boundaries"))


API_RISK = """
with l as (select l_suppkey % 9 c, l_partkey % 10 p, l_quantity n, l_returnflag = 'A' pub, l_linenumber % 3 k from lineitem),
x as (select pub, case when p >= 6 then least(100.0, (p - 5) * 20) end a, 8 * c + 6 * p + 2 * greatest(0, n - 12) bo, least(100.0, 6 * c + 4 * p + 10 * k + 3 * greatest(0, n - 8)) pc from l)
select case when pub then 'public' else 'internal' end access_level, round(cast(sum(a) as double), 6) parameter_surface, round(cast(sum(case when pub and bo >= 40 then least(100.0, bo) end) as double), 6) public_boundary,
  round(cast(sum(pc) as double), 6) pattern_consistency, count(case when pub and bo >= 40 then 1 end) boundaries from x group by pub
"""


def _scored(s, d):
    return scoring.composite_scores(b.order_evidence(s, d), ["item_id", "file"])


def composite_score(s, d):
    out = _scored(s, d)
    return out.select("item_id", F.round("score", 6).alias("score"), F.round("base", 6).alias("base"), "configured_weight", "available_weight", "available_count", "unavailable_count", scoring.priority(F.round("score", 6)).alias("priority"))


_PRIO = "case when score >= 85 then 'critical' when score >= 70 then 'high' when score >= 40 then 'medium' when score is not null then 'low' end"
COMPOSITE = "with " + b.EVIDENCE_SQL + b.SCORE_SQL.replace("{k}", "item_id") + f"""
select item_id, round(score, 6) score, round(base, 6) base, cast(cw as double) configured_weight, cast(coalesce(aw, 0) as double) available_weight, av available_count, un unavailable_count,
  {_PRIO.replace('score', 'round(score, 6)')} priority from sc
"""


def score_contributions(s, d):
    out = scoring.contributions(b.order_evidence(s, d))
    return out.groupBy(F.substring_index("id", ":", -1).alias("kind")).agg(F.round(F.sum("effective_weight"), 5).alias("weight"), F.round(F.sum("contribution"), 4).alias("contribution"))


CONTRIBUTIONS = "with " + b.EVIDENCE_SQL + """
p as (select *, sum(w) over (partition by item_id) tw from ev where ok and kind not like 'coverage.%')
select kind, round(cast(sum(cast(w as double) / tw) as double), 5) weight, round(cast(sum(cast(w as double) / tw * s) as double), 4) contribution from p group by 1
"""


def rank_top(s, d):
    sc = _scored(s, d).select(F.col("item_id").alias("id"), F.round("score", 6).alias("score"))
    return scoring.limited(sc, top=50, head=100)


def rank_tail(s, d):
    sc = _scored(s, d).select(F.col("item_id").alias("id"), F.round("score", 6).alias("score"))
    return scoring.limited(sc, top=50, tail=25)


_SC = "with " + b.EVIDENCE_SQL + b.SCORE_SQL.replace("{k}", "item_id")
RANK_TOP = _SC + " select item_id as id, round(score, 6) score from sc order by round(score, 6) desc nulls last, item_id limit 50"
RANK_TAIL = _SC + " select item_id as id, round(score, 6) score from sc order by round(score, 6) asc nulls first, item_id desc limit 25"


def rank_page(s, d):
    sc = _scored(s, d).select(F.col("item_id").alias("id"), F.round("score", 6).alias("score"))
    return scoring.page(sc, 40, 20).withColumn("place", F.col("place").cast("long"))


RANK_PAGE = _SC + ", r as (select item_id as id, round(score, 6) score, row_number() over (order by round(score, 6) desc nulls last, item_id) place from sc) select * from r where place > 40 and place <= 60"


def filters(s, d):
    ev = b.order_evidence(s, d)
    kinds = ev.filter("state <> 'unavailable'").groupBy("item_id").agg(F.collect_set("kind").alias("kinds"))
    items = _scored(s, d).join(kinds, "item_id", "left").withColumn("level", F.when(F.col("item_id") % 2 == 0, "type").otherwise("file")).withColumn("priority", scoring.priority(F.col("score")))
    return scoring.filter_items(items, ["type"], ["git-history"], 50.0, "high").select("item_id", F.round("score", 6).alias("score"), "priority")


FILTERS = _SC + f"""
select item_id, round(score, 6) score, {_PRIO} priority from sc where item_id % 2 = 0 and score >= 70 and item_id in (select item_id from ev where ok and kind like 'git-history.%')
"""


def file_rollup(s, d):
    ev = b.order_evidence(s, d)
    sc = scoring.composite_scores(ev, ["item_id", "file"]).withColumn("score", F.round("score", 9))
    return scoring.roll_up(sc, ev.drop("file"), "file").select("file", F.round("score", 6).alias("score"), "members", "anchor")


FILE_ROLLUP = "with " + b.EVIDENCE_SQL + b.SCORE_SQL.replace("{k}", "item_id, file") + """,
bad as (select item_id, file, round(score, 9) s0 from sc where round(score, 9) >= 70),
p as (select bad.file, sum(case when ok and kind not like 'coverage.%' then w end) aw, sum(case when ok and kind not like 'coverage.%' then w * cast(s as double) end) ws, coalesce(product(case when ok and kind like 'coverage.%' then cast(s as double) / 100 end), 1) f
  from bad join ev using (item_id) group by 1),
h as (select file, count(*) members, first(item_id order by s0 desc, item_id) anchor from bad group by 1)
select file, round(ws / aw * f, 6) score, members, anchor from p join h using (file)
"""


def priority_counts(s, d):
    return scoring.priority_counts(_scored(s, d).withColumn("score", F.round("score", 6)))


PRIORITY_COUNTS = _SC + f" select coalesce({_PRIO.replace('score', 'round(score, 6)')}, 'unscored') priority, count(*) items from sc group by 1"


def max_score_gate(s, d):
    return scoring.over_maximum(_scored(s, d).select("item_id", F.round("score", 6).alias("score")), 75.0)


MAX_GATE = _SC + ", o as (select item_id, round(score, 6) s from sc where round(score, 6) > 75) select (select count(*) from o) violations, s worst_score, item_id worst_id from o order by s desc, item_id limit 1"


def search_items(s, d):
    parts = b.t(s, d, "part")
    return scoring.search(parts, "BRAND#1", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_brand")


SEARCH = "select p_partkey, p_brand from part where lower(p_name) like '%brand#1%' or lower(p_brand) like '%brand#1%' or lower(p_type) like '%brand#1%'"


def explain_items(s, d):
    return scoring.explain_items(b.order_evidence(s, d)).select("item_id", "category", F.substring_index("strongest_id", ":", -1).alias("strongest"), F.round("strongest_score", 6).alias("strongest_score"))


EXPLAIN = "with " + b.EVIDENCE_SQL + """
e as (select item_id, kind, cast(case when ok then s end as double) s from ev),
r as (select *, row_number() over (partition by item_id order by s desc nulls last, kind) rn from e)
select r.item_id, k.category, case when r.s is not null then r.kind end strongest, round(r.s, 6) strongest_score from r join (select item_id, split_part(min(kind), '.', 1) category from ev group by 1) k using (item_id) where rn = 1
"""

QUERIES = {
    "metric_types": (metric_types, METRIC_TYPES), "type_scope_classes": (type_scope_classes, TYPE_SCOPE), "ambiguous_types": (ambiguous_types, AMBIGUOUS), "metric_noav": (metric_noav, NOAV), "metric_nocc": (metric_nocc, NOCC),
    "metric_unpivot_summary": (metric_unpivot_summary, SUMMARY), "paper_scores": (paper_scores, PAPER), "findings_by_metric": (findings_by_metric, FINDINGS), "evidence_types": (evidence_types, EVIDENCE_TYPES),
    "evidence_hierarchy": (evidence_hierarchy, EVIDENCE_HIERARCHY), "evidence_callable": (evidence_callable, EVIDENCE_CALLABLE), "functional_evidence": (functional_evidence, FUNCTIONAL), "api_risk": (api_risk, API_RISK),
    "composite_score": (composite_score, COMPOSITE), "score_contributions": (score_contributions, CONTRIBUTIONS), "rank_top": (rank_top, RANK_TOP), "rank_tail": (rank_tail, RANK_TAIL), "rank_page": (rank_page, RANK_PAGE), "filters": (filters, FILTERS),
    "file_rollup": (file_rollup, FILE_ROLLUP), "priority_counts": (priority_counts, PRIORITY_COUNTS), "max_score_gate": (max_score_gate, MAX_GATE), "search_items": (search_items, SEARCH), "explain_items": (explain_items, EXPLAIN),
}
