"""Queries over clones, names, graphs, coverage, history, comparison, mining and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clones, compare, coverage, graph, history, mining, resolve, rules, vectors
from ..sources import lcov
from . import bindings as b

# --- clones --------------------------------------------------------------------------------

_WIDTH = 3
LINES_SQL = """
ln as (select doc_id file, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) number from documents),
co as (select file, trim(line) sig, number, row_number() over (partition by file order by number) - 1 ord from ln where trim(line) <> ''),
wi as (select file, ord, sig, lead(sig, 1) over w s2, lead(sig, 2) over w s3 from co window w as (partition by file order by ord)),
se as (select a.file file1, b.file file2, a.ord i, b.ord - a.ord d from wi a join wi b on a.sig = b.sig and a.s2 = b.s2 and a.s3 = b.s3
  where a.s3 is not null and b.s3 is not null and (a.file < b.file or (a.file = b.file and b.ord - a.ord >= 3))),
isl as (select *, i - row_number() over (partition by file1, file2, d order by i) g from se),
ru as (select file1, file2, d, min(i) s, min(i) + count(*) + 2 stop from isl group by file1, file2, d, g),
bl as (select file1, s start1, file2, s + d start2, stop - s as lines from ru where file1 <> file2
  union all select file1, p, file2, p + d, least(stop - p, d) from (select *, unnest(generate_series(s, stop - 3, d - 2)) p from ru where file1 = file2))
"""


def clone_blocks(s, d):
    return clones.blocks(b.document_lines(s, d), _WIDTH, 50_000_000)


CLONE_BLOCKS = f"with {LINES_SQL} select file1, start1, file2, start2, lines from bl"


def clone_unique_lines(s, d):
    return clones.cloned_lines(b.document_lines(s, d), _WIDTH).groupBy("file").agg(F.count("*").alias("duplicate_lines"))


CLONE_UNIQUE = f"""with {LINES_SQL}, u as (select distinct file, ord from (select file1 file, unnest(generate_series(start1, start1 + lines - 1)) ord from bl union all select file2, unnest(generate_series(start2, start2 + lines - 1)) from bl))
select file, count(*) duplicate_lines from u group by 1"""


def clone_candidates(s, d):
    win = clones.windows(b.document_lines(s, d), _WIDTH)
    return win.groupBy("key").count().filter("count > 1").agg(F.count("*").alias("keys"), F.sum(F.col("count") * (F.col("count") - 1) / 2).cast("long").alias("pairs"))


CLONE_CANDIDATES = f"with {LINES_SQL}, k as (select count(*) n from wi where s3 is not null group by sig, s2, s3 having count(*) > 1) select count(*) keys, cast(sum(n * (n - 1) / 2) as bigint) pairs from k"


# --- names and graphs ----------------------------------------------------------------------


def resolve_refs(s, d):
    parts = b.t(s, d, "part").select("p_name", "p_brand", F.col("p_partkey").alias("target"))
    refs = b.t(s, d, "part").select(F.col("p_partkey").alias("ref"), F.when(F.col("p_partkey") % 10 == 0, F.concat(F.col("p_name"), F.lit("?"))).otherwise(F.col("p_name")).alias("p_name"), "p_brand")
    return resolve.resolve_by_key(refs, parts, "ref", ["p_name", "p_brand"], "target")


RESOLVE = """
with r as (select p_partkey ref, case when p_partkey % 10 = 0 then p_name || '?' else p_name end n, p_brand from part),
h as (select ref, count(t.p_partkey) c, min(t.p_partkey) t from r left join part t on t.p_name = r.n and t.p_brand = r.p_brand group by 1)
select ref, case when c = 1 then 'resolved' when c > 1 then 'ambiguous' else 'unresolved' end outcome, case when c = 1 then t end target, c candidates from h
"""


def resolve_types(s, d):
    """Supplier names referenced from nations: own module, then imported ones."""
    sup = b.t(s, d, "supplier")
    types = sup.select(F.col("s_nationkey").cast("string").alias("module"), F.concat(F.lit("T"), F.col("s_suppkey") % 13).alias("name"))
    refs = b.t(s, d, "customer").select(
        F.col("c_custkey").alias("ref_id"), F.col("c_nationkey").cast("string").alias("module"), F.concat(F.lit("T"), F.col("c_custkey") % 17).alias("name"), F.array().cast("array<string>").alias("scopes"),
        F.array(((F.col("c_nationkey") + 1) % 25).cast("string"), ((F.col("c_nationkey") + 2) % 25).cast("string")).alias("imports"),
    )
    return resolve.resolve_types(refs, types).select("ref_id", "outcome", "module", "name", "candidates")


RESOLVE_TYPES = """
with ty as (select distinct s_nationkey m, 'T' || (s_suppkey % 13) n from supplier),
r as (select c_custkey ref_id, c_nationkey m, 'T' || (c_custkey % 17) n from customer),
x as (select r.*, (select count(*) from ty where ty.m = r.m and ty.n = r.n) o, (select count(*) from ty where ty.n = r.n and ty.m in ((r.m + 1) % 25, (r.m + 2) % 25)) i,
  (select min(cast(ty.m as varchar)) from ty where ty.n = r.n and ty.m in ((r.m + 1) % 25, (r.m + 2) % 25)) im, (select count(*) from ty where ty.n = r.n) a from r)
select ref_id, case when o = 1 or i = 1 then 'resolved' when i > 1 or a > 1 then 'ambiguous' else 'unresolved' end outcome,
  case when o = 1 then cast(m as varchar) when i = 1 then im end as module, case when o = 1 or i = 1 then n end as name,
  cast(case when o = 1 then 1 when i > 0 then i when a > 1 then a else 0 end as bigint) candidates from x
"""


def _graph(s, d):
    li = b.t(s, d, "lineitem").join(b.t(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(b.t(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(b.t(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.select(
        F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"), F.when(F.col("l_linenumber") <= 4, "resolved").when(F.col("l_linenumber") == 5, "ambiguous").otherwise("unresolved").alias("confidence"),
        (F.col("c_nationkey") % 3 == 0).alias("is_test"),
    )


GRAPH_SQL = "g as (select c_nationkey source, s_nationkey target, case when l_linenumber <= 4 then 'resolved' when l_linenumber = 5 then 'ambiguous' else 'unresolved' end confidence from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"


def graph_coupling(s, d):
    return graph.coupling(_graph(s, d), "is_test").withColumn("instability", F.round("instability", 9))


GRAPH_COUPLING = f"""
with {GRAPH_SQL}, r as (select * from g where confidence = 'resolved'),
i as (select target id, count(*) a, count(distinct source) fi, count(distinct case when source % 3 = 0 then source end) ct from r group by 1), o as (select source id, count(*) e, count(distinct target) fo from r group by 1)
select coalesce(i.id, o.id) id, coalesce(a, 0) afferent, coalesce(e, 0) efferent, coalesce(fi, 0) fan_in, coalesce(fo, 0) fan_out, coalesce(ct, 0) callers_test, coalesce(fi, 0) - coalesce(ct, 0) callers_production,
  round(coalesce(e, 0) / cast(coalesce(a, 0) + coalesce(e, 0) as double), 9) instability from i full join o on i.id = o.id
"""


def graph_context(s, d):
    return graph.context(_graph(s, d))


GRAPH_CONTEXT = f"""
with {GRAPH_SQL}, r as (select distinct source, target from g where confidence = 'resolved'),
i as (select target id, count(*) n from r group by 1), o as (select source id, count(*) n from r group by 1)
select coalesce(i.id, o.id) id, coalesce(i.n, 0) fan_in, coalesce(o.n, 0) fan_out, coalesce(i.n, 0) callers, cast(least(100.0, 15 * coalesce(i.n, 0) + 10 * coalesce(o.n, 0)) as double) score from i full join o on i.id = o.id
"""


def graph_neighbours(s, d):
    return graph.neighbours(_graph(s, d))


GRAPH_NEIGHBOURS = f"""
with {GRAPH_SQL}, r as (select distinct source, target from g where confidence = 'resolved')
select source as id, 'upstream' as direction, target as neighbour from r union all select target, 'downstream', source from r
"""


def graph_stats(s, d):
    return graph.statistics(_graph(s, d))


GRAPH_STATS = f"with {GRAPH_SQL} select count(*) edges, count(*) filter (confidence = 'resolved') resolved, count(*) filter (confidence = 'ambiguous') ambiguous, count(*) filter (confidence = 'unresolved') unresolved from g"


def graph_dot(s, d):
    return graph.dot_lines(_graph(s, d).filter("confidence = 'ambiguous'"))


GRAPH_DOT = f"""with {GRAPH_SQL} select distinct '  "' || source || '" -> "' || target || '";' as line from g where confidence = 'ambiguous'"""


# --- coverage ------------------------------------------------------------------------------


def _line_hits(s, d):
    """Events as line hits: the file is the user, the line the event's minute of the day."""
    ev = b.t(s, d, "events")
    return ev.groupBy(F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".x")).alias("source_path"), (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("line")).agg(F.count_if(F.col("event_type") == "purchase").alias("hits")).withColumn("kind", F.lit("line_hits"))


HITS_SQL = "h as (select 'src/u' || user_id || '.x' source_path, cast(hour(ts) * 60 + minute(ts) as bigint) line, count(*) filter (event_type = 'purchase') hits from events group by 1, 2)"


def lcov_roundtrip(s, d):
    """Rendered as LCOV text, read back by the line protocol, and summed up."""
    text = lcov.render(_line_hits(s, d))
    back = lcov.records(lcov.lines_of(text, "source_path", "text"))
    return coverage.line_coverage(back, ["source_path"]).select("source_path", "covered", "total", F.round("percent", 6).alias("percent"))


LCOV = f"with {HITS_SQL} select source_path, count(*) filter (hits > 0) covered, count(*) total, round(count(*) filter (hits > 0) * 100.0 / count(*), 6) as percent from h group by 1"


def coverage_match(s, d):
    """Page urls as entity paths against records named by a suffix of them."""
    path = F.regexp_extract("url", r"://([^?#]*)", 1)
    pages = b.t(s, d, "pages")
    ents = pages.select(path.alias("path"))
    recs = pages.select(F.when(F.col("page_id") % 2 == 0, path).otherwise(F.regexp_replace(path, "^[^/]*/", "")).alias("source_path"), F.col("page_id").alias("record_order"))
    return coverage.match_paths(ents, recs.filter("source_path <> ''"))


COVERAGE_MATCH = r"""
with p as (select page_id, regexp_extract(url, '://([^?#]*)', 1) path from pages),
e as (select distinct path, trim(path, '/') n from p),
r as (select source_path, min(page_id) o, trim(source_path, '/') n from (select page_id, case when page_id % 2 = 0 then path else regexp_replace(path, '^[^/]*/', '') end source_path from p) where source_path <> '' group by 1),
m as (select e.path, r.source_path, r.o, case when e.n = r.n then 0 else 1 end prio from e join r on e.n = r.n or e.n like '%/' || r.n or r.n like '%/' || e.n),
b as (select *, row_number() over (partition by path order by prio, o, source_path) k from m)
select e.path, b.source_path matched, case b.prio when 0 then 'exact' when 1 then 'suffix' else 'missingFile' end strategy from e left join b on e.path = b.path and k = 1
"""


def coverage_function_rows(s, d):
    """Functions of an order by the four strategies; of a part that an order has twice, the least supplier."""
    li = b.t(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    src = F.concat(F.lit("o"), F.col("l_orderkey"))
    fn = li.select(src.alias("source_path"), F.lit("function").alias("kind"), (F.col("l_partkey") % 40).alias("line"), F.concat(F.lit("M.f"), F.col("l_partkey") % 9).alias("name"), F.lit(None).cast("long").alias("hits"))
    fh = li.select(src.alias("source_path"), F.lit("function_hits").alias("kind"), F.lit(None).cast("long").alias("line"), F.concat(F.lit("M.f"), F.col("l_partkey") % 9).alias("name"), (F.col("l_suppkey") % 2).alias("hits"))
    da = li.select(src.alias("source_path"), F.lit("line_hits").alias("kind"), (F.col("l_partkey") % 60).alias("line"), F.lit(None).cast("string").alias("name"), (F.col("l_suppkey") % 3).alias("hits"))
    ents = li.select(
        F.concat_ws(":", "l_orderkey", "l_partkey").alias("entity_id"), src.alias("source_path"),
        F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("M.f"), F.col("l_suppkey") % 9)).when(F.col("l_partkey") % 5 == 1, F.concat(F.lit("N.f"), F.col("l_suppkey") % 9)).otherwise(F.lit("other")).alias("name"), (F.col("l_suppkey") % 60).alias("line"),
    )
    m = coverage.match_functions(ents, fn.unionByName(fh).unionByName(da))
    return coverage.callable_coverage(m).select("entity_id", "strategy", "hits", "state", "score")


def coverage_functions(s, d):
    """How many functions each strategy matched."""
    return coverage_function_rows(s, d).groupBy("strategy", "state").agg(F.count("*").alias("entities"))


COVERAGE_FUNCTION_ROWS = """
with li as (select l_orderkey o, l_partkey p, min(l_suppkey) s from lineitem group by 1, 2),
en as (select o, p, o || ':' || p entity_id, case when p % 5 = 0 then 'M.f' || (s % 9) when p % 5 = 1 then 'N.f' || (s % 9) else 'other' end nm, s % 60 line from li),
h as (select o, 'M.f' || (p % 9) f, max(s % 2) hits from li group by 1, 2), fn as (select o, 'M.f' || (p % 9) f, p % 40 line from li),
kn as (select fn.*, coalesce(h.hits, 0) hits from fn left join h using (o, f)),
c as (select entity_id, 0 prio, kn.line fl, hits from en join kn on en.o = kn.o and en.nm = kn.f
  union all select entity_id, 1, kn.line, hits from en join kn on en.o = kn.o and split_part(en.nm, '.', -1) = split_part(kn.f, '.', -1)
  union all select entity_id, 2, k.line, k.hits from en join (select o, line, max(hits) hits from kn group by 1, 2 having count(*) = 1) k on en.o = k.o and en.line = k.line
  union all select entity_id, 3, k.line, k.hits from en join (select o, p % 60 line, max(s % 3) hits from li group by 1, 2) k on en.o = k.o and en.line = k.line),
r as (select *, row_number() over (partition by entity_id order by prio, fl, hits) n from c)
select en.entity_id, case r.prio when 0 then 'exactName' when 1 then 'dottedSuffix' when 2 then 'startLine' when 3 then 'executableLine' else 'unmatchedEntity' end strategy, r.hits,
  case when r.hits is null then 'unavailable' when r.hits > 0 then 'measuredCoverage' else 'zeroCoverage' end state, case when r.hits > 0 then 100.0 when r.hits = 0 then 0.0 end score
from en left join r on r.entity_id = en.entity_id and r.n = 1
"""
COVERAGE_FUNCTIONS = f"select strategy, state, count(*) entities from ({COVERAGE_FUNCTION_ROWS}) group by 1, 2"


# --- history -------------------------------------------------------------------------------

_AT = "2024-02-01 00:00:00"


def _commits(s, d):
    ev = b.t(s, d, "events")
    return ev.select(F.col("user_id").alias("path"), F.col("event_id").alias("sha"), F.get_json_object("props", "$.k").alias("author_token"), "ts", F.when(F.col("event_type") == "error", "Fix the error").otherwise(F.concat(F.lit("prefix "), "event_type")).alias("subject"))


def history_evidence(s, d):
    out = history.evidence(_commits(s, d), _AT, 60)
    return out.select("path", "changes", *[F.round(c, 6).alias(c) for c in ("frequency", "recency", "fix_share", "top_contributor_share")])


HISTORY = f"""
with r as (select *, row_number() over (partition by user_id order by ts desc, event_id) rn from events), k as (select user_id path, event_type, json_extract_string(props, '$.k') a, ts from r where rn <= 60),
t as (select path, max(n) top from (select path, a, count(*) n from k group by 1, 2) group by 1)
select k.path, count(*) changes, cast(least(100.0, count(*) * 20.0) as double) frequency,
  round(least(100.0, 100.0 / (1 + greatest(0, floor(epoch(timestamp '{_AT}' - max(k.ts)) / 86400)) / 30.0)), 6) recency,
  round(count(*) filter (event_type = 'error') * 100.0 / count(*), 6) fix_share, round(max(top) * 100.0 / count(*), 6) top_contributor_share
from k join t on k.path = t.path group by 1
"""


def blame_aged(s, d):
    """Returned lines as detections, blamed on the ship date; the head is a customer's last."""
    li = b.t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("r"), F.max("l_returnflag").alias("f"))
    blame = li.filter("l_orderkey % 11 <> 0 or l_linenumber <> 2").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("line"), F.date_format("r", "yyyy-MM-dd").alias("revision"))
    det = li.filter("f = 'R'").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("line"))
    return history.aged_detections(det, blame, "1996-03-01").select("source", "line", "revision", "outcome")


BLAME = """
with l as (select l_orderkey s, l_linenumber n, max(l_shipdate) r, max(l_returnflag) f from lineitem group by 1, 2), x as (select s, n, case when s % 11 <> 0 or n <> 2 then strftime(r, '%Y-%m-%d') end rev from l where f = 'R'),
m as (select s, count(*) filter (rev is null) c from x group by 1)
select s source, n line, rev revision, case when c > 0 then 'unsupported' else 'committed' end outcome from x join m using (s) where c > 0 or rev <> '1996-03-01'
"""


# --- comparison ----------------------------------------------------------------------------


def _report(s, d, later: bool):
    """Each year's customers; as the later side, under the year before it."""
    o = b.t(s, d, "orders").withColumn("y", F.year("o_orderdate"))
    first, last = o.agg(F.min("y"), F.max("y")).first()
    o = o.filter(F.col("y") > first if later else F.col("y") < last).withColumn("y", F.col("y") - int(later))
    return o.groupBy(F.concat_ws("/", F.col("y").cast("string"), F.col("o_custkey").cast("string")).alias("id")).agg(
        F.when(F.count("*") % 5 != 0, F.round(F.sum("o_totalprice") / 1000, 3)).alias("score"), F.max("o_orderpriority").alias("priority"), F.min("o_orderstatus").alias("location"), F.collect_set("o_orderstatus").alias("evidence"),
    )


REPORT_SQL = "g as (select year(o_orderdate) y, o_custkey k, case when count(*) % 5 <> 0 then round(sum(o_totalprice) / 1000, 3) end score, max(o_orderpriority) p, min(o_orderstatus) l, list_sort(list_distinct(list(o_orderstatus))) e from orders group by 1, 2), ra as (select y || '/' || k id, score, p, l, e from g where y < (select max(y) from g)), rb as (select (y - 1) || '/' || k id, score, p, l, e from g where y > (select min(y) from g))"
COMPARED_SQL = f"""{REPORT_SQL}, c as (select coalesce(a.id, b.id) id, case when a.id is null then 'added' when b.id is null then 'removed'
  when a.score is not distinct from b.score and a.p = b.p and a.l = b.l and a.e = b.e then 'unchanged' else 'changed' end status, a.score score_before, b.score score_after, round(b.score - a.score, 6) score_delta,
  array_to_string(list_sort(list_filter(coalesce(b.e, []), lambda x: not list_contains(coalesce(a.e, []), x))), ',') evidence_added, array_to_string(list_sort(list_filter(coalesce(a.e, []), lambda x: not list_contains(coalesce(b.e, []), x))), ',') evidence_removed
  from ra a full join rb b on a.id = b.id)"""


def _compared(s, d):
    return compare.compare_items(_report(s, d, False), _report(s, d, True), sets=("evidence",))


def compare_reports(s, d):
    out = _compared(s, d).withColumn("score_delta", F.round("score_delta", 6))
    return out.withColumn("evidence_added", F.array_join("evidence_added", ",")).withColumn("evidence_removed", F.array_join("evidence_removed", ","))


COMPARE = f"with {COMPARED_SQL} select * from c"


def validate_improvement(s, d):
    out = compare.validate_improvement(compare.comparison_summary(_compared(s, d)), 100.0)
    return out.select("added", "removed", "changed", "unchanged", *[F.round(c, 3).alias(c) for c in ("total_before", "total_after", "total_delta", "improvement")], "passed", "exit_status")


VALIDATE = f"""
with {COMPARED_SQL}, t as (select count(*) filter (status = 'added') added, count(*) filter (status = 'removed') removed, count(*) filter (status = 'changed') changed, count(*) filter (status = 'unchanged') unchanged,
  coalesce(sum(score_before), 0) b, coalesce(sum(score_after), 0) a from c)
select added, removed, changed, unchanged, round(b, 3) total_before, round(a, 3) total_after, round(a - b, 3) total_delta, round(b - a, 3) improvement, b - a >= 100 as passed, case when b - a >= 100 then 0 else 1 end exit_status from t
"""


def missing_evidence_delta(s, d):
    one = lambda later: _report(s, d, later).select("id", F.explode("evidence").alias("e")).select(F.concat_ws(":", "id", "e").alias("evidence"))
    return compare.missing_evidence_delta(one(False), one(True))


MISSING = f"""with {REPORT_SQL}, x as (select id || ':' || unnest(e) ev from ra), y as (select id || ':' || unnest(e) ev from rb)
(select ev as evidence, 'resolved' as change from (select ev from x except select ev from y)) union all (select ev, 'introduced' from (select ev from y except select ev from x))"""


def performance_gate(s, d):
    """Shipping modes as workloads: each brand's prices against the next year's."""
    p = b.t(s, d, "part").filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("k"), "p_brand", "p_size", "p_retailprice")
    q = b.t(s, d, "part").filter("p_partkey % 2 = 0").select((F.col("p_partkey") - 1).alias("k"), F.col("p_brand").alias("q_brand"), F.col("p_size").alias("q_size"), F.col("p_retailprice").alias("q_price"))
    same = {c: F.lit("x") for c in compare.WORKLOAD if c != "mode"}
    j = p.join(q, "k").select(
        "k", *[v.alias(f"base_{c}") for c, v in same.items()], *[v.alias(f"new_{c}") for c, v in same.items()], F.substring("p_brand", 1, 7).alias("base_mode"), F.substring("q_brand", 1, 7).alias("new_mode"), F.lit("g").alias("base_pair_id"), F.lit("g").alias("new_pair_id"),
        (F.col("p_retailprice") / 1000).alias("base_wall_s"), (F.col("q_price") / 1000).alias("new_wall_s"), (F.col("p_size") * 1000000).cast("long").alias("base_peak_bytes"), (F.col("q_size") * 1000000).cast("long").alias("new_peak_bytes"),
    )
    out = compare.performance_gate(j)
    return out.select("k", "comparable", "passed", F.round("wall_regression_percent", 6).alias("wall"), F.round("memory_regression_percent", 6).alias("memory"), "memory_regression_bytes", F.array_join("reasons", ";").alias("reasons"))


GATE = """
with j as (select p.p_partkey k, substr(p.p_brand, 1, 7) = substr(q.p_brand, 1, 7) c, p.p_retailprice / 1000 bw, q.p_retailprice / 1000 nw, p.p_size * 1000000 bm, q.p_size * 1000000 nm from part p join part q on q.p_partkey = p.p_partkey + 1 where p.p_partkey % 2 = 1),
x as (select *, (nw - bw) / bw * 100 w, cast(nm - bm as double) / bm * 100 m, greatest(0, nm - bm) mb from j), y as (select *, w > 10 and nw - bw > 0.01 sl, m > 15 and mb > 2097152 fa from x)
select k, c as comparable, c and not sl and not fa as passed, case when c then round(w, 6) end wall, case when c then round(m, 6) end memory, case when c then cast(mb as bigint) end memory_regression_bytes,
  case when not c then 'analysis mode differs' else concat_ws(';', case when sl then 'wall-clock' end, case when fa then 'peak-memory' end) end reasons from y
"""


# --- mining --------------------------------------------------------------------------------


def closed_clumps(s, d):
    ev = b.t(s, d, "events")
    units = ev.groupBy(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("unit")).agg(F.collect_set("event_type").alias("items"))
    got = mining.closed_itemsets(units, max_comparisons=None, max_units=None, max_groups=None, name_units=False)
    if not got.complete:
        raise ValueError(f"closed_clumps is incomplete: {', '.join(got.issues)}")
    return got.groups.select(F.array_join("items", ",").alias("items"), "support")


CLUMPS = """
with u as (select user_id, cast(ts as date) dy, list_distinct(list(event_type)) s from events group by 1, 2), w as (select * from u where len(s) >= 3),
names as (select list_sort(list(distinct event_type)) n from events), m as (select unnest(generate_series(1, 31)) k), c as (select k, list_filter(n, lambda x, i: (k >> (i - 1)) & 1 = 1) items from m, names),
sup as (select k, items, count(*) support from c join w on len(list_filter(items, lambda x: not list_contains(w.s, x))) = 0 where len(items) >= 3 group by 1, 2)
select array_to_string(items, ',') items, support from sup a where support >= 2 and not exists (select 1 from sup z where z.support = a.support and len(z.items) > len(a.items) and len(list_filter(a.items, lambda x: not list_contains(z.items, x))) = 0)
"""


def repeated_shapes(s, d):
    shape = b.t(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("shape"))
    return mining.repeated_shapes(shape, ["shape"], 2, "conv_id")


SHAPES = "with s as (select conv_id, string_agg(role, '>' order by turn, role) shape from conversations group by 1) select shape, count(*) occurrences, min(conv_id) as first from s group by 1 having count(*) >= 2"


def fact_budget(s, d):
    units = b.t(s, d, "lineitem").select("l_orderkey", "l_linenumber")
    return mining.budgeted_units(units, "l_orderkey", 5000).groupBy("l_orderkey").agg(F.count("*").alias("units"))


BUDGET = "with p as (select l_orderkey, count(*) units from lineitem group by 1), q as (select *, coalesce(sum(units) over (order by l_orderkey rows between unbounded preceding and 1 preceding), 0) b from p) select l_orderkey, units from q where b <= 5000"


def stale_sources(s, d):
    docs = b.t(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("module"), F.sha2("text", 256).alias("digest"), F.lit(1).alias("budget"))
    old = docs.filter("path % 4 <> 0").withColumn("digest", F.when(F.col("path") % 7 == 0, F.lit("old")).otherwise(F.col("digest")))
    return mining.stale_sources(docs, old).select("path", "digest")


STALE = "select doc_id path, sha256(text) digest from documents where doc_id % 4 = 0 or doc_id % 7 = 0"


def evidence_fingerprint(s, d):
    return b.t(s, d, "nation").select("n_nationkey", mining.fingerprint("n_name", "n_regionkey").alias("fingerprint"))


FINGERPRINT = "select n_nationkey, sha256(length(n_name) || ':' || n_name || '|' || length(cast(n_regionkey as varchar)) || ':' || n_regionkey) fingerprint from nation"


def rule_grid(s, d):
    ev = b.t(s, d, "events")
    res = ev.select(F.col("event_type").alias("rule"), F.concat_ws("/", "user_id", F.date_format("ts", "dd")).alias("source")).distinct()
    return rules.missing_pairs(res.select("rule"), res.select("source").distinct(), res).groupBy("rule").agg(F.count("*").alias("missing"))


RULE_GRID = """
with r as (select distinct event_type as rule, user_id || '/' || strftime(ts, '%d') source from events)
select t.rule, count(*) missing from (select distinct rule from r) t cross join (select distinct source from r) s left join r on r.rule = t.rule and r.source = s.source where r.rule is null group by 1
"""


# --- vectors -------------------------------------------------------------------------------


def _query_vector(s, d):
    return b.t(s, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


def _knn(metric):
    def run(s, d):
        out = vectors.nearest(b.t(s, d, "embeddings"), _query_vector(s, d), 10, metric, "vec_id", "embedding", None)
        return out.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))

    return run


_DOT = "list_sum(list_transform(list_zip(cast({a} as double[]), cast({b} as double[])), lambda x: x[1] * x[2]))"
_COS = "1 - " + _DOT.format(a="e.embedding", b="q.embedding") + " / (sqrt(" + _DOT.format(a="e.embedding", b="e.embedding") + ") * sqrt(" + _DOT.format(a="q.embedding", b="q.embedding") + "))"
_L2 = "sqrt(list_sum(list_transform(list_zip(cast(e.embedding as double[]), cast(q.embedding as double[])), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
_KNN = "with q as (select embedding from embeddings where vec_id = 0) select e.vec_id, round({dist}, 6) + 0.0 distance from embeddings e, q {where} order by {dist}, e.vec_id limit 10"


def knn_filtered(s, d):
    e = b.t(s, d, "embeddings").withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("parity"), (F.col("vec_id") % 2).cast("string")))
    one = e.filter("vec_id = 0").select("label").first()[0]
    out = vectors.nearest(vectors.with_metadata(e, {"label": str(one), "parity": "0"}), _query_vector(s, d), 10, "cosine", "vec_id", "embedding", None)
    return out.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


KNN_FILTERED = _KNN.format(dist=_COS, where="where e.label = (select label from embeddings where vec_id = 0) and e.vec_id % 2 = 0")


def knn_batch(s, d):
    """A stated set of queries (ids that 50 divides) against all rows."""
    e = b.t(s, d, "embeddings")
    out = vectors.nearest_to_each(e, e.filter("vec_id % 50 = 0"), 3, "l2", "vec_id", "embedding")
    return out.select("query_id", "vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


KNN_BATCH = f"with r as (select q.vec_id query_id, e.vec_id, {_L2} d from embeddings e, embeddings q where q.vec_id % 50 = 0), k as (select *, row_number() over (partition by query_id order by d, vec_id) n from r) select query_id, vec_id, round(d, 6) + 0.0 distance from k where n <= 3"


def vector_upsert(s, d):
    e = b.t(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    new = e.filter("id % 5 = 0").select((F.col("id") + 3).alias("id"), (F.col("label") + 100).alias("label"))
    return vectors.delete(vectors.upsert(e, new), e.filter("id % 9 = 0").select("id"))


UPSERT = "with n as (select vec_id + 3 id, label + 100 as label from embeddings where vec_id % 5 = 0) select * from (select vec_id id, label from embeddings where vec_id not in (select id from n) union all select * from n) where id not in (select vec_id from embeddings where vec_id % 9 = 0)"

QUERIES = {
    "clone_blocks": (clone_blocks, CLONE_BLOCKS), "clone_unique_lines": (clone_unique_lines, CLONE_UNIQUE), "clone_candidates": (clone_candidates, CLONE_CANDIDATES), "resolve_refs": (resolve_refs, RESOLVE), "resolve_types": (resolve_types, RESOLVE_TYPES),
    "graph_coupling": (graph_coupling, GRAPH_COUPLING), "graph_context": (graph_context, GRAPH_CONTEXT), "graph_neighbours": (graph_neighbours, GRAPH_NEIGHBOURS), "graph_stats": (graph_stats, GRAPH_STATS), "graph_dot": (graph_dot, GRAPH_DOT), "lcov_roundtrip": (lcov_roundtrip, LCOV), "coverage_match": (coverage_match, COVERAGE_MATCH),
    "coverage_functions": (coverage_functions, COVERAGE_FUNCTIONS), "coverage_function_rows": (coverage_function_rows, COVERAGE_FUNCTION_ROWS), "history_evidence": (history_evidence, HISTORY), "blame_aged": (blame_aged, BLAME), "compare_reports": (compare_reports, COMPARE), "validate_improvement": (validate_improvement, VALIDATE), "missing_evidence_delta": (missing_evidence_delta, MISSING),
    "performance_gate": (performance_gate, GATE), "closed_clumps": (closed_clumps, CLUMPS), "repeated_shapes": (repeated_shapes, SHAPES), "fact_budget": (fact_budget, BUDGET), "stale_sources": (stale_sources, STALE), "evidence_fingerprint": (evidence_fingerprint, FINGERPRINT),
    "rule_grid_complete": (rule_grid, RULE_GRID), "knn_cosine": (_knn("cosine"), _KNN.format(dist=_COS, where="")), "knn_l2": (_knn("l2"), _KNN.format(dist=_L2, where="")), "knn_filtered": (knn_filtered, KNN_FILTERED), "knn_batch": (knn_batch, KNN_BATCH), "vector_upsert": (vector_upsert, UPSERT),
}
