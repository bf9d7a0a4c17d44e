"""Queries over report cells, sources, units, budgets, absence and cache dispositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, compare, coverage, graph, history, introduction, lifecycle, metrics, mining, resolve, rules, vectors
from ..sinks import reports as sink
from ..sources import files
from . import bindings as b

# --- report cells --------------------------------------------------------------------------


def csv_cells(s, d):
    """Cells with quotes, and what a spreadsheet would run guarded."""
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("="), F.col("p_name"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("  -"), F.col("p_name"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("\tx"), F.col("p_name"))).otherwise(F.concat(F.lit('a"'), F.col("p_name")))
    return b.t(s, d, "part").select("p_partkey", sink.csv_cell(text).alias("cell"))


CSV = r"""
with x as (select p_partkey, case p_partkey % 4 when 0 then '=' || p_name when 1 then '  -' || p_name when 2 then chr(9) || 'x' || p_name else 'a"' || p_name end t from part)
select p_partkey, '"' || replace(case when t[1] in (chr(9), chr(13)) or ltrim(t)[1] in ('=', '+', '-', '@') then '''' || t else t end, '"', '""') || '"' cell from x
"""


def html_cells(s, d):
    """Markup escaped, control characters as spaces."""
    text = F.concat(F.lit("<b>&'"), F.col("p_name"), F.lit('"\n\x07>'))
    return b.t(s, d, "part").select("p_partkey", sink.single_line(sink.html_text(text)).alias("cell"))


HTML = """select p_partkey, '&lt;b&gt;&amp;&#39;' || p_name || '&quot;  &gt;' as cell from part"""


def coverage_lines(s, d):
    """Diagnostics of coverage as text lines."""
    rows = b.t(s, d, "supplier").select(F.concat(F.lit("e"), F.col("s_suppkey")).alias("entity_id"), F.col("s_name").alias("path"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("matched"), F.when(F.col("s_suppkey") % 3 == 0, "exact").otherwise("missingFile").alias("strategy"))
    return coverage.diagnostic_lines(rows)


COVERAGE_LINES = "select 'e' || s_suppkey || ' path=' || s_name || ' matched=' || case when s_suppkey % 3 = 0 then s_name else '-' end || ' strategy=' || case when s_suppkey % 3 = 0 then 'exact' else 'missingFile' end as line from supplier"


# --- sources -------------------------------------------------------------------------------


def _sources(s, d):
    path = F.concat_ws("/", F.col("source"), F.when(F.col("doc_id") % 5 == 0, "UnitTests").otherwise("Core"), F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, "Tests.swift").otherwise(".swift")))
    return b.t(s, d, "documents").select("doc_id", path.alias("path"), F.concat(F.col("lang"), F.when(F.col("doc_id") % 11 == 0, "Tests").otherwise("")).alias("module"), "source")


SOURCES_SQL = "so as (select doc_id, concat_ws('/', source, case when doc_id % 5 = 0 then 'UnitTests' else 'Core' end, doc_id || case when doc_id % 7 = 0 then 'Tests.swift' else '.swift' end) path, coalesce(lang, '') || case when doc_id % 11 = 0 then 'Tests' else '' end module from documents)"


def test_sources(s, d):
    """Sources that are tests, by module, folder or file name."""
    return _sources(s, d).filter(files.is_test_source()).select("doc_id")


TEST_SOURCES = f"with {SOURCES_SQL} select doc_id from so where regexp_matches(module, 'Tests?$') or regexp_matches(path, '(^|/)[^/]*Tests/') or path like '%Tests.swift'"


def excluded_sources(s, d):
    """Sources left by two literal prefixes, a folder and a file."""
    found = _sources(s, d)
    first = b.t(s, d, "documents").agg(F.min("source")).first()[0]
    return files.exclude(found, [f"{first}/Core", f"{first}/UnitTests/0Tests.swift"]).select("doc_id", "path")


EXCLUDED = f"with {SOURCES_SQL}, m as (select min(source) s from documents) select doc_id, path from so, m where not starts_with(path, s || '/Core/') and path <> s || '/UnitTests/0Tests.swift'"


def snapshot_digest(s, d):
    """Identity of all documents as sources, folded over 256 prefixes."""
    src = b.t(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("M").alias("module"), F.coalesce("text", F.lit("")).alias("content"))
    return mining.snapshot_digest(src)


DIGEST = r"""
with o as (select sha256(doc_id || chr(10) || 'M' || chr(10) || sha256(coalesce(text, ''))) x from documents), p as (select substr(x, 1, 2) p, sha256(string_agg(x, '' order by x)) y, count(*) n from o group by 1)
select sha256(string_agg(p || y, '' order by p || y)) digest, cast(sum(n) as bigint) files from p
"""


def cache_dispositions(s, d):
    """Which cached sources are reused, and why the others aren't."""
    now = b.t(s, d, "documents").select(F.col("doc_id").alias("path"), F.lit("M").alias("module"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), (F.col("doc_id") % 3).alias("budget"), F.lit(1).alias("schema_version"), F.lit("e").alias("engine"))
    old = now.filter("path % 6 <> 0").withColumn("digest", F.when(F.col("path") % 5 == 0, F.lit("x")).otherwise(F.col("digest"))).withColumn("engine", F.when(F.col("path") % 7 == 0, F.lit("f")).otherwise(F.col("engine")))
    out = cache.dispositions(now.filter("path % 10 <> 1"), old)
    return out.select("path", "disposition", F.array_join("reasons", ",").alias("reasons"))


CACHE = """
select doc_id path, case when doc_id % 10 = 1 then 'removed' when doc_id % 6 = 0 then 'new' when doc_id % 5 = 0 or doc_id % 7 = 0 then 'recomputed' else 'reused' end disposition,
  case when doc_id % 10 = 1 or doc_id % 6 = 0 then '' else concat_ws(',', case when doc_id % 5 = 0 then 'content-changed' end, case when doc_id % 7 = 0 then 'engine-changed' end) end reasons
from documents where not (doc_id % 10 = 1 and doc_id % 6 = 0)
"""


# --- facts and graph -----------------------------------------------------------------------


def code_line_signatures(s, d):
    """Lines that have a token, numbered."""
    return b.document_lines(s, d).select("file", "number", "ord", F.sha2("signature", 256).alias("signature"))


CODE_LINES = "with l as (select doc_id file, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) number from documents) select file, cast(number as int) number, row_number() over (partition by file order by number) - 1 as ord, sha256(trim(line)) signature from l where trim(line) <> ''"


def graph_nodes(s, d):
    """Modules, types and callables with their ids."""
    nation = b.t(s, d, "nation").select(F.col("n_name").alias("module"))
    types = b.t(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("module"), F.col("s_name").alias("name"))
    calls = b.t(s, d, "orders").select(F.concat(F.lit("f"), F.col("o_custkey")).alias("name"), F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("line"), F.lit(3).alias("column"))
    return graph.nodes(nation, types, calls)


NODES = "select 'module' as kind, 'module:' || n_name id from nation union all select 'type', 'type:' || s_nationkey || '.' || s_name from supplier union all select 'callable', 'callable:f' || o_custkey || '@' || o_orderstatus || ':' || o_orderkey || ':3' from orders"


def module_edges(s, d):
    """References across nations, distinct with their place."""
    refs = b.t(s, d, "lineitem").join(b.t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(b.t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(b.t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return graph.module_edges(refs.select(F.col("c_nationkey").alias("source_module"), F.col("s_nationkey").alias("target_module"), (F.col("o_orderkey") % 100).alias("line")))


MODULE_EDGES = "select distinct c_nationkey source_module, s_nationkey target_module, o_orderkey % 100 as line from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_nationkey <> s_nationkey"


def resolve_calls(s, d):
    """Calls by full name and labels, on the own type first; a call never is its caller."""
    calls = b.t(s, d, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("call_id"), F.concat(F.lit("c"), F.col("l_partkey") % 200).alias("caller"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("self.f"), F.col("l_partkey") % 90)).otherwise(F.concat(F.lit("f"), F.col("l_suppkey") % 90)).alias("callee"),
        F.when(F.col("l_linenumber") % 2 == 0, "a:").otherwise("").alias("labels"), F.when(F.col("l_linenumber") < 5, F.concat(F.lit("M.T"), F.col("l_suppkey") % 3)).alias("owner"),
    ).dropDuplicates(["call_id"])
    # 200 callables: some names on types, some free, some twice.
    defs = s.range(200).select(F.concat(F.lit("c"), "id").alias("callable_id"), F.concat(F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("M.T"), F.col("id") % 3, F.lit("."))), F.lit("f"), F.col("id") % 90, F.lit("("), F.when(F.col("id") % 2 == 0, "a:").otherwise(""), F.lit(")")).alias("full_name"))
    return resolve.resolve_calls(calls, defs).select("call_id", "outcome", "callable_id", "candidates")


CALLS = """
with k as (select distinct l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey call_id, 'c' || (l_partkey % 200) caller, l_linenumber n, case when l_linenumber = 1 then 'f' || (l_partkey % 90) else 'f' || (l_suppkey % 90) end nm,
  case when l_linenumber % 2 = 0 then '(a:)' else '()' end lb, case when l_linenumber < 5 then 'M.T' || (l_suppkey % 3) end ow from lineitem),
df as (select 'c' || i id, case when i % 4 = 0 then '' else 'M.T' || (i % 3) || '.' end || 'f' || (i % 90) || '(' || case when i % 2 = 0 then 'a:' else '' end || ')' fn from (select unnest(generate_series(0, 199)) i)),
h as (select distinct call_id, df.id from k join df on (df.fn = ow || '.' || nm || lb or (n <> 1 and df.fn = nm || lb)) and df.id <> caller), c as (select call_id, count(*) c, min(id) t from h group by 1)
select k.call_id, case when coalesce(c, 0) = 1 then 'resolved' when c > 1 then 'ambiguous' else 'unresolved' end outcome, case when c = 1 then t end callable_id, coalesce(c, 0) candidates from k left join c using (call_id)
"""


def summary_with_clones(s, d):
    """The long form of all ten metrics, clone blocks among them, summed up."""
    from ..operators import clones

    types = metrics.merged_types(b.fragments(s, d))
    blocks = clones.blocks(b.document_lines(s, d), 3, None).select(F.col("lines").alias("code_lines"))
    edges = b.t(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("first"), (F.col("l_partkey") * -1).cast("string").alias("second")).distinct()
    out = metrics.summary(metrics.observations(types, b.functions(s, d), edges, blocks)).filter("metric in ('DC', 'LOCF', 'NOPF')")
    return out.select("metric", "observations", "violations", "maximum", "total")


def _summary_sql():
    from .q_structure import LINES_SQL

    return f"""
with {LINES_SQL}, f as (select l_suppkey % 14 pa, cast(l_quantity as bigint) cl from lineitem join orders on l_orderkey = o_orderkey)
select 'DC' metric, count(*) observations, count(*) filter (lines > 10) violations, cast(max(lines) as bigint) maximum, cast(sum(lines) as bigint) total from bl
union all select 'LOCF', count(*), 0, max(cl), cast(sum(cl) as bigint) from f union all select 'NOPF', count(*), count(*) filter (pa > 10), max(pa), cast(sum(pa) as bigint) from f
"""


def type_eligibility(s, d):
    """Types with exactly one base in scope, as graph nodes."""
    return metrics.merged_types(b.fragments(s, d)).select(F.concat(F.lit("type:"), F.concat_ws(".", "module", "name")).alias("id"), F.size("fields").alias("fields"))


def _eligibility_sql():
    from .q_metrics import TYPES_SQL

    return "with " + TYPES_SQL + " n as (select k, count(*) c from fields group by 1) select 'type:' || ty.module || '.' || ty.k id, cast(coalesce(n.c, 0) as int) fields from ty left join n on n.k = ty.k"


# --- rules ---------------------------------------------------------------------------------


def _results(s, d):
    ev = b.t(s, d, "events")
    return ev.groupBy(F.col("event_type").alias("rule"), F.col("user_id").alias("source")).agg(F.count_if(F.col("value") > 50).alias("detections"), F.max("value").alias("v")).withColumn("outcome", F.when(F.col("v") > 99, "failed").otherwise("committed"))


def absence_proofs(s, d):
    """Rules that committed for a source without any detection."""
    return rules.absence_proofs(_results(s, d))


ABSENCE = "select event_type as rule, user_id source from events group by 1, 2 having max(value) <= 99 and count(*) filter (value > 50) = 0"


def rule_completeness(s, d):
    return rules.completeness(_results(s, d))


COMPLETENESS = "with r as (select event_type as rule, user_id, count(*) filter (value > 50) n, max(value) v from events group by 1, 2) select rule, bool_and(v <= 99) complete, cast(sum(n) as bigint) detections from r group by 1"


def verified_absence(s, d):
    """Absence that nothing blocks, and the blockers of the rest."""
    f = b.t(s, d, "part").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("scope"), (F.col("p_partkey") % 3 == 0).alias("rule"), (F.col("p_partkey") % 5 == 0).alias("open"))
    out = lifecycle.absence_blockers(f, {"scope-incomplete": "scope", "rule-missing": "rule", "detection-unresolved": "open"})
    return out.select("p_partkey", F.array_join("blockers", ",").alias("blockers"), "verified")


VERIFIED = "select p_partkey, concat_ws(',', case when p_partkey % 5 = 0 then 'detection-unresolved' end, case when p_partkey % 3 = 0 then 'rule-missing' end, case when p_partkey % 2 = 0 then 'scope-incomplete' end) blockers, p_partkey % 2 <> 0 and p_partkey % 3 <> 0 and p_partkey % 5 <> 0 as verified from part"


def coverage_orphans(s, d):
    """Records that no entity matched."""
    ents = b.t(s, d, "customer").select(F.concat(F.lit("src/"), F.col("c_custkey") % 300, F.lit(".x")).alias("path"))
    recs = b.t(s, d, "orders").select(F.concat(F.lit("/root/src/"), F.col("o_custkey") % 500, F.lit(".x")).alias("source_path"), F.col("o_orderkey").alias("record_order"))
    one = recs.groupBy("source_path").agg(F.min("record_order").alias("record_order"))
    return coverage.orphan_records(one, coverage.match_paths(ents, one))


ORPHANS = "with e as (select distinct c_custkey % 300 k from customer), r as (select o_custkey % 500 k, min(o_orderkey) record_order from orders group by 1) select '/root/src/' || k || '.x' source_path, record_order from r where k not in (select k from e)"


def semantic_pairs(s, d):
    """Whether two observations of a rule can be compared, and why not."""
    empty = F.array().cast("array<string>")
    p = b.t(s, d, "part").select(
        "p_partkey", F.lit("r").alias("prior_rule"), F.when(F.col("p_partkey") % 7 == 0, "q").otherwise("r").alias("current_rule"), F.lit("e1").alias("prior_engine"), F.when(F.col("p_partkey") % 5 == 0, "e2").otherwise("e1").alias("current_engine"), F.lit("i").alias("prior_source_identity"), F.lit("i").alias("current_source_identity"),
        F.array(F.lit("a")).alias("prior_capabilities"), F.array(F.lit("a")).alias("current_capabilities"), F.lit(True).alias("capabilities_available"), (F.col("p_partkey") % 11 != 0).alias("configuration_compatible"), F.lit(1).alias("prior_revision"), F.when(F.col("p_partkey") % 2 == 0, 2).otherwise(1).alias("current_revision"),
        F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("x"))).otherwise(empty).alias("declared_claims"), F.lit(1).alias("declared_from"), F.lit("x").alias("claim"),
    )
    return lifecycle.semantic_comparison(p).select("p_partkey", "compatible", F.array_join("reasons", ",").alias("reasons"))


SEMANTIC = """
with x as (select p_partkey k, concat_ws(',', case when p_partkey % 7 = 0 then 'rule-identity-incomparable' end, case when p_partkey % 5 = 0 then 'engine-incomparable' end, case when p_partkey % 11 = 0 then 'configuration-compatibility-not-declared' end, case when p_partkey % 2 = 0 and p_partkey % 4 <> 0 then 'semantic-revision-incomparable' end) r from part)
select k p_partkey, r = '' as compatible, case when r <> '' then r when k % 2 = 0 then 'semantic-compatibility-declared' else '' end reasons from x
"""


def configuration_pairs(s, d):
    """Which configuration changes a declaration covers."""
    p = b.t(s, d, "part").select("p_partkey", F.lit("a").alias("prior_scope"), F.when(F.col("p_partkey") % 2 == 0, "b").otherwise("a").alias("current_scope"), F.lit(1).alias("prior_floor"), F.when(F.col("p_partkey") % 3 == 0, 2).otherwise(1).alias("current_floor"), F.when(F.col("p_partkey") % 5 != 0, F.array(F.lit("scope"))).alias("declared_dimensions"))
    return lifecycle.configuration_comparison(p, ("scope", "floor")).select("p_partkey", F.array_join("changed", ",").alias("changed"), "compatible", "reason")


CONFIGURATION = """
with x as (select p_partkey k, p_partkey % 2 = 0 sc, p_partkey % 3 = 0 fl, p_partkey % 5 <> 0 de from part),
y as (select *, case when not sc and not fl then null when not de then 'configuration-compatibility-not-declared' when sc and not fl then 'configuration-compatibility-declared' else 'configuration-declaration-dimensions-mismatch' end r from x)
select k p_partkey, concat_ws(',', case when sc then 'scope' end, case when fl then 'floor' end) changed, (not sc and not fl) or coalesce(r = 'configuration-compatibility-declared', false) as compatible, r reason from y
"""


def head_inventory(s, d):
    """Findings by state at each head of a forest."""
    o = b.t(s, d, "orders").select(F.col("o_custkey").alias("snapshot_id"), F.col("o_orderkey").alias("finding"), F.col("o_orderstatus").alias("state"))
    c = b.t(s, d, "customer").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 2).alias("parent"))
    return lifecycle.inventory(o, lifecycle.heads(c, c.select(F.col("child").alias("id"))))


INVENTORY = "select o_custkey snapshot_id, o_orderstatus state, count(*) findings from orders where o_custkey in (select c_custkey from customer) and o_custkey not in (select c_custkey // 2 from customer) group by 1, 2"


def introduction_search(s, d):
    """All ancestors of a revision of a wide history, breadth first."""
    e = b.t(s, d, "customer").select(F.col("c_custkey").alias("child"), F.explode(F.array(F.floor(F.col("c_custkey") / 2), F.floor(F.col("c_custkey") / 3))).alias("parent")).filter("parent > 0").distinct()
    top = b.t(s, d, "customer").select(F.max("c_custkey").alias("id"))
    return introduction.search(e, top, 10**9)["revisions"]


SEARCH = """
with recursive e as (select distinct c_custkey c, p from (select c_custkey, unnest([c_custkey // 2, c_custkey // 3]) p from customer) where p > 0),
w(id, depth) as (select max(c_custkey), cast(0 as bigint) from customer union select e.p, w.depth + 1 from w join e on e.c = w.id) select id, min(depth) depth from w group by 1
"""


def revision_assessment(s, d):
    """Whether a finding was present, absent or undecided at each revision."""
    rev = b.t(s, d, "customer").select(F.col("c_custkey").alias("revision"), (F.col("c_custkey") % 6 == 0).alias("parse"), (F.col("c_custkey") % 10 == 0).alias("scope"))
    det = b.t(s, d, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("revision"))
    return introduction.assess(rev, det, {"parse-failed": "parse", "scope-partial": "scope"}).select("revision", "outcome", F.array_join("reasons", ",").alias("reasons"))


ASSESSMENT = """
with n as (select o_custkey k, count(*) c from orders where o_orderkey % 4 = 0 group by 1),
x as (select c_custkey k, coalesce(c, 0) c, concat_ws(',', case when c_custkey % 6 = 0 then 'parse-failed' end, case when c_custkey % 10 = 0 then 'scope-partial' end, case when c > 1 then 'historical-continuity-ambiguous' end) r from customer left join n on n.k = c_custkey)
select k revision, case when r <> '' then 'incomplete' when c = 1 then 'present' else 'absent' end outcome, r reasons from x
"""


def reusable_history(s, d):
    h = b.t(s, d, "orders").select(F.col("o_custkey").alias("revision"), (F.col("o_orderstatus") != "P").alias("complete"), (F.col("o_orderkey") % 3).alias("detections"))
    return introduction.reusable(h)


REUSABLE = "select distinct o_custkey revision from orders where o_orderstatus <> 'P' and o_orderkey % 3 = 0"


def best_conclusion(s, d):
    """The best conclusion of each finding over all attempts."""
    c = b.t(s, d, "orders").select(F.col("o_custkey").alias("finding"), F.col("o_orderkey").alias("attempt"), F.element_at(F.array(F.lit("exact"), F.lit("bounded"), F.lit("unavailable")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("kind"))
    return lifecycle.best_conclusion(c)


BEST = "with c as (select o_custkey finding, o_orderkey attempt, (['exact', 'bounded', 'unavailable'])[o_orderkey % 3 + 1] kind, row_number() over (partition by o_custkey order by o_orderkey % 3, o_orderkey desc) n from orders) select finding, attempt, kind from c where n = 1"


def exit_statuses(s, d):
    """The exit status of each possible outcome of a gate."""
    p = b.t(s, d, "part").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("complete"), (F.col("p_partkey") % 3 == 0).alias("violated"))
    return p.select("p_partkey", compare.exit_status(F.col("complete"), ~F.col("violated")).alias("status"))


EXIT = "select p_partkey, case when p_partkey % 2 <> 0 then 2 when p_partkey % 3 = 0 then 1 else 0 end status from part"


def repair_words(s, d):
    """Commit subjects that hold a repair word as a whole token."""
    subject = F.concat(F.element_at(F.array(*map(F.lit, ["Fix: ", "prefix ", "bug-", "hot fixes ", "Crash/", "repaired "])), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_name"))
    return b.t(s, d, "part").filter(history.is_fix(subject)).select("p_partkey")


REPAIR = "select p_partkey from part where p_partkey % 6 in (0, 2, 4) or regexp_matches(lower(p_name), '(^|[^a-z0-9])(fix|bug|crash|defect|regression|hotfix|repair)([^a-z0-9]|$)')"


def valid_vectors(s, d):
    """Vectors that can be searched: their length, finite numbers and, for cosine, a norm."""
    e = b.t(s, d, "embeddings")
    n = len(e.first()["embedding"])
    v = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, n - 1)).when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return e.withColumn("v", v).select("vec_id", vectors.is_valid(F.col("v"), n, "cosine").alias("valid"))


VALID = "select vec_id, vec_id % 5 <> 0 and vec_id % 7 <> 0 as valid from embeddings"


def snapshot_absence(s, d):
    """Whether a snapshot proves that findings are gone; customers are findings, nations rules."""
    f = b.t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("rule"), (F.col("c_custkey") % 8 != 0).alias("in_lineage"))
    nations = s.range(25).select(F.col("id").alias("rule"))
    results = nations.select("rule", F.lit("a").alias("source"), F.when(F.col("rule") % 6 == 1, "failed").when(F.col("rule") % 6 == 2, "parseFailed").otherwise("committed").alias("outcome"))
    comparisons = nations.select("rule", (F.col("rule") % 7 != 0).alias("compatible"), F.array(F.lit("engine-incomparable")).alias("reasons"))
    out = lifecycle.verified_absence(f, True, nations.filter("rule % 5 <> 0"), results, nations.filter("rule % 11 = 3"), f.filter("id % 9 = 0"), comparisons)
    return out.select("id", "verified", F.array_join("reasons", ",").alias("reasons"))


SNAPSHOT_ABSENCE = """
with x as (select c_custkey id, list_sort(list_filter([case when c_custkey % 8 = 0 then 'lineage-incomparable' end, case when c_nationkey % 5 = 0 then 'rule-omitted' end, case when c_nationkey % 11 = 3 then 'continuity-candidate-present' end, case when c_custkey % 9 = 0 then 'continuity-unresolved' end,
  case when c_nationkey % 6 = 1 then 'atomic-observation-failed' when c_nationkey % 6 = 2 then 'atomic-observation-parseFailed' end, case when c_nationkey % 5 <> 0 and c_nationkey % 7 = 0 then 'engine-incomparable' end], lambda z: z is not null)) r from customer)
select id, len(r) = 0 as verified, case when len(r) = 0 then 'complete-comparable-absence' else array_to_string(r, ',') end reasons from x
"""


def snapshot_scope(s, d):
    """The scope of a snapshot by what narrowed its selection."""
    p = b.t(s, d, "part").select("p_partkey", *[(F.col("p_partkey") % k == 0).alias(c) for k, c in zip((2, 3, 5, 7, 11, 13, 17, 19), lifecycle.LIMITATIONS, strict=True)])
    return lifecycle.scope_of(p).select("p_partkey", "scope", "message")


SNAPSHOT_SCOPE = "with x as (select p_partkey, list_filter([" + ", ".join(f"case when p_partkey % {k} = 0 then '{text}' end" for k, text in zip((2, 3, 5, 7, 11, 13, 17, 19), lifecycle.LIMITATIONS.values(), strict=True)) + "], lambda z: z is not null) r from part) select p_partkey, case when len(r) = 0 then 'repository' else 'partial' end as scope, case when len(r) > 0 then array_to_string(r, '; ') || '.' end as message from x"


def snapshot_placement(s, d):
    """Where new snapshots belong in a lineage; orders arrive at a store of customers."""
    store = b.t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("r"), F.when(F.col("c_custkey") % 20 == 0, F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))).alias("revision"), (F.col("c_custkey") % 6 != 0).alias("clean"), F.lit(True).alias("processed"))
    parent = F.concat(F.lit("r"), F.col("o_custkey"))
    parents = F.when(F.col("o_orderkey") % 4 == 0, F.array(parent, F.lit("x"))).when(F.col("o_orderkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(parent))
    new = b.t(s, d, "orders").select((F.col("o_orderkey") + 10_000_000).alias("id"), F.when(F.col("o_orderkey") % 10 != 1, F.concat(F.lit("n"), "o_orderkey")).alias("revision"), (F.col("o_orderkey") % 9 != 0).alias("clean"), parents.alias("parents"))
    return lifecycle.place(new, store)


SNAPSHOT_PLACEMENT = """
with st as (select c_custkey id, case when c_custkey % 20 = 0 then c_custkey - 1 else c_custkey end r, c_custkey % 6 <> 0 clean from customer), pa as (select r, count(*) n, min(id) at_ from st where clean group by 1),
x as (select o_orderkey k, case when o_orderkey % 10 = 1 then 'unversioned' when o_orderkey % 9 = 0 then 'dirty' when o_orderkey % 4 = 0 then 'merge' when o_orderkey % 7 = 0 then 'parent-missing' when coalesce(n, 0) <> 1 then 'parent-not-unique' else 'successor' end p, at_ from orders left join pa on pa.r = o_custkey)
select k + 10000000 id, p placement, case when p = 'successor' then at_ end predecessor from x
"""


def cache_invalidations(s, d):
    """Why facts of a source are made anew, or go."""
    now = b.t(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("module"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), (F.col("doc_id") % 3).alias("budget"))
    old = now.filter("path % 6 <> 0").select("path", F.when(F.col("path") % 13 == 0, F.lit("??")).otherwise(F.col("module")).alias("module"), F.when(F.col("path") % 5 == 0, F.lit("x")).otherwise(F.col("digest")).alias("digest"), F.when(F.col("path") % 7 == 0, F.lit(9)).otherwise(F.col("budget")).alias("budget"))
    return cache.invalidations(now.filter("path % 10 <> 1"), old)


CACHE_INVALIDATIONS = """
select * from (select doc_id path, case when doc_id % 10 = 1 then 'source-removed' when doc_id % 6 = 0 then 'source-added' when doc_id % 13 = 0 then 'source-metadata-changed' when doc_id % 5 = 0 then 'source-content-changed' when doc_id % 7 = 0 then 'dependency-changed' end reason
  from documents where not (doc_id % 10 = 1 and doc_id % 6 = 0)) where reason is not null
"""


def replayed_events(s, d):
    """Stored events that a replay gives otherwise."""
    o = b.t(s, d, "orders").select(F.col("o_orderkey").alias("finding"), F.col("o_custkey").alias("snapshot_id"), F.col("o_orderstatus").alias("kind"))
    again = o.filter("finding % 7 <> 0").withColumn("kind", F.when(F.col("finding") % 5 == 0, "X").otherwise(F.col("kind")))
    return lifecycle.replay_violations(o.filter("finding % 11 <> 0"), again)


REPLAYED = """
select o_orderkey finding, o_custkey snapshot_id, case when o_orderkey % 11 <> 0 then o_orderstatus end stored_kind, case when o_orderkey % 7 <> 0 then case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end end replayed_kind from orders
where not (o_orderkey % 11 = 0 and o_orderkey % 7 = 0) and (o_orderkey % 11 = 0 or o_orderkey % 7 = 0 or o_orderkey % 5 = 0)
"""


def detection_numbers(s, d):
    """Detections numbered in the order of place and rule."""
    det = b.t(s, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("line"), F.lit(1).alias("column"), F.col("o_orderstatus").alias("rule"))
    return lifecycle.numbered_detections(det).select("line", "id")


NUMBERS = "select o_orderkey as line, 'detection:' || row_number() over (order by o_custkey, o_orderkey) id from orders"

QUERIES = {
    "csv_cells": (csv_cells, CSV), "html_cells": (html_cells, HTML), "coverage_lines": (coverage_lines, COVERAGE_LINES), "test_sources": (test_sources, TEST_SOURCES), "excluded_sources": (excluded_sources, EXCLUDED), "snapshot_digest": (snapshot_digest, DIGEST), "cache_dispositions": (cache_dispositions, CACHE),
    "code_line_signatures": (code_line_signatures, CODE_LINES), "graph_nodes": (graph_nodes, NODES), "module_edges": (module_edges, MODULE_EDGES), "resolve_calls": (resolve_calls, CALLS), "summary_with_clones": (summary_with_clones, _summary_sql()), "type_eligibility": (type_eligibility, _eligibility_sql()),
    "absence_proofs": (absence_proofs, ABSENCE), "rule_completeness": (rule_completeness, COMPLETENESS), "verified_absence": (verified_absence, VERIFIED), "coverage_orphans": (coverage_orphans, ORPHANS), "semantic_pairs": (semantic_pairs, SEMANTIC), "configuration_pairs": (configuration_pairs, CONFIGURATION),
    "head_inventory": (head_inventory, INVENTORY), "introduction_search": (introduction_search, SEARCH), "revision_assessment": (revision_assessment, ASSESSMENT), "reusable_history": (reusable_history, REUSABLE), "best_conclusion": (best_conclusion, BEST), "exit_statuses": (exit_statuses, EXIT),
    "snapshot_absence": (snapshot_absence, SNAPSHOT_ABSENCE), "snapshot_scope": (snapshot_scope, SNAPSHOT_SCOPE), "snapshot_placement": (snapshot_placement, SNAPSHOT_PLACEMENT), "cache_invalidations": (cache_invalidations, CACHE_INVALIDATIONS), "replayed_events": (replayed_events, REPLAYED), "detection_numbers": (detection_numbers, NUMBERS), "repair_words": (repair_words, REPAIR), "valid_vectors": (valid_vectors, VALID),
}
